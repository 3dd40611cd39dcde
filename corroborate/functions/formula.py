"""Closed-form confidence of evidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions.vocab import (
    CONFLICT_FLOOR,
    DECISION_THETA,
    EVIDENCE_WEIGHTS,
    REFUTE_THRESHOLD,
    SUPPORT_THRESHOLD,
    TRAINING_TYPES,
    lookup,
)


def rounded(x: Column, digits: int) -> Column:
    """x rounded half up at a digit as SQL's round does it: scaled first. Of 1 - 0.75 * 0.775, which is
    0.41874999999999996, that makes 0.4188; the digits of the number as it is written make 0.4187."""
    return F.round(x * 10**digits, 0) / 10**digits


def evidence_weight(types: Column, weights: dict[str, float] | None = None) -> Column:
    """A1: noisy-or of the types' weights, rounded to 4; an unknown type weighs nothing, no types give 0."""
    table = weights or EVIDENCE_WEIGHTS
    missing = F.aggregate(F.coalesce(types, F.array().cast("array<string>")), F.lit(1.0), lambda left, t: left * (1 - lookup(table, t, 0.0)))
    return rounded(1 - missing, 4)


def evidence_confidence(trust: Column, weight: Column, strength: Column) -> Column:
    """A2: 1 - (1 - trust) ^ (weight * strength), rounded to 4; an exponent of 0 gives 0 whatever the trust."""
    exponent = weight * strength
    return F.when(exponent == 0, F.lit(0.0)).otherwise(rounded(1 - F.pow(1 - trust, exponent), 4))


def noisy_or(p: Column) -> Column:
    """A3-A5: aggregate 1 - product(1 - p); nulls are left out, nothing gives 0.

    Spark's product keeps a partial product per task, so only one number per group is shuffled.
    """
    return 1 - F.coalesce(F.product(1 - p), F.lit(1.0))


def stance_score(stance: Column, confidence: Column, wanted: str) -> Column:
    """A3: aggregate noisy-or over the items of one stance."""
    return noisy_or(F.when(stance == wanted, confidence))


def verdict(support: Column, refute: Column) -> Column:
    """Thresholds first, then conflict, then support, refute, nothing."""
    return (
        F.when((support >= CONFLICT_FLOOR) & (refute >= CONFLICT_FLOOR), F.lit("conflicting_evidence"))
        .when(support >= SUPPORT_THRESHOLD, F.lit("supported"))
        .when(refute >= REFUTE_THRESHOLD, F.lit("refuted"))
        .otherwise(F.lit("not_enough_evidence"))
    )


def decision_path(support: Column, refute: Column, theta: float = DECISION_THETA) -> Column:
    """which layer decides; scores count only above theta."""
    return (
        F.when((support > theta) & (refute > theta), F.lit("vh_conflict"))
        .when(support > theta, F.lit("symbolic_supported"))
        .when(refute > theta, F.lit("symbolic_refuted"))
        .otherwise(F.lit("vh_fallback"))
    )


def is_training(types: Column) -> Column:
    """Has a type that training uses."""
    return F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, TRAINING_TYPES))), F.lit(False))


def updated_trust(alpha: Column, beta: Column, correct: Column, total: Column) -> Column:
    """Mean of a Beta(alpha, beta) prior after total reports of which `correct` were right."""
    return F.try_divide(alpha + correct, alpha + beta + total)
