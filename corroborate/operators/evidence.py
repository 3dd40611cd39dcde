"""Scoring evidence and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.functions.vocab import DECISION_THETA, DEFAULT_STRENGTH, DEFAULT_TRUST

# Evidence texts that say nothing.
BOILERPLATE = ("no sensor evidence found for this object type.",)
PLACEHOLDER = r"(?i)\bthe described (element|substance|compound|entity|object|material|item)\b"


def with_trust(evidence: DataFrame, registry: DataFrame, default: float = DEFAULT_TRUST) -> DataFrame:
    """Evidence with its source's trust; a source that isn't registered has the default.

    A left join on source_id. The registry has one row per source, so no row is added; Spark sends
    it to all tasks if it is small, and otherwise shuffles both sides.
    """
    trust = registry.select("source_id", "source_trust")
    return evidence.join(trust, "source_id", "left").withColumn("source_trust", F.coalesce("source_trust", F.lit(default)))


def score_items(evidence: DataFrame, registry: DataFrame) -> DataFrame:
    """A1 and A2 for each item: adds source_trust, weight and confidence.

    evidence: source_id, evidence_types, inference_strength (null: the default strength), any more.
    """
    strength = F.coalesce("inference_strength", F.lit(DEFAULT_STRENGTH))
    return (
        with_trust(evidence, registry)
        .withColumn("weight", formula.evidence_weight(F.col("evidence_types")))
        .withColumn("confidence", formula.evidence_confidence(F.col("source_trust"), F.col("weight"), strength))
    )


def claim_scores(items: DataFrame, key: str = "claim_id", digits: int | None = 4) -> DataFrame:
    """A3 (rounded) or A4 (digits None): support and refute score of each claim, from scored items."""
    rounded = (lambda c: formula.rounded(c, digits)) if digits is not None else (lambda c: c)
    return items.groupBy(key).agg(
        rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "supports")).alias("support"),
        rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "refutes")).alias("refute"),
    )


def claim_verdicts(evidence: DataFrame, registry: DataFrame, key: str = "claim_id") -> DataFrame:
    """The whole chain: trust, weight, confidence, scores, verdict."""
    return claim_scores(score_items(evidence, registry), key).withColumn("verdict", formula.verdict(F.col("support"), F.col("refute")))


def soft_scores(items: DataFrame, p_support: Column, p_refute: Column, key: str = "claim_id") -> DataFrame:
    """A5: scores from stance probabilities, and what neither side covers."""
    scores = items.groupBy(key).agg(
        formula.noisy_or(F.col("confidence") * p_support).alias("support"), formula.noisy_or(F.col("confidence") * p_refute).alias("refute")
    )
    return scores.withColumn("nei", 1 - F.greatest("support", "refute"))


def with_decision_path(scores: DataFrame, theta: float = DECISION_THETA, fallback: Column | None = None) -> DataFrame:
    """path and final verdict; where scores don't decide, the fallback's verdict stands."""
    path = formula.decision_path(F.col("support"), F.col("refute"), theta)
    final = (
        F.when(path == "symbolic_supported", F.lit("supported"))
        .when(path == "symbolic_refuted", F.lit("refuted"))
        .otherwise(F.lit("not_enough_evidence") if fallback is None else fallback)
    )
    return scores.withColumn("path", path).withColumn("final", final)


def clean(evidence: DataFrame, text: str = "text") -> DataFrame:
    """Without boilerplate, unfilled placeholders and blank texts."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return evidence.where((t != "") & ~F.lower(t).isin(*BOILERPLATE) & ~t.rlike(PLACEHOLDER))


def first_seen(evidence: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """Of items with the same text (trimmed, lower case) under the same keys, the first in order."""
    row = F.min_by(F.struct(*evidence.columns), F.struct(*order)).alias("x")  # copies meet in the partial aggregate
    return evidence.groupBy(*(F.col(k).alias(f"_{k}") for k in keys), F.lower(F.trim(text)).alias("_text")).agg(row).select("x.*")


def claims_with_text(records: DataFrame, claim: str = "claim") -> DataFrame:
    """Records whose claim isn't blank."""
    return records.where(F.trim(F.coalesce(claim, F.lit(""))) != "")


def types_of_claims(evidence: DataFrame, key: str = "claim_id") -> DataFrame:
    """Sorted distinct evidence types of each claim. Pairs are made distinct before they meet."""
    pairs = evidence.select(key, F.explode("evidence_types").alias("t")).distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list("t")).alias("evidence_types_all"))


def training_claims(claims: DataFrame, verdict: str = "verdict", types: str = "evidence_types_all") -> DataFrame:
    """Adds why a claim is left out of training: its verdict first, then its types; null keeps it."""
    return claims.withColumn(
        "excluded",
        F.when(F.col(verdict) == "conflicting_evidence", F.lit("conflicting_evidence")).when(
            ~formula.is_training(F.col(types)), F.lit("no_training_type")
        ),
    )
