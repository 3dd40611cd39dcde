"""Vocabularies, weights and thresholds of the record schema, and small lookup expressions over them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabularies of the v3.0 record schema.
SCHEMA_VERSION = "3.0"
VERDICTS = ("supported", "refuted", "not_enough_evidence", "conflicting_evidence")
STANCES = ("supports", "refutes", "not_enough_evidence", "conflicting_evidence")
STRUCTURES = ("one_hop", "multi_hop", "conjunction", "negation", "absence")
EVIDENCE_TYPES = ("perception", "testimony", "non_apprehension", "comparison_analogy", "inference", "postulation_derivation")
MODALITIES = ("sensor", "web_text", "pdf", "web_table", "image", "video", "audio", "annotator_knowledge", "other", "unanswerable")
ENCODED_MODALITIES = ("sensor", "web_text", "video", "audio", "image", "pdf", "web_table", "annotator_knowledge", "other", "unknown")
STRATEGIES = ("direct_observation", "absence_detection", "spatial_comparison", "testimonial_lookup", "multi_hop_inference", "conflicting_evidence")
SOURCE_CATEGORIES = ("news_media", "academic", "government", "social_media", "sensor", "unknown")
SOURCE_CATEGORY_OF = {
    "news_media": "news_media", "fact_checker": "news_media", "government": "government", "scientific_paper": "academic",
    "knowledge_graph": "academic", "social_media": "social_media", "sensor": "sensor", "simulation": "sensor",
}
DERIVATIONS = ("aggregated_from_evidence", "annotated")
ASSIGNMENTS = ("heuristic", "rule_based", "annotated", "llm_generated", "simulator")

# Weights and thresholds of the confidence formula.
EVIDENCE_WEIGHTS = {
    "perception": 0.95, "testimony": 0.80, "non_apprehension": 0.75,
    "comparison_analogy": 0.65, "inference": 0.55, "postulation_derivation": 0.40,
}
TRAINING_TYPES = EVIDENCE_TYPES[:-1]
SUPPORT_THRESHOLD, REFUTE_THRESHOLD, CONFLICT_FLOOR = 0.75, 0.75, 0.40
DEFAULT_TRUST, DEFAULT_STRENGTH = 0.40, 0.6
DECISION_THETA = 0.35
PATHS = ("symbolic_supported", "symbolic_refuted", "vh_conflict", "vh_fallback")
TRUST_CAP, STRENGTH_FLOOR = 0.45, 0.10

#: Integer codes of verdicts and stances; a stance that isn't decisive is 2.
VERDICT_CODES = {"supported": 0, "refuted": 1, "not_enough_evidence": 2}
STANCE_CODES = {"supports": 0, "refutes": 1, "not_enough_evidence": 2, "conflicting_evidence": 2}

# Strings that count as booleans.
TRUE_VALUES = ("true", "1", "yes", "y", "t")
FALSE_VALUES = ("false", "0", "no", "n", "f")


def lookup(table: dict, key: Column, default=None) -> Column:
    """The value of key in a small literal table, or the default."""
    found = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def verdict_code(label: Column) -> Column:
    return lookup(VERDICT_CODES, label)


def stance_code(stance: Column) -> Column:
    return lookup(STANCE_CODES, stance, 2)


def one_hot(value: Column, vocabulary: tuple[str, ...], unknown: str | None = None) -> Column:
    """array<float>: 1 at the value's place; a value outside the vocabulary is `unknown`, or all zero."""
    known = value if unknown is None else F.when(value.isin(*vocabulary), value).otherwise(F.lit(unknown))
    return F.array(*(F.coalesce((known == v).cast("float"), F.lit(0.0).cast("float")) for v in vocabulary))


def multi_hot(values: Column, vocabulary: tuple[str, ...]) -> Column:
    """array<float>: 1 for each entry of the vocabulary that the array has."""
    return F.array(*(F.coalesce(F.array_contains(values, v).cast("float"), F.lit(0.0).cast("float")) for v in vocabulary))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, where an expression uses it many times."""
    return F.transform(F.array(value), f)[0]
