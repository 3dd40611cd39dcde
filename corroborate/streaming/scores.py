"""Claim scores over a stream of evidence: an extension, the batch operators as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.operators.evidence import score_items


def windowed_scores(evidence: DataFrame, registry: DataFrame, length: str = "1 day", late: str = "2 hours", key: str = "claim_id") -> DataFrame:
    """Support, refute and verdict of each claim in each window of event time (column ts).

    evidence is a stream; the registry is static and joined to each batch. The state of a window
    is two products per claim; windows leave the state once the watermark has passed them.
    """
    items = score_items(evidence.withWatermark("ts", late), registry)
    scores = items.groupBy(F.window("ts", length).alias("w"), F.col(key)).agg(
        formula.rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "supports"), 4).alias("support"),
        formula.rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "refutes"), 4).alias("refute"),
    )
    return scores.select(F.col("w.start").alias("start"), key, "support", "refute", formula.verdict(F.col("support"), F.col("refute")).alias("verdict"))
