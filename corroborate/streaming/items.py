"""Claim scores over a stream of evidence: repeats dropped, late items taken (2.13).

Two keyed states in the JVM: the items that have been counted, and two products for each claim. Items
may come in any order and more than once; each batch gives the scores of the claims that it changed,
and the last of them equal the batch operators' on the same items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.operators.evidence import score_items


def running_scores(evidence: DataFrame, registry: DataFrame, key: str = "claim_id", item: str = "event_id", ts: str | None = None, keep: str | None = None) -> DataFrame:
    """(key, n, support, refute, verdict) of each claim that a batch changes, over all its items so far; output
    mode update.

    evidence is a stream with an id in column `item`; an id counts once for its claim. Without `keep` ids
    are remembered for good, and an item counts however late it comes. With ts and keep (an interval) ids
    are forgotten once the newest event time is that far ahead, and items later than that are left out.
    Items without an id or claim are left out.
    """
    rows = evidence.where(F.col(key).isNotNull() & F.col(item).isNotNull())
    if (ts is None) != (keep is None):
        raise ValueError("ts and keep go together")
    once = rows.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key, item]) if ts else rows.dropDuplicates([key, item])
    scores = score_items(once, registry).groupBy(key).agg(
        F.count("*").alias("n"),
        formula.rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "supports"), 4).alias("support"),
        formula.rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "refutes"), 4).alias("refute"),
    )
    return scores.withColumn("verdict", formula.verdict(F.col("support"), F.col("refute")))
