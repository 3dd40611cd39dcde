"""Prediction over raw records: resolve, score, decide, explain, in one call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import domains as D
from corroborate.functions.vocab import DECISION_THETA
from corroborate.operators import graph
from corroborate.operators.evidence import BOILERPLATE, PLACEHOLDER, claim_scores, score_items, with_decision_path
from corroborate.operators.models import Scorer
from corroborate.operators.pairs import PairScorer, paired_scores
from corroborate.operators.resolve import resolve_sources


def record_items(records: DataFrame, key: str = "id") -> DataFrame:
    """(key, claim, i, evidence columns): a row per usable item of a record, numbered from 0 as in the record.

    An item is usable if it has text that is no boilerplate or unfilled placeholder, or, without text, triples.
    """
    items = records.select(F.col(key), "claim", F.posexplode("evidence").alias("i", "e")).select(key, "claim", F.col("i").cast("long").alias("i"), "e.*")
    text = F.trim(F.coalesce("text", F.lit("")))
    said = (text != "") & ~F.lower(text).isin(*BOILERPLATE) & ~text.rlike(PLACEHOLDER)
    return items.where(said | ((text == "") & (F.size(F.coalesce("triples", F.array().cast("array<array<string>>"))) > 0)))


def with_sources(items: DataFrame, registry: DataFrame) -> DataFrame:
    """items with a source for each: its own if that is registered, else what its URL and modality resolve to."""
    known = registry.select(F.col("source_id").alias("_known")).distinct()
    own = items.withColumnRenamed("source_id", "_own").join(known, F.col("_own") == F.col("_known"), "left")
    hosted = own.withColumn("domain", D.url_host(D.unwrapped_url(F.col("source_url"))))
    resolved = resolve_sources(hosted, registry)
    return resolved.withColumn("source_id", F.coalesce("_known", "source_id")).drop("_own", "_known", "domain")


def graph_tables(records: DataFrame, key: str = "id", k: int = graph.CO_EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """(items, edges) of records' claim graphs (N1, N2): usable items renumbered without gaps, and the five kinds of
    edges over them and the distinct triples of claim and items."""
    items = graph.indexed_evidence(record_items(records, key).withColumnRenamed("i", "at"), key, "at")
    text = lambda t: F.concat_ws(" ", t)
    claim = records.select(F.col(key), F.posexplode("claim_triples").alias("ord", "t")).select(key, F.col("ord").cast("long").alias("ord"), text(F.col("t")).alias("text"))
    said = items.select(key, "i", F.posexplode("triples").alias("ord", "t")).select(key, "i", F.col("ord").cast("long").alias("ord"), text(F.col("t")).alias("text"))
    return items, graph.edges(items, claim, said, key, k)


def predict(
    records: DataFrame, registry: DataFrame, verdicts: Scorer | None = None, pairs: PairScorer | None = None, theta: float = DECISION_THETA, key: str = "id", digits: int = 4
) -> DataFrame:
    """(key, verdict, path, decided_by, support, refute, n_items, reason, evidence) for each record.

    records: id, claim, evidence (the v3.0 schema). Items get a source, trust, weight and confidence; their
    stances, or with `pairs` the scorer's probabilities for claim and text, make the scores. Above theta
    the scores decide; elsewhere `verdicts` does (a scorer of models.MODELS, a fitted head, …), or without it not enough
    evidence. evidence: the items by falling confidence, ties by place. A record without usable items has scores of 0.
    """
    items = score_items(with_sources(record_items(records, key), registry), registry)
    if pairs:
        texts = items.withColumn("evidence", F.coalesce("text", F.array_join(F.transform("triples", lambda t: F.concat_ws(" ", t)), ". ")))
        scores = paired_scores(texts, pairs, key).drop("nei").withColumns({c: F.round(c, digits) for c in ("support", "refute")})
    else:
        scores = claim_scores(items, key, digits)
    shown = items.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), "i", "source_id", "stance", "confidence"))).alias("evidence"), F.count("*").alias("n_items")
    )
    whole = records.select(key).join(scores, key, "left").join(shown, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("support", "refute")})
    whole = whole.withColumn("n_items", F.coalesce("n_items", F.lit(0).cast("long")))
    if verdicts:
        whole = verdicts(whole)
    fallback = F.col("pred") if verdicts else None
    out = with_decision_path(whole, theta, fallback)
    symbolic: Column = F.col("path").startswith("symbolic_")
    reason = F.format_string("support %.4f, refute %.4f, %d items: %s", F.col("support"), F.col("refute"), F.col("n_items"), F.col("path"))
    return out.select(
        key, F.col("final").alias("verdict"), "path", F.when(symbolic, F.lit("scores")).otherwise(F.lit("fallback")).alias("decided_by"), "support", "refute", "n_items", reason.alias("reason"),
        F.transform("evidence", lambda e: e.dropFields("rank")).alias("evidence"),
    )
