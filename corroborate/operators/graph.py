"""Claim graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import vocab as V

CO_EVIDENCE = 5


def indexed_evidence(evidence: DataFrame, key: str = "claim_id", order: str = "ord") -> DataFrame:
    """Adds i, the place of an item in its claim, from 0."""
    return evidence.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def co_evidence(items: DataFrame, key: str = "claim_id", k: int = CO_EVIDENCE) -> DataFrame:
    """Edges (key, src, dst) from each item to the k nearest others of its claim; of equal
    distances the lower place.

    Every item makes its own candidates from its place and the claim's size: at most 2 k of them,
    no self join. With all of them in reach, the nearest k are the first k in (distance, place).
    """
    n = F.count("*").over(Window.partitionBy(key))
    near = F.array_sort(
        F.transform(
            F.filter(F.sequence(F.greatest(F.col("i") - k, F.lit(0)), F.least(F.col("i") + k, F.col("n") - 1)), lambda j: j != F.col("i")),
            lambda j: F.struct(F.abs(j - F.col("i")).alias("d"), j.alias("j")),
        )
    )
    return items.select(key, F.col("i").cast("long").alias("i"), n.alias("n")).select(key, F.col("i").alias("src"), F.explode(F.slice(near, 1, k)).alias("x")).select(key, "src", F.col("x.j").alias("dst"))


def triple_index(claim_triples: DataFrame, evidence_triples: DataFrame, key: str = "claim_id") -> DataFrame:
    """Dense index of a claim's distinct triple texts, in order of first sight: claim triples
    (key, ord, text) first, then evidence triples (key, i, ord, text)."""
    every = claim_triples.select(key, F.lit(-1).cast("long").alias("i"), "ord", "text").unionByName(evidence_triples.select(key, F.col("i").cast("long").alias("i"), "ord", "text"))
    first = every.groupBy(key, "text").agg(F.min(F.struct("i", "ord")).alias("at"))
    return first.select(key, "text", (F.dense_rank().over(Window.partitionBy(key).orderBy("at")) - 1).cast("long").alias("t"))


def edges(items: DataFrame, claim_triples: DataFrame, evidence_triples: DataFrame, key: str = "claim_id", k: int = CO_EVIDENCE) -> DataFrame:
    """(key, kind, src, dst) of the five kinds; triple edges repeat where triples do (Q19)."""
    index = triple_index(claim_triples, evidence_triples, key)
    row = lambda df, kind, src, dst: df.select(key, F.lit(kind).alias("kind"), src.cast("long").alias("src"), dst.cast("long").alias("dst"))
    zero, i = F.lit(0), F.col("i")
    return (
        row(items, "has_evidence", zero, i)
        .unionByName(row(items, "connected_to", i, zero))
        .unionByName(row(co_evidence(items, key, k), "co_evidence", F.col("src"), F.col("dst")))
        .unionByName(row(claim_triples.join(index, [key, "text"]), "has_triple", zero, F.col("t")))
        .unionByName(row(evidence_triples.join(index, [key, "text"]), "from_triple", i, F.col("t")))
    )


def graph_sizes(edge_table: DataFrame, key: str = "claim_id") -> DataFrame:
    """Edges of each kind for each claim."""
    kinds = ("has_evidence", "connected_to", "co_evidence", "has_triple", "from_triple")
    return edge_table.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds), F.count("*").alias("n_edges"))


def hashed_embedding(text: Column, size: int = 384) -> Column:
    """N4 without a model: counts of the words' hashes, scaled to length one. array<float>."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = V.let(places, lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(at, lambda p: p == i)).cast("double")))
    scaled = lambda c: V.let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0)).cast("float")))
    return V.let(counts, scaled)


def evidence_features(embedding: Column, modality: Column, types: Column, category: Column, nli: Column | None = None) -> Column:
    """Embedding, modality (10), evidence types (5) and source category (6), and NLI (3) if given."""
    parts = [embedding, V.one_hot(modality, V.ENCODED_MODALITIES, "unknown"), V.multi_hot(types, V.TRAINING_TYPES), V.one_hot(category, V.SOURCE_CATEGORIES, "unknown")]
    return F.concat(*parts, *([] if nli is None else [nli]))


def claim_features(embedding: Column, strategy: Column) -> Column:
    """Embedding and reasoning strategy (6)."""
    return F.concat(embedding, V.one_hot(strategy, V.STRATEGIES))


def attend(nodes: DataFrame, edge_table: DataFrame, src_score: str, dst_score: str, value: str, key: str = "claim_id") -> DataFrame:
    """One head of message passing: for each destination the softmax-weighted sum of its sources'
    values, with LeakyReLU(src_score + dst_score) as logits. nodes: key, i, scores, value (double).

    Edges stay within a claim, so both joins and the sum share the claim's partitioning.
    """
    source = nodes.select(key, F.col("i").alias("src"), F.col(src_score).alias("_a"), F.col(value).alias("_v"))
    target = nodes.select(key, F.col("i").alias("dst"), F.col(dst_score).alias("_b"))
    raw = F.col("_a") + F.col("_b")
    logit = F.when(raw > 0, raw).otherwise(0.2 * raw)
    scored = edge_table.join(source, [key, "src"]).join(target, [key, "dst"]).withColumn("_e", logit)
    top = scored.withColumn("_w", F.exp(F.col("_e") - F.max("_e").over(Window.partitionBy(key, "dst"))))
    return top.groupBy(key, "dst").agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("message"))


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A small dense layer as an expression: one dot product per output."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        dot = F.aggregate(F.zip_with(x, F.array(*map(F.lit, row)), lambda a, w: a * w), F.lit(0.0), lambda a, v: a + v)
        out.append(dot + F.lit(b))
    return F.array(*out)


def dot(edge_table: DataFrame, key: str = "claim_id") -> DataFrame:
    """A line of Graphviz text per edge."""
    return edge_table.select(key, F.format_string('%s -> %s [label="%s"];', F.col("src"), F.col("dst"), F.col("kind")).alias("line"))
