"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

The rows of a shard are sorted once by each dimension. A query reads these lists from the end that
its own component favours, all to the same depth; each row met anywhere is scored in full. No row
that is still unmet can score more than the components at the current depth give together, so the
query stops once that bound is under its kth score. Depths double. The round after one that leaves
a share of the rows met reads the lists to their ends, so that all rows are met; queries that come
to this last round go through it together, as one matrix product.

How early a query stops depends on the vectors: at once where few components are large, and not
before the last round where many independent components are alike, as in isotropic embeddings.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import read

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Candidates of a shard and queries of a block, about; a pair of the two is a task's work.
SHARD, BLOCK = 16_384, 8_192
#: Candidates that a shard has at least, about, when shards are made for more tasks.
LEAST_SHARD = 1_024
#: First depth of the lists, and the share of rows met after which a round reads them to their ends.
DEPTH, SHARE = 16, 0.25
#: Squared length, in units of the integers, up to which all inner products fit a long.
LONGEST = 2.0**62


def integers(vectors: pa.ChunkedArray, n: int) -> np.ndarray:
    """n vectors of one dimension as floor(SCALE * x), one row each."""
    flat = pa.concat_arrays([c.flatten() for c in vectors.chunks]) if vectors.num_chunks else pa.array([], pa.float64())
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * values).astype(np.int64).reshape(n, -1 if len(values) else 0)


class SortedLists:
    """A shard's rows in the order of their ids, and their order by each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        self.ids = ids[by_id]
        self.x = x[by_id]
        self.order = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(self.x, self.order, 0)
        self.longest = float(np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
        self._real = self.x.astype(np.float64)

    def rows_for(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and queries to multiply: doubles where these hold every sum exactly, else longs."""
        lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=-1).max(initial=0))
        return (self._real, queries.astype(np.float64)) if lengths * self.longest < 2.0**52 else (self.x, queries)

    def own(self, query_id: int) -> int:
        """The row with the query's own id, or -1."""
        at = int(np.searchsorted(self.ids, query_id))
        return at if at < len(self.ids) and self.ids[at] == query_id else -1

    def by_threshold(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray] | None:
        """(rows, scores) of the k best once the bound is under the kth, or None if the last round is due."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        rising = q[dims] < 0  # a negative component favours the least values
        rows, real = self.rows_for(q)
        met = np.zeros(n, bool)
        if own >= 0:
            met[own] = True
        best, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, read_to = DEPTH, 0
        while read_to < n:
            upto = min(depth, n)
            low, high = self.order[read_to:upto, dims[rising]], self.order[n - upto : n - read_to, dims[~rising]]
            new = np.zeros(n, bool)
            new[low] = True
            new[high] = True
            new &= ~met
            met |= new
            at = np.flatnonzero(new)
            best, scores = _kept(np.concatenate([best, at]), np.concatenate([scores, (rows[at] @ real).astype(np.int64)]), k)
            bound = int(self.values[upto - 1, dims[rising]] @ q[dims[rising]] + self.values[n - upto, dims[~rising]] @ q[dims[~rising]])
            if len(best) == k and bound < scores[-1]:
                return best, scores
            if met.sum() > SHARE * n:
                return None
            read_to, depth = upto, 2 * depth
        return None

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) of each query's k best, its own id left out; ties go to the smaller id."""
        found = [self.by_threshold(q, self.own(i), k) for i, q in zip(query_ids.tolist(), queries, strict=True)]
        rest = [at for at, f in enumerate(found) if f is None]  # their last round: all rows are met
        rows, real = self.rows_for(queries)
        some = max(1, 2**21 // max(len(self.ids), 1))
        for part in (rest[i : i + some] for i in range(0, len(rest), some)):
            for at, scores in zip(part, (real[part] @ rows.T).astype(np.int64), strict=True):
                own = self.own(int(query_ids[at]))
                others = np.delete(np.arange(len(scores)), own) if own >= 0 else np.arange(len(scores))
                found[at] = _kept(others, scores[others], k)
        return found


def _kept(rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the highest scores, the smaller row first among equals."""
    if len(rows) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= least], scores[scores >= least]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]


def _usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component, and no longer than LONGEST."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf))
    length = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.abs(SCALE * x.cast("double")) + 1, 2))
    return vector.isNotNull() & fine & (length < LONGEST)


def _one_each(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): usable rows with an id; of those that share it, the least vector."""
    usable = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    return usable.groupBy("id").agg(F.min("v").alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k candidates with the highest integer inner product.

    A candidate with the query's own id is no candidate of it; ties go to the smaller id; a query
    with fewer than k candidates has them all, and one without any has no row. Components count as
    floor(256 * x). Vectors that are null, or hold a null or non-finite component, or are so long that
    an inner product may not fit a long, take no part, nor do rows without an id. Vectors of
    different dimensions don't meet. Of rows that share an id the least vector counts. Other columns
    are not read. Empty tables give an empty result.

    Candidates are dealt to shards and queries to blocks by their ids; each shard meets each block in
    one task, whose size does not grow with the tables, and hands on k rows for each query.
    """
    spark = candidates.sparkSession
    n, n_queries = candidates.count(), queries.count()
    n_shards = max(1, math.ceil(n / SHARD), min(math.ceil(n / LEAST_SHARD), 2 * spark.sparkContext.defaultParallelism))
    n_blocks = max(1, math.ceil(n_queries / BLOCK))
    own = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = _one_each(candidates, id_col, vector_col).select("id", "v", F.size("v").alias("dim"), own(n_shards, 1).alias("shard"), each(n_blocks).alias("block"))
    right = _one_each(queries, id_col, vector_col).select("id", "v", F.size("v").alias("dim"), each(n_shards).alias("shard"), own(n_blocks, 2).alias("block"))
    keys = ["dim", "shard", "block"]

    def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not (rows.num_rows and asked.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        lists = SortedLists(rows["id"].to_numpy(), integers(rows["v"], rows.num_rows))
        query_ids = asked["id"].to_numpy()
        found = lists.search(query_ids, integers(asked["v"], asked.num_rows), k)
        at = np.concatenate([f[0] for f in found]).astype(np.int64)
        return pa.table({"query_id": np.repeat(query_ids, [len(f[0]) for f in found]), "vec_id": lists.ids[at], "score": np.concatenate([f[1] for f in found]).astype(np.int64)})

    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP12_SQL = """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM rows q, rows c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
