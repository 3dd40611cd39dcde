"""Exact dedup by a 128-bit content hash, with a comparison of bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import SPACE, checkpointed, read, spare, text_of


def normalised(text: str = "text") -> Column:
    """The text with each run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are first grouped by (hash128, normalised bytes). The hash leads, and Spark's aggregation
    compares the bytes of texts whose hashes agree, so a collision makes two groups and never one.
    Copies inside a task collapse before the only shuffle that carries texts, so a group that holds
    a third of all rows arrives as one row per task. The second shuffle carries hashes only: each
    row looks its group up by hash128, and where several texts share a hash (collisions) by
    length and SHA-256 among those few.

    Null text is the empty text, and empty texts are copies of each other. The smallest id of a
    group stays; a null id is larger than any other, so it stays only in a group without other ids.
    Rows that repeat an id and its text are one document and get the same answer. Other columns are
    not read, whatever their names. An empty table gives an empty result.
    """
    # repeated scans read one column each; texts cross the network once, in the partial aggregate
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    groups = (
        texts.groupBy(hash128(F.col("norm")).alias("h"), "norm")
        .agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.struct(F.octet_length("norm").alias("n"), F.sha2("norm", 256).alias("sha"), "keep_id", "group_size").alias("g"))
    )
    # the texts of one hash: one, or a few where the hash collides
    # written out, so that the join below is between two plain exchanges and Spark can split a hash
    # that very many rows share
    by_hash = checkpointed(groups.groupBy("h").agg(F.collect_list("g").alias("gs")))
    rows = texts.select("id", hash128(F.col("norm")).alias("h"), F.octet_length("norm").alias("n"), F.sha2("norm", 256).alias("text_sha256"))
    same = F.when(F.size("gs") == 1, F.col("gs")[0]).otherwise(
        F.filter("gs", lambda g: (g["n"] == F.col("n")) & (g["sha"] == F.col("text_sha256")))[0]
    )
    return (
        rows.join(by_hash, "h")
        .select("id", "text_sha256", same.alias("g"))
        .select(
            F.col("id").alias(id_col),
            F.col("g.keep_id").alias("keep_id"),
            F.col("g.group_size").alias("group_size"),
            F.col("id").eqNullSafe(F.col("g.keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that exact_dedup keeps, each once, with all their columns.

    A document is an id with its normalised text, so ids that repeat with other texts, or are null,
    don't take each other's verdicts. Of rows that repeat both one stays.
    """
    named = lambda sha: F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), sha)
    name = spare("_document", docs.columns)
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(named(F.col("text_sha256")).alias(name))
    rows = docs.withColumn(name, named(F.sha2(normalised(text_col), 256)))
    return rows.join(kept, name, "left_semi").dropDuplicates([name]).drop(name)  # the join has dealt rows by name already


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""
