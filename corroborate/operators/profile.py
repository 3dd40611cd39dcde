"""Profiles of a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distributions(df: DataFrame, dims: dict[str, Column], split: Column | None = None) -> DataFrame:
    """(dim, key, n) for several columns at once, by split if one is given; array columns count each entry.

    One pass: a row becomes a pair per dimension, and equal pairs meet in the partial aggregate.
    """
    def pairs(name: str, c: Column) -> Column:
        values = (c if df.select(c.alias("c")).schema[0].dataType.typeName() == "array" else F.array(c)).cast("array<string>")
        values = F.coalesce(values, F.array().cast("array<string>"))  # a null list has no entries
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("dim"), F.coalesce(v, F.lit("null")).alias("key")))

    every = F.concat(*(pairs(n, c) for n, c in dims.items()))
    by = [] if split is None else [split.alias("split")]
    return df.select(*by, F.explode(every).alias("x")).groupBy(*(["split"] if by else []), "x.dim", "x.key").agg(F.count("*").alias("n"))


def unique_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """The labels that occur, in order."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label)


def with_label(df: DataFrame, value: str, label: str = "label") -> DataFrame:
    """One label's part of a table; written tables are better partitioned by the label."""
    return df.where(F.col(label) == value)


def split_profile(records: DataFrame) -> DataFrame:
    """(split, dim, key, n) of v3.0 records: sources, verdicts, and modalities, stances and types of
    their items, in one pass."""
    split = F.coalesce("provenance.split", F.lit("null"))
    types = lambda e: F.coalesce(e["evidence_types"], F.array().cast("array<string>"))
    dims = {
        "source": F.col("provenance.dataset"), "verdict": F.col("verdict.label"), "modality": F.transform("evidence", lambda e: e["modality"]),
        "stance": F.transform("evidence", lambda e: e["stance"]), "type": F.flatten(F.transform("evidence", types)),
    }
    return distributions(records, dims, split)


def split_averages(records: DataFrame) -> DataFrame:
    """Per split the records, and the averages of items with a text and of claim triples."""
    texts = F.size(F.filter(F.coalesce("evidence", F.array()), lambda e: F.trim(F.coalesce(e["text"], F.lit(""))) != ""))
    triples = F.coalesce(F.size("claim_triples"), F.lit(0))
    average = lambda c: F.round(F.sum(c) / F.count("*"), 2)
    return records.groupBy(F.coalesce("provenance.split", F.lit("null")).alias("split")).agg(
        F.count("*").alias("n"), average(texts).alias("avg_evidence"), average(F.when(F.col("claim_triples").isNull(), 0).otherwise(triples)).alias("avg_triples")
    )


def with_share(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Adds the share of the group's total, from counts (already aggregated)."""
    return counts.withColumn("share", F.round(F.col(n) / F.sum(n).over(Window.partitionBy(*by)), 4))


def imbalanced(counts: DataFrame, by: list[str], limit: float = 0.70) -> DataFrame:
    """Keys with more than the limit of their dimension."""
    return with_share(counts, by).where(F.col("share") > limit)


def readiness(df: DataFrame, evidence: Column, triples: Column) -> DataFrame:
    """Rows, rows without evidence or triples, averages per row."""
    n = F.count("*")
    return df.agg(
        n.alias("n"),
        F.count_if(F.coalesce(evidence, F.lit(0)) == 0).alias("n_zero_evidence"),
        F.count_if(F.coalesce(triples, F.lit(0)) == 0).alias("n_zero_triples"),
        F.round(F.coalesce(F.try_divide(F.sum(evidence), n), F.lit(0.0)), 2).alias("avg_evidence"),
        F.round(F.coalesce(F.try_divide(F.sum(triples), n), F.lit(0.0)), 2).alias("avg_triples"),
    )


def against_targets(counts: DataFrame, targets: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(key, n) against (key, target in percent): actual percent, difference, whether within tolerance."""
    shared = counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))
    joined = targets.join(shared, "key", "left").withColumn("pct", F.round(F.coalesce("pct", F.lit(0.0)), 2))
    delta = F.round(F.col("pct") - F.col("target"), 2)
    return joined.select("key", F.coalesce("n", F.lit(0)).alias("n"), "target", "pct", delta.alias("delta"), (F.abs(delta) <= tolerance).alias("ok"))


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles (interpolated, exact), most."""
    q = [F.percentile(value, p) for p in (0.25, 0.5, 0.75)]
    r = lambda c: F.round(c, 4)
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), r(F.avg(value)).alias("mean"), r(F.stddev_samp(value)).alias("std"), F.min(value).alias("least"),
        r(q[0]).alias("q1"), r(q[1]).alias("median"), r(q[2]).alias("q3"), F.max(value).alias("most"),
    )


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Rows in bins of equal width, by the lower edge."""
    return df.where(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).alias("edge")).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of the column's values for each row value, in one partial aggregate."""
    return df.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values))


def most_frequent(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """O1: the n most frequent values; equal counts in order of the value."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def dominance(counts: DataFrame, by: str, key: str, limit: float = 0.75) -> DataFrame:
    """Groups of more than one class whose largest has the limit or more."""
    each = counts.groupBy(by).agg(F.max_by(key, F.struct("n", key)).alias(key), F.max("n").alias("top"), F.sum("n").alias("total"), F.count("*").alias("classes"))
    return each.where((F.col("classes") > 1) & (F.col("top") / F.col("total") >= limit)).select(by, key, F.round(F.col("top") / F.col("total"), 4).alias("share"))


def search(df: DataFrame, contains: dict[str, str] | None = None, equals: dict[str, str] | None = None, prefix: dict[str, str] | None = None, one_of: dict[str, tuple] | None = None, between: dict[str, tuple[float, float]] | None = None, any_contains: tuple[tuple[str, ...], str] | None = None) -> DataFrame:
    """Conjunction of the given conditions; an empty value is no condition."""
    found = [F.lower(F.col(c)).contains(v.lower()) for c, v in (contains or {}).items() if v]
    found += [F.col(c) == v for c, v in (equals or {}).items() if v]
    found += [F.col(c).startswith(v) for c, v in (prefix or {}).items() if v]
    found += [F.col(c).isin(*v) for c, v in (one_of or {}).items() if v]
    found += [F.col(c).between(*v) for c, v in (between or {}).items() if v]
    if any_contains and any_contains[1]:
        found.append(reduce(Column.__or__, (F.lower(F.col(c)).contains(any_contains[1].lower()) for c in any_contains[0])))
    return df.where(reduce(Column.__and__, found)) if found else df
