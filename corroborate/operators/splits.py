"""Splits, samples and apportionment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: Column, seed: int) -> Column:
    """A deterministic shuffle: order by this. The same in any engine that has md5."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows, the same at every run. Each task keeps its own n at most."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def pick_one(df: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """Of each group the row that comes first in the seeded order, by a partial minimum."""
    rest = F.struct(seeded_order(F.col(key), seed).alias("_o"), *df.columns)
    return df.groupBy(*by).agg(F.min(rest).alias("x")).select("x.*").drop("_o")


def _ranked(rows: DataFrame, key: str, by: list[Column], seed: int, bits: int = 12) -> DataFrame:
    """Adds _place, from 1, in the seeded order of all rows under the same `by`, and _all, their number.

    One value of `by` may hold most rows, so ranks aren't taken over it at once: the order's first
    bits cut it into cells; ranks are taken inside a cell and shifted by the cells before it.
    """
    shuffled = seeded_order(F.col(key), seed)
    names = [f"_b{i}" for i in range(len(by))]
    celled = rows.select("*", *(c.alias(n) for c, n in zip(by, names, strict=True)), F.conv(F.substring(shuffled, 1, bits // 4), 16, 10).cast("int").alias("_c"))
    sizes = celled.groupBy(*names, "_c").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*names)
    sizes = sizes.select(
        *(F.col(n).alias(f"{n}_") for n in names), F.col("_c").alias("_c_"), F.sum("_n").over(whole).alias("_all"),
        F.coalesce(F.sum("_n").over(whole.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*names, "_c").orderBy(shuffled, key)
    on = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names] + [F.col("_c") == F.col("_c_")]
    joined = celled.withColumn("_r", F.row_number().over(inside)).join(sizes, on)
    return joined.select(*rows.columns, (F.col("_before") + F.col("_r")).alias("_place"), "_all")


def _split_at(n_train: Column, n_dev: Column) -> Column:
    return F.when(F.col("_place") <= n_train, F.lit("train")).when(F.col("_place") <= n_train + n_dev, F.lit("dev")).otherwise(F.lit("test"))


def split_groups(df: DataFrame, group: str, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split; whole groups go to train, dev or test, at least one each to train and dev."""
    ranked = _ranked(df.select(group).distinct(), group, [F.lit(0)], seed)
    share = lambda f: F.greatest(F.lit(1), F.floor(F.col("_all") * f))
    split = ranked.select(F.col(group).alias("_group"), _split_at(share(train), share(dev)).alias("split"))
    return df.join(split, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def stratified_split(df: DataFrame, key: str, label: str, train: float = 0.8, dev: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split; each label is cut at exact shares of its rows in the seeded order."""
    ranked = _ranked(df, key, [F.col(label)], seed)
    share = lambda f: F.floor(F.col("_all") * f)
    return ranked.withColumn("split", _split_at(share(train), share(dev))).drop("_place", "_all")


def apportion(shares: DataFrame, n: int, share: str = "share", order: str = "ord") -> DataFrame:
    """Whole numbers that add up to n by largest remainder; of equal remainders the first in order.

    shares is a plan's short table of templates.
    """
    everything = Window.partitionBy()
    exact = shares.withColumn("_e", F.col(share) / F.sum(share).over(everything) * n).withColumn("_f", F.floor("_e"))
    rest = F.lit(n) - F.sum("_f").over(everything)
    ranked = exact.withColumn("_rest", rest).withColumn("_k", F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_e") - F.col("_f"), 9)), order)))
    return ranked.withColumn("n", (F.col("_f") + (F.col("_k") <= F.col("_rest")).cast("int")).cast("long")).drop("_e", "_f", "_rest", "_k")


def split_of_file(name: Column) -> Column:
    """The split that a file's name tells."""
    low = F.lower(name)
    return F.when(low.contains("train"), F.lit("train")).when(low.rlike("dev|valid|val"), F.lit("dev")).when(low.contains("test"), F.lit("test"))


def sequential_id(dataset: str, split: str, index: Column) -> Column:
    """W5."""
    return F.format_string(f"{dataset}-{split}-%06d", index)


def members(records: DataFrame, index: DataFrame, split: str, key: str = "line_idx") -> DataFrame:
    """Records of a split, by a table (key, split)."""
    return records.join(index.where(F.col("split") == split).select(key), key, "left_semi")
