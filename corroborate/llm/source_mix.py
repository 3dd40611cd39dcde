"""Mixing sources to target weights: blocks of words, drawn per output shard, joined by index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corroborate.llm.common import WORD, checkpointed, map_batches, read, spare, text_of

#: Weights of the sources in order, and the most times that a source may be repeated.
WEIGHTS, CAP = (5, 2, 1), 3
#: Words of a block, output shards, seed of every draw and permutation.
BLOCK, SHARDS, SEED = 128, 64, 17
#: Sources whose targets are found on the driver and that are broadcast, and sources of one draw; more stay a table.
MAX_SOURCES = 10_000
#: Documents of a bucket within which offsets are running sums, and slots that one row unfolds into.
BUCKET_ROWS, SLOT_ROWS = 2_000, 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[float]:
    """Words to take of each source, which are given in order: shares of the sum by weight, where a
    source stops at cap times its size and its excess goes to the others by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    target = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weight[i] for i in free)
        over = {i for i in free if left * weight[i] / total > cap * sizes[i]}
        for i in over or free:
            target[i] = float(cap * sizes[i]) if over else left * weight[i] / total
        free -= over or free
        left -= sum(target[i] for i in over)
    return target


def draw_counts(slots: list[int], shards: int = SHARDS, seed: int = SEED) -> np.ndarray:
    """Blocks of each source in each output shard, (shards, sources).

    Each shard takes its share of the remaining slots by multinomial draws with the remaining slots
    of the sources as weights. What a draw takes beyond a source's rest is drawn again, so the
    columns add up to `slots` exactly.
    """
    rng = np.random.default_rng(seed)
    rest = np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for shard in range(shards):
        need = int(rest.sum()) // (shards - shard)
        while need:
            drawn = np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
            out[shard] += drawn
            rest -= drawn
            need -= int(drawn.sum())
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 chosen by key, at index: a four-round Feistel network over
    the next even number of bits, walked on until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for i in range(4):
            left, right = right, left ^ (_mixed(right + k + np.uint64(i * 0x9E3779B9)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def place_of(value: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The index at which `permuted` has value: the rounds taken back, and the walk too."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2))
    low = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = value.astype(np.uint64), n.astype(np.uint64), key.astype(np.int64).view(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], low[todo], key[todo]
        left, right = x[todo] >> h, x[todo] & m
        for i in reversed(range(4)):
            left, right = right ^ (_mixed(left + k + np.uint64(i * 0x9E3779B9)) & m), left
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


@F.pandas_udf(LongType())
def _place_at(block: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(place_of(block.to_numpy(), n.to_numpy(), key.to_numpy()))


@F.pandas_udf(LongType())
def _block_at(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, doc_id, source, size, h) of each row, written out: texts are read once."""
    return checkpointed(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(text_col).alias("h"),
        )
    )


def _run_key(run: Column) -> Column:
    """The key of the permutation of a source's blocks in one of its runs."""
    return F.xxhash64("s", run.cast("long"), F.lit(SEED))


def _with_targets(by_source: DataFrame) -> DataFrame:
    """`targets` for any number of sources (source, size, n), as a table; s is the place in order.

    A source stops at its cap if its share by weight is over it. The level (words per weight) of
    the others only rises from round to round, so each round is one aggregate.
    """
    placed = by_source.orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex().map(lambda x: (x[1], *x[0]))
    rows = checkpointed(by_source.sparkSession.createDataFrame(placed, "s int, source string, size long, n long"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    total = rows.agg(F.sum("size")).first()[0]
    level, stopped = 0.0, -1
    while True:
        over = F.lit(level) * weight > CAP * F.col("size")
        n, words, free = rows.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, CAP * F.col("size"))), F.lit(0)), F.sum(F.when(~over, weight))).first()
        if n == stopped or not free:
            break
        level, stopped = (total - words) / free, n
    return rows.withColumn("target", F.when(over, CAP * F.col("size")).otherwise(F.lit(level) * weight).cast("double"))


def _sources(sized: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """(s, source, source_size, target, n_docs, n_blocks, n_slots, last), and whether they are few; s is
    the place in code-point order, last the words that the last slot takes of its block."""
    by_source = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    few = by_source.count() <= MAX_SOURCES
    if few:
        rows = sorted(by_source.collect(), key=lambda r: (r.source is None, r.source or ""))
        found = [(s, r.source, r["size"], r["n"], t) for s, (r, t) in enumerate(zip(rows, targets([r["size"] for r in rows]), strict=True))]
        sources = sized.sparkSession.createDataFrame(found, "s int, source string, size long, n long, target double")
    else:
        sources = _with_targets(by_source)
    words, whole = F.round("target").cast("long"), F.greatest("size", F.lit(1))
    sources = sources.select(
        "s", "source", F.col("size").alias("source_size"), "target", F.col("n").alias("n_docs"), F.ceil(F.col("size") / block).cast("long").alias("n_blocks"),
        F.floor(words / whole).cast("long").alias("runs"), (words % whole).alias("rest"),
    )
    # of the last run, the blocks up to the one in which the target is reached; the source's last block is shorter
    sources = sources.withColumn("short_at", _place_at(F.greatest(F.col("n_blocks") - 1, F.lit(0)), F.greatest("n_blocks", F.lit(1)), _run_key(F.col("runs"))))
    upto = lambda k: k * block - F.when(F.col("short_at") < k, F.col("n_blocks") * block - F.col("source_size")).otherwise(0)
    k = F.ceil(F.col("rest") / block).cast("long")
    extra = F.when(upto(k) >= F.col("rest"), k).otherwise(k + 1)
    sources = sources.withColumn("extra", extra).withColumn("last", F.when(F.col("rest") > 0, F.col("rest") - upto(F.col("extra") - 1)))
    return checkpointed(sources.withColumn("n_slots", F.col("runs") * F.col("n_blocks") + F.col("extra")).drop("runs", "rest", "short_at", "extra")), few


def _beside(sources: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(sources) if few else sources


def _laid_out(sized: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Adds each row's first word in its source's sequence of words.

    Within a source, rows stand in hash order. Running sums are taken inside buckets of about
    BUCKET_ROWS rows, and over the buckets' sums, so no task holds all rows of a large source.
    """
    sources = sources.drop("n_slots", "last")
    rows = sized.join(_beside(sources, few), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    mixed = F.xxhash64("doc_id", "h", F.lit(SEED))  # spreads repeated and null ids too
    rows = rows.withColumn("bucket", F.pmod(mixed, F.floor(F.col("n_docs") / BUCKET_ROWS) + 1)).withColumn("o", mixed)
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = rows.groupBy("s", "bucket").agg(F.sum("size").alias("n")).select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("o", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("upto", F.sum("size").over(inside))
        .join(buckets, ["s", "bucket"])
        .withColumn("first", F.col("base") + F.col("upto") - F.col("size"))
        .drop("bucket", "o", "base", "upto")
    )


def _taken_blocks(sources: DataFrame, few: bool, block: int, shards: int) -> DataFrame:
    """(s, block, lo, hi, times): how often the slots of all output shards take words lo..hi of a block."""

    def drawn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("s")
        counts = draw_counts(rows["n_slots"].tolist(), shards)
        first = np.cumsum(counts, axis=0) - counts
        shard, at = np.nonzero(counts)
        return pd.DataFrame({"shard": shard, "s": rows["s"].to_numpy()[at], "n": counts[shard, at], "first": first[shard, at]})

    groups = sources.select("s", "n_slots").groupBy(F.floor(F.col("s") / MAX_SOURCES))  # each draws for its own sources
    pieces = groups.applyInPandas(drawn, "shard int, s int, n long, first long").select(
        "shard", "s", "n", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOT_ROWS))).alias("piece")
    )
    begin = F.col("piece") * SLOT_ROWS
    slots = pieces.repartition("shard", "s", "piece").select(
        "s", F.explode(F.sequence(F.col("first") + begin, F.col("first") + F.least(begin + SLOT_ROWS, F.col("n")) - 1)).alias("slot")
    )
    slots = slots.join(_beside(sources.select("s", "n_blocks", "n_slots", "last"), few), "s")
    # a source's slots run through its blocks again and again, each time in another order
    key = _run_key(F.floor(F.col("slot") / F.col("n_blocks")))
    part = F.when(F.col("slot") == F.col("n_slots") - 1, F.col("last"))  # the last slot takes what is left of the target
    taken = slots.select("s", _block_at(F.col("slot") % F.col("n_blocks"), "n_blocks", key).alias("block"), part.alias("part"))
    taken = taken.groupBy("s", "block").agg(F.count("*").alias("times"), F.max("part").alias("part"))
    of = lambda lo, hi, times: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), times.cast("long").alias("times"))
    zero, all_, times = F.lit(0), F.lit(block), F.col("times")
    split = F.when(F.col("part").isNull(), F.array(of(zero, all_, times))).otherwise(F.array(of(zero, F.col("part"), times), of(F.col("part"), all_, times - 1)))
    return taken.select("s", "block", F.inline(split))


def _pieces(laid: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """A row per document and block that it has words in, joined by index: words begin..end of the
    document are taken `times` times (null: never). A document without words has one row."""
    last = F.floor((F.col("first") + F.col("size") - 1) / block)
    held = laid.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), last))).alias("block"))
    held = held.join(blocks, ["s", "block"], "left")
    at = F.col("block") * block - F.col("first")
    begin = F.greatest(at + F.coalesce("lo", F.lit(0)), F.lit(0))
    end = F.least(at + F.coalesce("hi", F.lit(block)), F.col("size"))
    return held.withColumn("begin", begin).withColumn("end", end).where("size = 0 or begin < end").drop("lo", "hi")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shards: int = SHARDS
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words the mix takes of it).

    The words of a source, its documents in hash order, are packed into blocks of `block` words.
    The target of a source, in blocks, is dealt to the output shards by multinomial draws. Its
    slots are numbered through all shards; slot q takes block perm(q mod n) of its n blocks, with
    a new permutation for each run through them, so no block is taken more than CAP times, and a
    document neither. The last slot takes the beginning of its block up to the target, so a source
    lands within a word of it, however small. Documents and slots meet in a join on (source, block): a source with a third
    of all rows is spread over all tasks like any other. Up to MAX_SOURCES sources
    are broadcast; more are joined like any table, and shards draw for each MAX_SOURCES of them.

    A null text has no words, and a document without words takes none. A null source is a source
    of its own, last in order. Repeated rows are documents of their own; null ids are allowed. Ties
    in hash order are broken by id, size and place. Other columns are not read. An empty table gives
    an empty result. The same rows give the same mix at every run.
    """
    _, laid, blocks = _planned(docs, id_col, text_col, source_col, block, shards)
    return (
        _pieces(laid, blocks, block)
        .groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum(F.coalesce((F.col("end") - F.col("begin")) * F.col("times"), F.lit(0))).cast("long").alias("taken"))
        .select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")
    )


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, shards: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    sized = _sized(docs, id_col, text_col, source_col)
    sources, few = _sources(sized, block)
    return sized, _laid_out(sized, sources, few), _taken_blocks(sources, few, block, shards)


def _cut(columns: list[str], text_col: str, taken_col: str):
    """mapInArrow function: rows with their pieces in the last column -> a row for each time that words of it are taken."""
    word = re.compile(WORD)

    def texts(text: str, pieces: list[dict]) -> Iterator[str]:
        starts = [m.start() for m in word.finditer(text)]
        starts[:1], at_end = [0], len(starts)
        for copy in range(1, max(p["times"] for p in pieces) + 1):
            yield "".join(text[starts[p["begin"]] : len(text) if p["end"] == at_end else starts[p["end"]]] for p in pieces if p["times"] >= copy)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, made = [], []
            for i, (text, pieces) in enumerate(zip(b.column(text_col).to_pylist(), b.column(taken_col).to_pylist(), strict=True)):
                for t in texts(text, pieces):
                    place.append(i)
                    made.append(t)
            out = pa.Table.from_batches([b]).take(pa.array(place, pa.int64())).select(columns)
            out = out.set_column(columns.index(text_col), text_col, pa.array(made, pa.string()))
            if "n_chars" in columns:
                at = columns.index("n_chars")
                out = out.set_column(at, "n_chars", pa.array([len(t) for t in made]).cast(out.schema.field(at).type))
            yield from out.combine_chunks().to_batches()

    return each


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, shards: int = SHARDS
) -> DataFrame:
    """The mix itself, with the columns of docs: per document one row for each time that words of it
    are taken, its text those words with the white space after them, its n_chars their length.

    A document whose words are all taken comes back as it is; one of which nothing is taken, or
    that has no words, is not in the mix. See mix_sources for the rest.
    """
    sized, laid, blocks = _planned(docs, id_col, text_col, source_col, block, shards)
    same = ["doc_id", "source", "h"]
    names = [spare(f"_{c}", docs.columns) for c in (*same, "copy")]
    nth, pieces = spare("_nth", docs.columns), spare("_pieces", docs.columns)
    taken = (
        _pieces(laid, blocks, block)
        .where("times > 0")
        .groupBy("row", *same)
        .agg(F.array_sort(F.collect_list(F.struct("begin", "end", "times"))).alias("taken"))
        .withColumn("copy", F.row_number().over(Window.partitionBy(*same).orderBy("row")))
        .select(*(F.col(c).alias(n) for c, n in zip((*same, "copy"), names, strict=True)), F.col("taken").alias(pieces))
    )
    own: list[Column] = [F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.xxhash64(text_col)]
    # rows that repeat id, source and text are told apart by a number; without such rows texts aren't moved for it
    repeats = not sized.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    numbered = docs.withColumn(nth, F.row_number().over(Window.partitionBy(*own).orderBy(F.lit(1))) if repeats else F.lit(1))
    both = numbered.join(taken, [a.eqNullSafe(taken[b]) for a, b in zip([*own, F.col(nth)], names, strict=True)]).select(*docs.columns, pieces)
    return map_batches(both, _cut(docs.columns, text_col, pieces), docs.schema)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
