"""Byte-level BPE over documents of any length: overlapping chunks, stitched where boundaries agree."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.llm.common import map_batches, read, text_of

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of a chunk, and of its overlap with each neighbour.
CHUNK, OVERLAP = 32_768, 512


#: Runs of white space from this length on overflow the stack of the library's pattern matcher.
LONG_SPACE = regex.compile(r"\s{2000}")


@lru_cache(maxsize=4)
def _table(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, dict[bytes, int]]:
    """The merge table of a rank file, for the pre-tokens of a pattern, and its ranks. A worker makes what it needs only."""
    table = _table(ranks)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), table


@lru_cache(maxsize=4)
def _by_id(ranks: bytes) -> list[bytes]:
    """The bytes of each id."""
    table = _table(ranks)
    by_id = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        by_id[rank] = token
    return by_id


def _bytes_of(ids: bytes, by_id: list[bytes]) -> bytes:
    return b"".join(map(by_id.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def boundaries(text: str, pattern: str) -> list[int]:
    """Ends of the pre-tokens of a piece of text, without its own end, which what follows may move."""
    ends = [m.end() for m in regex.finditer(pattern, text)]
    return [e for e in ends if e < len(text)]


def _ids(text: str, ranks: bytes, pattern: str) -> bytes:
    if LONG_SPACE.search(text):
        single, _ = _encoding(ranks, "(?s:.+)")
        return b"".join(np.array(single.encode_ordinary(m.group()), "<u4").tobytes() for m in regex.finditer(pattern, text))
    return _encoding(ranks, pattern)[0].encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _encode_batches(ranks: Broadcast, pattern: str, back: bool):
    """mapInArrow function: the last column, a text, becomes its ids in little-endian 32-bit form, and with
    `back` the bytes that these decode to as well."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_ids(t, ranks.value, pattern) for t in b.columns[-1].to_pylist()]
            made = [ids, [_bytes_of(x, _by_id(ranks.value)) for x in ids]] if back else [ids]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(x, pa.binary()) for x in made)], [*b.schema.names[:-1], *("ids", "decoded")[: len(made)]])

    return each


def _split(chunk: int, overlap: int):
    """mapInArrow function: (row, doc_id, text) -> a row for each chunk, with its overlaps."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                starts = range(0, len(text), chunk)
                for some in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    parts = [text[max(0, s - overlap) : s + chunk + overlap] for s in some]
                    columns = [[row] * len(some), [doc] * len(some), [s // chunk for s in some], [max(0, s - overlap) for s in some], parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)],
                        ["row", "doc_id", "k", "at", "text"],
                    )

    return each


def _pretokenise(chunk: int, overlap: int, pattern: str):
    """mapInArrow function: adds the boundaries (positions in the document) in either overlap."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = [], []
            for k, at, text in zip(*(b.column(c).to_pylist() for c in ("k", "at", "text")), strict=True):
                ends = [at + e for e in boundaries(text, pattern)]
                left.append([e for e in ends if abs(e - k * chunk) <= overlap and k])
                right.append([e for e in ends if abs(e - (k + 1) * chunk) <= overlap])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(left, kind), pa.array(right, kind)], [*b.schema.names, "left", "right"])

    return each


def _stitch(chunks: DataFrame, chunk: int) -> DataFrame:
    """Chunks with boundaries -> (row, doc_id, seg, text): slices that start and end at pre-tokens.

    Neighbours that share a boundary in their overlap agree on all that follows it, so the first
    shared boundary is a cut, if the left one was itself in step. From a chunk without a cut on,
    slices join the segment before them: it is then encoded in one go, which is exact as well.
    """
    order = Window.partitionBy("row").orderBy("k")
    found = F.array_min(F.array_intersect(F.lag("right").over(order), F.col("left")))
    stitched = (
        chunks.withColumn("cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(found))
        .withColumn("in_step", F.min(F.col("cut").isNotNull()).over(order))
        .withColumn("begin", F.when(F.col("in_step"), F.col("cut")).otherwise(F.col("k") * chunk))
        .withColumn("end", F.lead("begin").over(order))
        .withColumn("seg", F.sum(F.col("in_step").cast("int")).over(order))
    )
    end = F.coalesce("end", F.col("at") + F.length("text"))
    piece = F.substring(F.col("text"), (F.col("begin") - F.col("at") + 1).cast("int"), (end - F.col("begin")).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("k", piece.alias("text"))))
    return stitched.groupBy("row", "doc_id", "seg").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def _ranks(spark: SparkSession, path: str | None) -> Broadcast:
    """The rank file, under 1 MB, read once where the job starts and sent along with it."""
    return spark.sparkContext.broadcast(Path(path or public_tokenizers.path(RANKS)).read_bytes())


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks_path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    back: bool = False,
) -> DataFrame:
    """(doc_id, ids) for each row, with `back` and decoded, the bytes of its ids (as decode makes them, but
    by the worker that has the ids, so that a task needs one worker); ids is binary, one little-endian unsigned 32-bit number per token.

    A text of up to `chunk` characters is one piece and is encoded where it is read, without a
    shuffle. A longer one becomes overlapping chunks, dealt out over the cluster and pre-tokenised
    in parallel; stitching finds the cuts (see _stitch), the pieces between them are dealt out
    again and encoded, and their ids are put together in order. Whole texts are encoded, each
    pre-token separately, without special tokens.

    Null counts as the empty text, which has no ids. Repeated rows, repeated or null ids are
    encoded each on their own: pieces carry their row's number, not its id. Other columns are not
    read. An empty table gives an empty result.
    """
    ranks = _ranks(docs.sparkSession, ranks_path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    each, made = _encode_batches(ranks, pattern, back), ("ids", "decoded") if back else ("ids",)
    kinds = ", ".join(f"{c} binary" for c in made)
    short = map_batches(rows.where(F.length("text") <= chunk), each, f"doc_id long, {kinds}")
    chunks = (
        rows.where(F.length("text") > chunk)
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(_split(chunk, overlap), "row long, doc_id long, k long, at long, text string")
        .repartition("row", "k")
        .mapInArrow(_pretokenise(chunk, overlap, pattern), "row long, doc_id long, k long, at long, text string, left array<long>, right array<long>")
    )
    pieces = _stitch(chunks, chunk).repartition("row", "seg").mapInArrow(each, f"row long, doc_id long, seg long, {kinds}")
    parts = F.array_sort(F.collect_list(F.struct("seg", *made)))
    whole = lambda c: F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x[c])), "")).alias(c)
    long = pieces.groupBy("row", "doc_id").agg(parts.alias("parts")).select("doc_id", *map(whole, made))
    return short.unionByName(long).withColumnRenamed("doc_id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", ranks_path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encoded with a binary column `decoded`: the bytes of each row's ids, one after the other."""
    ranks = _ranks(encoded.sparkSession, ranks_path)
    at = encoded.columns.index(ids_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = _by_id(ranks.value)
        for b in batches:
            texts = [None if ids is None else _bytes_of(ids, by_id) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    return map_batches(encoded, each, encoded.withColumn("decoded", F.col(ids_col)).schema)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of ids and of what they decode to: id, n_tokens, ids_sha256, decoded_sha256 for each row."""
    both = encode(docs, id_col, text_col, back=True)
    return both.select(
        id_col,
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))
