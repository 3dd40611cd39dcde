"""Cross-tokenizer alignment: byte offsets where two tokenizers both end a token cut a text into groups.

Tokens of A and B are placed by the running sums of their lengths in bytes (`cumsum`); ends that both
have (`intersect1d`) are the cuts; `searchsorted` gives each token the group that it lies in; and
`repeat` expands the tokens that end at a cut into links, every A token there with every B token.
All of that is done for the texts of a batch at once, laid end to end.

Two tokens that end together are one a suffix of the other, byte by byte. So which id pairs can ever
be linked follows from the two vocabularies alone (`linkable`), whatever the corpus: a few hundred
thousand pairs. Per-task counts, the table of counts and what is broadcast are bounded by that.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.bpe import LONG_SPACE
from corroborate.llm.common import map_batches, read, shared_folder, text_of

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text whose tokens are laid end to end at once; a longer text goes alone.
STEP_BYTES = 1_000_000
#: Parts that the counts of a pair are first summed in.
SALTS = 8


class Links(NamedTuple):
    """Groups and links of two token sequences over the same bytes; places count from 0."""

    cuts: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _at_cuts(cuts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's group; the tokens that end at a cut, in order, and how many do at each cut."""
    group = np.searchsorted(cuts, ends)
    inside = group < len(cuts)
    at = np.flatnonzero(cuts[group] == ends) if inside.all() else np.flatnonzero(inside)[cuts[group[inside]] == ends[inside]]
    return group, at, np.bincount(group[at], minlength=len(cuts))


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Links:
    """Cuts, each token's group, and links as places of A and of B, in order.

    Ends never fall; a token without bytes ends where its predecessor does, and is linked there too.
    """
    rising = bool((ends_a[1:] > ends_a[:-1]).all() and (ends_b[1:] > ends_b[:-1]).all())
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=rising)
    (group_a, at_a, n_a), (group_b, at_b, n_b) = _at_cuts(cuts, ends_a), _at_cuts(cuts, ends_b)
    each = n_a * n_b
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    width = np.repeat(n_b, each)
    link_a = at_a[np.repeat(np.cumsum(n_a) - n_a, each) + within // width]
    link_b = at_b[np.repeat(np.cumsum(n_b) - n_b, each) + within % width]
    return Links(cuts, group_a, group_b, link_a, link_b)


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: itself, or one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Byte-level BPE of a tokenizers JSON file, over a space and the text.

    The merges of the file are in the order of the ids that they make, so the ids are ranks, and the
    rank library gives the same ids as the file's own library, faster (tests compare the two). A file
    of another kind raises ValueError.
    """

    def __init__(self, content: bytes) -> None:
        made = json.loads(content)
        letters = _byte_letters()
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        special = {t["content"] for t in made["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if made["normalizer"] or made["pre_tokenizer"].get("type") != "ByteLevel" or [vocab["".join(p)] for p in pairs] != list(range(256, 256 + len(pairs))):
            raise ValueError("not a byte-level BPE file with merges in the order of their ids")
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.lengths = np.array(list(map(len, self.tokens)))
        pattern = public_tokenizers.PATTERN
        self._text, self._single = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, "(?s:.+)"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(" " + t) for t in texts]

    def _ids(self, text: str) -> list[int]:
        if not LONG_SPACE.search(text):
            return self._text.encode_ordinary(text)
        return [i for piece in regex.findall(public_tokenizers.PATTERN, text) for i in self._single.encode_ordinary(piece)]


class Pieces:
    """BPE over pieces with byte fallback of a sentencepiece model, which puts a space before the text."""

    def __init__(self, content: bytes) -> None:
        self._model = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self._model.get_piece_size()
        self.tokens = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self._model.id_to_piece, range(n)))]
        self.lengths = np.array(list(map(len, self.tokens)))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """a_id * len(b) + b_id, sorted, of every pair of which one token's bytes end with the other's."""
    by_a: dict[bytes, list[int]] = {}
    by_b: dict[bytes, list[int]] = {}
    for tokens, by in ((a, by_a), (b, by_b)):
        for i, t in enumerate(tokens):
            by.setdefault(t, []).append(i)
    found = {i * len(b) + j for i, t in enumerate(a) for k in range(len(t)) for j in by_b.get(t[k:], ())}
    found |= {i * len(b) + j for j, t in enumerate(b) for k in range(len(t)) for i in by_a.get(t[k:], ())}
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=2)
def _loaded(a_file: bytes, b_file: bytes) -> tuple[ByteLevel, Pieces, np.ndarray]:
    a, b = ByteLevel(a_file), Pieces(b_file)
    return a, b, linkable(a.tokens, b.tokens)


class Aligned(NamedTuple):
    """Token ids of some texts end to end, their links, and where each text starts in tokens, links and groups."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    links: Links
    start_a: np.ndarray
    start_b: np.ndarray
    start_link: np.ndarray
    start_group: np.ndarray


def align_texts(texts: list[str], a: ByteLevel, b: Pieces) -> Aligned:
    """Tokens and links of some texts. Empty texts, and texts whose joined A or B tokens are not the
    bytes of a space and the text, have no tokens."""
    rows_a, rows_b = a.encode(texts), b.encode(texts)
    for k, t in enumerate(texts):
        raw = (" " + t).encode()
        if not t or b"".join(map(a.tokens.__getitem__, rows_a[k])) != raw or b"".join(map(b.tokens.__getitem__, rows_b[k])) != raw:
            rows_a[k], rows_b[k] = [], []
    start_a, start_b = (np.cumsum([0, *map(len, rows)]) for rows in (rows_a, rows_b))
    ids_a, ids_b = (np.fromiter(chain.from_iterable(rows), np.int64, n[-1]) for rows, n in ((rows_a, start_a), (rows_b, start_b)))
    sums_a = np.cumsum(np.concatenate([[0], a.lengths[ids_a]]))
    nth = np.arange(len(texts))  # a gap of one before each text keeps the ends of texts apart
    ends_a = sums_a[1:] + np.repeat(nth, np.diff(start_a))
    ends_b = np.cumsum(b.lengths[ids_b]) + np.repeat(nth, np.diff(start_b))
    links = align(ends_a, ends_b)
    begins = sums_a[start_a] + np.arange(len(texts) + 1)
    return Aligned(ids_a, ids_b, links, start_a, start_b, np.searchsorted(links.link_a, start_a), np.searchsorted(links.cuts, begins))


@lru_cache(maxsize=8)
def _names(n: int, end: bytes) -> list[bytes]:
    return [b"%d%b" % (i, end) for i in range(n)]


def group_texts(x: Aligned, a: ByteLevel, b: Pieces) -> list[bytes]:
    """For each text `a1,a2|b1;a3|b2,b3`: A's ids and B's ids of its groups, in order."""
    n_a, n_b = len(x.ids_a), len(x.ids_b)
    if not n_a:
        return [b""] * (len(x.start_a) - 1)
    size_a, size_b = len(a.tokens), len(b.tokens)
    names = [*_names(size_a, b","), *_names(size_a, b"|"), *_names(size_b, b","), *_names(size_b, b";")]
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (x.links.group_a, x.links.group_b))
    code = np.empty(n_a + n_b, np.int64)
    # a token stands behind the earlier ones of its kind, and behind the other kind's up to its group
    upto_a, upto_b = (np.cumsum(np.bincount(g, minlength=len(x.links.cuts))) for g in (x.links.group_a, x.links.group_b))
    before_b = np.concatenate([[0], upto_b])
    code[np.arange(n_a) + before_b[x.links.group_a]] = x.ids_a + last_a * size_a
    code[np.arange(n_b) + upto_a[x.links.group_b]] = x.ids_b + 2 * size_a + last_b * size_b
    at = (x.start_a + x.start_b).tolist()
    return [b"".join(map(names.__getitem__, code[i:j].tolist()))[:-1] for i, j in zip(at, at[1:], strict=False)]


def _steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of STEP_BYTES together at most; a longer one is alone."""
    begin = size = 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > STEP_BYTES:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    yield begin, len(texts)


def _mapped(docs: DataFrame, id_col: str, text_col: str, files: Broadcast, make: Callable, schema: str) -> DataFrame:
    """(id, *make(aligned, a, b, linkable)) for each row, in steps; texts are read where they lie, without a shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, known = _loaded(*files.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, j in _steps(texts):
                columns = make(align_texts(texts[i:j], a, b), a, b, known)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *columns.values()], ["id", *columns])

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return map_batches(rows, each, f"id {kind}, {schema}")


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int32()))


def _files(spark: SparkSession, a_path: str | None, b_path: str | None) -> Broadcast:
    """The two vocabulary files, a few MB of fixed size, read where the job starts and sent along with it."""
    paths = a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)
    return spark.sparkContext.broadcast(tuple(Path(p).read_bytes() for p in paths))


def token_alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, a_ids, b_ids, a_group, b_group, links) for each row.

    a_ids, b_ids: token ids; a_group, b_group: each token's group in its text, from 0; links: pairs
    of places (a, b) of tokens that end together. Null and empty texts, and texts that either
    tokenizer does not give back byte by byte, have empty arrays. Repeated rows and repeated or null
    ids are aligned each on their own. Other columns are not read. An empty table gives an empty result.
    """

    def make(x: Aligned, a: ByteLevel, b: Pieces, known: np.ndarray) -> dict[str, pa.Array]:
        within = [v - np.repeat(s[:-1], np.diff(n)) for v, s, n in (
            (x.links.group_a, x.start_group, x.start_a), (x.links.group_b, x.start_group, x.start_b), (x.links.link_a, x.start_a, x.start_link), (x.links.link_b, x.start_b, x.start_link)
        )]
        pairs = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in within[2:]], ["a", "b"])
        links = pa.ListArray.from_arrays(pa.array(x.start_link, pa.int32()), pairs)
        return {"a_ids": _lists(x.ids_a, x.start_a), "b_ids": _lists(x.ids_b, x.start_b), "a_group": _lists(within[0], x.start_a), "b_group": _lists(within[1], x.start_b), "links": links}

    schema = "a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>, links array<struct<a: int, b: int>>"
    return _mapped(docs, id_col, text_col, _files(docs.sparkSession, a_path, b_path), make, schema).withColumnRenamed("id", id_col)


def _summed(x: Aligned, a: ByteLevel, b: Pieces, known: np.ndarray) -> dict[str, pa.Array]:
    """Numbers and digest of each text, and its links as places in the sorted list of linkable pairs."""
    pairs = x.ids_a[x.links.link_a] * len(b.tokens) + x.ids_b[x.links.link_b]
    at = np.searchsorted(known, pairs)
    if len(pairs) and (at.max() >= len(known) or not np.array_equal(known[at], pairs)):
        raise ValueError("tokens that end together and share no suffix")
    digests = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(x, a, b)]
    counts = {n: pa.array(np.diff(s), pa.int64()) for n, s in (("n_a", x.start_a), ("n_b", x.start_b), ("n_groups", x.start_group), ("n_links", x.start_link))}
    return counts | {"groups_sha256": pa.array(digests, pa.string()), "pairs": _lists(at, x.start_link)}


def _pair_sums(rows: DataFrame, n_known: int) -> DataFrame:
    """(pair, n) from rows with `pairs`: counts of a task first, then of a salt, then of all.

    A task holds one number for each linkable pair and hands on at most that many rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_known, np.int64)
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(flat):
                total += np.bincount(flat, minlength=n_known)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["pair", "n"])

    partial = rows.select("pairs").mapInArrow(count, "pair int, n long")
    salted = partial.groupBy("pair", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair of token ids linked."""
    files = _files(docs.sparkSession, a_path, b_path)
    _, b, known = _loaded(*files.value)
    rows = _mapped(docs.select(F.lit(0).alias("_"), text_col), "_", text_col, files, _summed, SUMMED)
    ids = docs.sparkSession.createDataFrame(pa.table({"pair": pa.array(range(len(known)), pa.int32()), "a_id": known // len(b.tokens), "b_id": known % len(b.tokens)}))
    return _pair_sums(rows, len(known)).join(ids, "pair").select("a_id", "b_id", "n")


SUMMED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>"


def alignment_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row; see token_alignment.

    A pair's count is the number of links that hold it in all rows. n_best: a row's links whose count
    is the highest of their B id, ties included. Texts are tokenised once: the rows with their links
    are written to the folder that executors share, read for the counts, and read again with the
    counts, which are one number for each linkable pair and so are sent to the tasks.
    """
    spark = docs.sparkSession
    files = _files(spark, a_path, b_path)
    _, b, known = _loaded(*files.value)
    written = f"{shared_folder(spark).rstrip('/')}/links-{uuid.uuid4().hex}"
    _mapped(docs, id_col, text_col, files, _summed, SUMMED).write.parquet(written)
    rows = spark.read.parquet(written)
    summed = _pair_sums(rows, len(known)).toArrow()
    count = np.zeros(len(known), np.int64)
    count[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    highest = np.zeros(len(b.tokens), np.int64)
    np.maximum.at(highest, known % len(b.tokens), count)
    table = spark.sparkContext.broadcast((count, count == highest[known % len(b.tokens)]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = table.value
        for x in batches:
            pairs = x.column(x.schema.names.index("pairs"))
            at = pairs.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.concatenate([[0], pairs.value_lengths().to_numpy(zero_copy_only=False)]))
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends]), pa.int64()) for v in (best, count)]
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], *sums], [*x.schema.names[:-1], "n_best", "count_sum"])

    kind = dict(rows.dtypes)["id"]
    made = map_batches(rows, each, f"id {kind}, {SUMMED.rsplit(',', 1)[0]}, n_best long, count_sum long")
    return made.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return alignment_summary(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
