"""Counts over a whole text that the quality operators learn from, and the labelled rows to learn on."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.llm.common import text_of

#: Names of the counts of one text, in the order in which `counts` returns them.
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "longest_word", "n_capitals", "n_digits", "n_marks",
)

_SPACES = " \t\n\r\x0b\x0c"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counts(text: str, raw: bytes | None = None, words: list[bytes] | None = None) -> tuple[int, ...]:
    """COUNTS of a text. Words are maximal runs without ASCII white space (as bytes.split() cuts).
    raw and words are the text's bytes and its words, where the caller has them already."""
    raw = text.encode() if raw is None else raw
    words = raw.split() if words is None else words
    char = lambda of: len(raw) - len(raw.translate(None, of))
    seen: set[str] = set()
    dup_lines = n_lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            n_lines += 1
            dup_lines += line in seen
            seen.add(line)
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) < len(windows):  # positions under a window that occurs twice or more
        upto = 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return (
        len(words), len(text) - sum(map(text.count, _SPACES)), char(b"#*$%&|<>"), dup_lines, repeated,
        n_lines, len(set(words)), max(map(len, words), default=0), char(_CAPITALS), char(b"0123456789"), char(b"!?"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, condition: Column | None = None, also: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, y, text, *also): the rows of docs with up to `rows` labelled ids, chosen by hash of the id.

    The bound is on the labelled ids, so what is broadcast is `rows` pairs of numbers at most. An id
    that docs repeats comes with all its rows: callers keep one row per id (see one_per_id) before
    anything reaches the driver. Only the columns named are read, whatever else the tables have.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if condition is not None:
        known = known.where(condition)
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), *also)
    return texts.join(F.broadcast(chosen), "doc_id")


def one_per_id(found: DataFrame) -> DataFrame:
    """Of the rows of an id the least, by the other columns in order; as many rows as ids, on any input."""
    rest = [c for c in found.columns if c != "doc_id"]
    return found.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("x")).select("doc_id", *(F.col("x")[c].alias(c) for c in rest))
