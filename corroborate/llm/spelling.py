"""Spelling variant grouping: words one edit apart, found by bands of a letter-parity bitmask.

A word's mask has one bit for each letter (some rare letters share one): whether it stands in the word
an odd number of times. An inserted or deleted letter flips one bit, a replaced one two at most, so of
three bands of the mask one at least stays as it is. Words are joined on equal bands with a length
filter and verified by edit distance. A band alone names few values, and a corpus of many words
would fill them with ever longer lists; so a band's bucket is cut by the half of the word that the
edit leaves alone: the first half of the shorter word's length, or the rest of it, counted from the end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import checkpointed, map_batches, read, text_of

#: Letters of the contract: ASCII and Latin-1.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Code points and occurrences that a word has at least.
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One run in so many has a letter deleted, as the contract says.
SLIP = 97
#: Bits of the mask, and words that a task counts before it hands them on.
BITS, HELD = 63, 100_000
#: A form has so many times the occurrences of its variant at least.
RATIO = 2


def _said(run: str, start: int, slip: int | None) -> str:
    """A lower-cased run; without its letter h % length if slip divides h, the crc32 that starts from `start`."""
    if slip:
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            at = h % len(run)
            return run[:at] + run[at + 1 :]
    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): occurrences of each word of least_length code points in whole texts.

    Words are maximal runs of ASCII and Latin-1 letters; only A-Z are lower-cased. slip: delete the
    letter h % length of each run whose h = crc32 of `<doc_id>:<lower-cased run>` slip divides (a null id
    is written as nothing). Null texts have no words; repeated rows count each. Counts are summed in
    tasks first, HELD words at a time, so a common word costs a row a task.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                runs: Counter[str] = Counter()
                for run, n in Counter(RUN.findall(text)).items():
                    runs[run.lower() if run.isascii() else run.translate(LOWER)] += n
                start = zlib.crc32(f"{key}:".encode())
                for run, n in runs.items():
                    if len(run) >= least_length and len(word := _said(run, start, slip)) >= least_length:
                        total[word] += n
                if len(total) > HELD:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text_of(text_col).alias("text"))
    return map_batches(rows, each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(total: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def parity(word: Column) -> Column:
    """The letter-parity mask of a word: a-z have a bit each, other letters share the rest."""
    letter = lambda c: F.ascii(c).cast("long")
    bit = lambda c: F.when(letter(c).between(97, 122), letter(c) - 97).otherwise(26 + letter(c) % (BITS - 26))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c).cast("int")))))


def _band(mask: Column, k: int) -> Column:
    """Every third bit of a mask from bit k on, so that common letters are spread over the bands."""
    return mask.bitwiseAND(F.lit(sum(1 << i for i in range(k, BITS, 3))).cast("long"))


def _halves(word: Column, shorter: Column) -> tuple[Column, Column]:
    """The first half of a word by the shorter one's length, and from the end the rest of that length."""
    half = F.floor(shorter / 2).cast("int")
    return F.substring(word, F.lit(1), half), F.right(word, shorter - half)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n), once for each pair of words (word, n) that differ by one inserted,
    deleted or replaced code point; the shorter one first, of two equally long ones the smaller.

    Every pair shares a band and a half, and is made where it shares the first of its bands and halves.
    """
    masked = words.where(F.col("word").isNotNull()).select("word", "n", parity(F.col("word")).alias("mask"), F.length("word").alias("size"))

    def keyed(longer: tuple[int, ...]) -> DataFrame:
        """Rows under every key that they have as the shorter word (0) or as one a letter longer (1)."""
        keys = []
        for extra in longer:
            shorter = F.col("size") - extra
            for side, half in enumerate(_halves(F.col("word"), shorter)):
                for k in range(3):
                    key = F.xxhash64(shorter, F.lit(side), half, F.lit(k), _band(F.col("mask"), k))
                    keys.append(F.struct(key.alias("key"), F.lit(3 * side + k).alias("way")))
        return masked.select(*masked.columns, F.explode(F.array(*keys)).alias("_")).select(*masked.columns, "_.key", "_.way")

    a, b = keyed((0,)).alias("a"), keyed((0, 1)).alias("b")
    same = lambda i: F.col(f"a.{i}") == F.col(f"b.{i}")
    halves = [x == y for x, y in zip(_halves(F.col("a.word"), F.col("a.size")), _halves(F.col("b.word"), F.col("a.size")), strict=True)]
    bands = [_band(F.col("a.mask"), k) == _band(F.col("b.mask"), k) for k in range(3)]
    first = F.coalesce(*[F.when(h & e, F.lit(3 * side + k)) for side, h in enumerate(halves) for k, e in enumerate(bands)])
    lengths = (F.col("b.size") == F.col("a.size") + 1) | ((F.col("b.size") == F.col("a.size")) & (F.col("a.word") < F.col("b.word")))
    flips = F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2 - (F.col("b.size") - F.col("a.size"))
    verified = F.levenshtein("a.word", "b.word", 1) == 1
    joined = a.join(b, same("key") & same("way") & lengths & flips & (first == F.col("a.way")) & verified)
    return joined.select(F.col("a.word").alias("word"), F.col("a.n").alias("n"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): where following forms ends.

    Steps double each round. A form has RATIO times its variant's occurrences, so 63 steps are the
    longest chain that a long can count, and six rounds end it.
    """
    to = checkpointed(forms.select("word", F.col("form").alias("root")))
    for _ in range(6):
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if to.join(on, "root", "left_semi").isEmpty():
            break
        to = checkpointed(to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return to


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of a table (word, n).

    form: the word one edit away with the largest n, ties to the smallest in code-point order, if its n is
    `ratio` times the word's at least, else null; form_n its n; root: the end of the chain of forms, the
    word itself without one; n_near: how many words are one edit away. Rows without a word or count
    are left out, counts of a word that comes twice are added. An empty table gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, or chains of forms may not end")
    some = words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    known = checkpointed(some)
    pairs = near_pairs(known)
    both = pairs.select(F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("_")).select("_.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    is_form = -F.col("best.m") >= ratio * F.col("n")
    info = checkpointed(
        known.join(best, "word", "left").select(
            "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.m")).cast("long").alias("form_n")
        )
    )
    roots = _roots(info.where(F.col("form").isNotNull()))
    return info.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(read(spark, sf_dir, "documents"), slip=SLIP)
    return variant_groups(counts.where(F.col("n") >= LEAST_COUNT))
