"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from corroborate.llm.common import map_batches, read, spare
from corroborate.llm.text_stats import counts, labelled_sample, one_per_id

#: Most labelled rows that the machine is fitted on.
TRAIN_ROWS = 6_000
#: Hash buckets of words, factors, passes over the training rows, rows of a step.
BUCKETS, FACTORS, EPOCHS, STEP_ROWS = 1 << 14, 6, 12, 256
RATE, DECAY, SEED = 0.02, 1e-5, 11
THRESHOLD = 0.7

#: Structure statistics and metadata, after the words' buckets; DENSE of them.
DENSE = 12
#: Bytes that aren't part of a word at its end: ASCII but for letters and digits.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text: hashed words (lower case) and their trailing marks, weighted by
    log frequency and scaled to length one, then structure statistics, then metadata (n_chars)."""
    raw = text.encode()
    words = raw.split()
    seen: dict[int, int] = {}
    for w, n in Counter(raw.lower().split()).items():
        core = w.rstrip(MARKS)
        bucket = zlib.crc32(core) % BUCKETS
        seen[bucket] = seen.get(bucket, 0) + n
        if len(core) < len(w):
            bucket = zlib.crc32(b"\0" + w[len(core) : len(core) + 4]) % BUCKETS
            seen[bucket] = seen.get(bucket, 0) + n
    index = np.fromiter(seen.keys(), np.int64, len(seen))
    value = np.log1p(np.fromiter(seen.values(), np.float64, len(seen)))
    value /= max(1.0, float(np.sqrt(value @ value)))
    n_words, chars, symbols, dup, repeat, lines, distinct, longest, capitals, digits, marks = counts(text, raw, words)
    size = max(n_words, 1)
    dense = [
        min(1.0, math.log1p(n_words) / 10), symbols / max(chars, 1) * 3, dup / max(lines, 1), repeat / size,
        distinct / size, min(1.0, math.log1p(longest) / 5), capitals / max(chars, 1), digits / max(chars, 1) * 3,
        min(1.0, marks / size), min(1.0, chars / size / 20), float(n_words < 50),
        min(1.0, math.log1p(len(text) if n_chars is None else max(n_chars, 0)) / 14),
    ]
    return np.r_[index, BUCKETS + np.arange(DENSE)], np.r_[value, dense]


@dataclass
class Machine:
    """Bias, weights and factors; the score of x is sigmoid(b + w x + pairwise interactions)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, index: np.ndarray, value: np.ndarray) -> float:
        """Linear time: half of (sum of v x) squared less the sum of (v x) squared, over the factors."""
        vx = self.factors[index] * value[:, None]
        total = vx.sum(axis=0)
        return float(self.bias + self.weights[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def scores(self, texts: Iterable[tuple[str, int | None]]) -> np.ndarray:
        """The scores of texts with their n_chars; the sums over factors are taken for all at once."""
        made = [features(t or "", n) for t, n in texts]
        if not made:
            return np.zeros(0)
        index, value = (np.concatenate(x) for x in zip(*made, strict=True))
        start = np.cumsum([0, *(len(i) for i, _ in made[:-1])])
        vx = self.factors[index] * value[:, None]
        pair = 0.5 * (np.add.reduceat(vx, start) ** 2 - np.add.reduceat(vx * vx, start)).sum(axis=1)
        z = self.bias + np.add.reduceat(self.weights[index] * value, start) + pair
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
    """Logistic loss by Adam in small steps, the same at every run. No rows give the score 0.5."""
    rng = np.random.default_rng(SEED)
    size = BUCKETS + DENSE
    if not rows:
        return Machine(0.0, np.zeros(size), np.zeros((size, FACTORS)))
    share = min(max(y.mean(), 0.01), 0.99)
    params = np.c_[np.zeros(size), rng.normal(0, 0.03, (size, FACTORS))]  # column 0: weights
    bias = math.log(share / (1 - share))
    first, second = np.zeros_like(params), np.zeros_like(params)
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), STEP_ROWS):
            some = order[at : at + STEP_ROWS]
            n = np.array([len(rows[i][0]) for i in some])
            index = np.concatenate([rows[i][0] for i in some])
            value = np.concatenate([rows[i][1] for i in some])
            start = np.r_[0, np.cumsum(n)[:-1]]
            used, where = np.unique(index, return_inverse=True)
            px = params[index] * value[:, None]
            sums = np.add.reduceat(px, start)
            pair = 0.5 * (sums[:, 1:] ** 2 - np.add.reduceat(px[:, 1:] ** 2, start)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(bias + sums[:, 0] + pair, -40, 40))) - y[some]
            e = np.repeat(error, n) * value
            slope = np.c_[e, e[:, None] * (np.repeat(sums[:, 1:], n, axis=0) - px[:, 1:])] / len(some)
            grad = np.stack([np.bincount(where, slope[:, f], len(used)) for f in range(1 + FACTORS)], axis=1)
            grad += DECAY * params[used]
            t += 1
            first[used] = 0.9 * first[used] + 0.1 * grad
            second[used] = 0.999 * second[used] + 0.001 * grad**2
            params[used] -= RATE * (first[used] / (1 - 0.9**t)) / (np.sqrt(second[used] / (1 - 0.999**t)) + 1e-8)
            bias -= RATE * error.mean()
    return Machine(float(bias), params[:, 0].copy(), params[:, 1:].copy())


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def learn_from(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, label: str = "quality") -> Machine:
    """A machine from up to `rows` labelled documents outside the held-out fold (a documented bound).

    Features are made where the texts are; index and value arrays of the sample, one row per id,
    come to the driver. No labels give the score 0.5.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [features(t, n) for t, n in zip(b.column("text").to_pylist(), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("y"), pa.array([i.astype("<i4").tobytes() for i, _ in made], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in made], pa.binary())],
                ["doc_id", "y", "i", "v"],
            )

    sample = labelled_sample(docs, labels, label, rows, ~held_out(), (n_chars_of(docs).alias("n_chars"),))
    found = sorted(one_per_id(map_batches(sample, each, "doc_id long, y int, i binary, v binary")).collect())
    unpacked = [(np.frombuffer(r.i, "<i4").astype(np.int64), np.frombuffer(r.v, "<f4").astype(np.float64)) for r in found]
    return fit(unpacked, np.array([r.y for r in found], float))


def n_chars_of(docs: DataFrame) -> Column:
    """The metadata n_chars as a number; null where docs has none, or something else by that name."""
    known = {f.name.lower(): f.dataType for f in docs.schema}.get("n_chars")
    return F.col("n_chars").try_cast("long") if isinstance(known, NumericType | StringType) else F.lit(None).cast("long")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, score) for each row: the probability of label 1, from whole texts, without a shuffle.

    The machine goes to the tasks as a broadcast of a fixed size (BUCKETS + DENSE rows). Labels,
    language, source and id are no inputs; n_chars is the metadata and is the text's own length
    where it is null or missing. Null text is scored as the empty text. Repeated rows are scored
    each; other columns are not read; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype("f4"), machine.factors.astype("f4")))
    whole = [docs.schema[c] for c in (id_col, *keep)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Machine(*sent.value)
        for b in batches:
            scores = here.scores(zip(b.columns[-2].to_pylist(), b.columns[-1].to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(scores, pa.float64())], [*b.schema.names[:-2], "score"])

    rows = docs.select(id_col, *keep, F.col(text_col).alias("_text"), n_chars_of(docs).alias("_n_chars"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in whole), "score double"])
    return map_batches(rows, each, kinds)


def predicted() -> Column:
    return (F.col("score") >= THRESHOLD).cast("int")


def accepted(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the machine scores at THRESHOLD or more."""
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.weights.astype("f4"), machine.factors.astype("f4")))
    text = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Machine(*sent.value)
        for b in batches:
            scores = here.scores(zip(b.column(text).to_pylist(), b.columns[-1].to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(scores >= THRESHOLD, pa.bool_()))

    return map_batches(docs.withColumn(spare("_n_chars", docs.columns), n_chars_of(docs)), each, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, learn_from(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted().alias("predicted"))
