"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import map_batches, read, text_of
from corroborate.llm.quality_classifier import held_out
from corroborate.llm.text_stats import labelled_sample, one_per_id

#: Most labelled rows that features are chosen and weights fitted on, features, and grades above 0.
TRAIN_ROWS, FEATURES, LEVELS = 10_000, 800, 2
#: A feature has so many different contexts at least, and is this many standard errors from even.
LEAST_CONTEXTS, LEAST_Z = 8, 4.0
STEPS, RATE, RIDGE = 600, 0.05, 1e-4
#: Probability of a grade above 0 from which on a text counts as toxic.
THRESHOLD = 0.5

_WORD = re.compile(r"[^\W\d_]+")


def stems(word: str) -> list[str]:
    return [f"{word[:k]}-" for k in range(3, min(7, len(word)))]


def terms(text: str) -> dict[str, tuple[int, int]]:
    """Words in lower case and the stems (first three to six letters) of longer ones: how often each
    occurs, and a number for the words around its first place."""
    words = _WORD.findall(text.lower())
    found: dict[str, tuple[int, int]] = {}
    first: dict[str, int] = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    for w, n in Counter(words).items():
        i = first[w]
        context = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())
        for t in (w, *stems(w)):
            had, seen = found.get(t, (0, context))
            found[t] = (had + n, seen)
    return found


def weight(n: int) -> float:
    """A feature's value: the first occurrence counts most."""
    return 1 + math.log(n)


@dataclass
class Model:
    """Weights that all thresholds share, and the ordered thresholds."""

    weights: dict[str, float]
    cuts: list[float]

    def __post_init__(self) -> None:
        self.starts = {t[:3] for t in self.weights if t.endswith("-")}

    def grades(self, text: str) -> list[float]:
        """P(grade > k) for each k, falling. Looks up only what the model has, else the same as terms()."""
        found: Counter[str] = Counter()
        for w, n in Counter(_WORD.findall(text.lower())).items():
            if w in self.weights:
                found[w] += n
            if w[:3] in self.starts:
                for t in stems(w):
                    if t in self.weights:
                        found[t] += n
        z = sum(self.weights[t] * weight(n) for t, n in found.items())
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, z - c)))) for c in self.cuts]


def fit(x: np.ndarray, grade: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of the grades with P(grade > k) =
    sigmoid(w x - cut k). Cuts are kept in order as the first plus positive gaps. Gradient steps
    (Adam) over all rows, the same at every run."""
    w = np.zeros(x.shape[1])
    share = [min(max((grade > k).mean(), 1e-3), 1 - 1e-3) for k in range(levels)]
    base = np.array([-math.log(s / (1 - s)) for s in share])
    free = np.r_[base[0], np.log(np.maximum(np.diff(base), 0.05))]
    first = [np.zeros_like(w), np.zeros_like(free)]
    second = [np.zeros_like(w), np.zeros_like(free)]
    for t in range(1, STEPS + 1):
        cuts = free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]
        z = x @ w
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts, -40, 40)))  # P(grade > k)
        full = np.c_[np.ones(len(z)), above, np.zeros(len(z))]
        rows = np.arange(len(z))
        p = np.maximum(full[rows, grade] - full[rows, grade + 1], 1e-12)
        slope = np.c_[np.zeros(len(z)), above * (1 - above), np.zeros(len(z))]
        dz = (slope[rows, grade] - slope[rows, grade + 1]) / p  # of the log likelihood
        dcut = np.stack([-(slope[:, k + 1] / p) * ((grade == k + 1).astype(float) - (grade == k)) for k in range(levels)], axis=1).mean(axis=0)
        dfree = np.r_[dcut.sum(), [dcut[k:].sum() * math.exp(free[k]) for k in range(1, levels)]]
        for i, (param, grad) in enumerate(((w, x.T @ dz / len(z) - RIDGE * w), (free, dfree))):
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.99 * second[i] + 0.01 * grad**2
            param += RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.99**t)) + 1e-8)
    return w, free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: texts with y -> (term, context, y), each pair of a batch once with its largest y."""
    for b in batches:
        found: dict[tuple[str, int], int] = {}
        for y, text in zip(b.column("y").to_pylist(), b.column("text").to_pylist(), strict=True):
            for t, (_, context) in terms(text).items():
                found[t, context] = max(found.get((t, context), y), y)
        columns = ([t for t, _ in found], [c for _, c in found], list(found.values()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32()), strict=True)], ["term", "context", "y"])


def _cells(place: dict[str, int]):
    """mapInArrow function: texts -> one row each, with the places and counts of the chosen terms in it."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted((place[t], n) for t, (n, _) in terms(text).items() if t in place) for text in b.column("text").to_pylist()]
            lists = [pa.array([[x[i] for x in f] for f in found], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *lists], ["doc_id", "y", "at", "n"])

    return each


def learn_from(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """A model from up to `rows` labelled documents outside the held-out fold (a documented bound).

    The labels say toxic or not. Severity among the toxic ones comes from how much they use the terms
    that set them apart: up to the median is grade 1, above it grade 2. Terms are counted in Spark;
    the FEATURES that tell most come to the driver, then one sparse row per labelled id with their
    counts. Labels of one kind only, or none, give a model that finds nothing toxic.
    """
    sample = labelled_sample(docs, labels, "toxic", rows, ~held_out())
    totals = sample.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    if not totals["k"] or totals["k"] == totals["n"]:
        return Model({}, [40.0] * LEVELS)
    share = totals["k"] / totals["n"]
    # a passage that was copied into many texts is one context, however many copies are labelled
    contexts = map_batches(sample, _contexts, "term string, context long, y int").groupBy("term", "context").agg(F.max("y").alias("y"))
    by_term = contexts.groupBy("term").agg(F.count("*").alias("d"), F.sum("y").alias("k")).where(F.col("d") >= LEAST_CONTEXTS)
    z = (F.col("k") - F.col("d") * share) / F.sqrt(F.col("d") * share * (1 - share))
    chosen = by_term.withColumn("z", z).where(F.abs("z") >= LEAST_Z).orderBy(F.desc(F.abs("z")), "term").limit(FEATURES)
    strength = {r.term: r.z for r in chosen.collect()}
    place = {t: i for i, t in enumerate(sorted(strength))}
    if not place:
        return Model({}, [40.0] * LEVELS)
    found = sorted(one_per_id(map_batches(sample, _cells(place), "doc_id long, y int, at array<int>, n array<int>")).collect())
    x = np.zeros((len(found), len(place)))
    for i, r in enumerate(found):
        x[i, r["at"]] = [weight(n) for n in r["n"]]
    toxic = np.array([r["y"] for r in found])
    marks = x @ np.array([strength[t] > 0 for t in place], float)
    grade = toxic * (1 + (marks > np.median(marks[toxic == 1])))
    w, cuts = fit(x, grade.astype(int))
    return Model({t: float(w[i]) for t, i in place.items()}, [float(c) for c in cuts])


def grade_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for each row, from whole texts, without a shuffle.

    severity is the expected grade, the sum of P(grade > k); grade is the number of thresholds
    passed with THRESHOLD or more; toxic is grade > 0. The model has FEATURES terms at most. Null
    is the empty text, which has only the thresholds to go by. Repeated rows are graded each;
    other columns are not read; an empty table gives an empty result; without labels of both kinds
    nothing is toxic.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [model.grades(t) for t in b.column(1).to_pylist()]
            grade = [sum(p >= THRESHOLD for p in x) for x in ps]
            columns = [pa.array([sum(x) for x in ps], pa.float64()), pa.array(grade, pa.int32()), pa.array([x[0] for x in ps], pa.float64()), pa.array([g > 0 for g in grade], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(rows, each, "doc_id long, severity double, grade int, p_toxic double, toxic boolean").withColumnRenamed("doc_id", id_col)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return grade_toxicity(docs, learn_from(docs, read(spark, sf_dir, "labels")))
