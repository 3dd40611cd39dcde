"""Quality rules: a decision list learned by sequential covering, applied as Spark conditionals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import map_batches, read, text_of
from corroborate.llm.text_stats import COUNTS, base_failed, counts, labelled_sample, one_per_id

#: Most labelled rows that a list is learned from, conditions of a rule, rules of a list.
TRAIN_ROWS, MAX_CONDITIONS, MAX_RULES = 20_000, 4, 16
#: A rule must be right on this share of what it covers, and cover this share of the rows.
PRECISION, COVER = 0.95, 0.002
#: Candidate thresholds of a statistic.
CUTS = 64

#: The statistics that conditions are about: name -> (numerator, denominator), both counts.
STATISTICS = {
    "symbol_share": ("n_symbols", "word_chars"),
    "capital_share": ("n_capitals", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "longest_word": ("longest_word", None),
    "n_words": ("n_words", None),
}


def statistic(name: str) -> Column:
    over, under = STATISTICS[name]
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1)) if under else F.col(over).cast("double")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] > self.cut if self.above else x[self.name] <= self.cut

    def column(self) -> Column:
        return statistic(self.name) > self.cut if self.above else statistic(self.name) <= self.cut


Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(n, bool))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the most information gained, until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), inside.sum()
        best = (1e-9, None)
        for name, v in x.items():
            have, is_bad = v[inside], bad[inside]
            for cut in np.unique(np.quantile(have, np.linspace(0, 1, CUTS), method="lower"))[:-1]:
                for above in (True, False):
                    side = have > cut if above else have <= cut
                    q, m = (side & is_bad).sum(), side.sum()
                    if q and (gain := q * (np.log2(q / m) - np.log2(p / n))) > best[0]:
                        # half way to the next value that occurs, so that new texts have a margin
                        best = (gain, Condition(name, above, float(cut + have[have > cut].min()) / 2))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop final conditions while that doesn't make the rule worse on rows that it wasn't grown on."""

    def worth(r: Rule) -> float:
        inside = _covered(r, x, len(bad))
        return ((inside & bad).sum() - (inside & ~bad).sum()) / max(inside.sum(), 1) if inside.any() else -1.0

    return max((rule[:i] for i in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)))


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Rules for bad rows, in order: grow on two thirds, prune on the rest, take the covered rows out.

    Stops when a rule is not precise enough or covers too little, or when no bad row is left.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = np.arange(len(bad)) % 3 == 0
    while len(rules) < MAX_RULES and (left & bad).any():
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow])
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in x.items()}, bad[prune])
        inside = _covered(rule, x, len(bad)) & left
        if inside.sum() < max(3, COVER * len(bad)) or (inside & bad).sum() < PRECISION * inside.sum():
            break
        rules.append(rule)
        left &= ~inside
    return rules


def keep_column(rules: list[Rule]) -> Column:
    """The list as ordered Spark conditionals: the first rule that holds rejects, none keeps."""
    rejects = (reduce(Column.__and__, (c.column() for c in rule)) for rule in rules)
    return F.coalesce(*(F.when(r, F.lit(False)) for r in rejects), F.lit(True))


def rule_text(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.name} {'>' if c.above else '<='} {c.cut:.6g}" for c in rule) for rule in rules]


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *also, *COUNTS) for each row, read off whole texts where they are read."""
    kinds = [f"{n} {docs.schema[n].dataType.simpleString()}" for n in also]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*map(counts, b.columns[-1].to_pylist()), strict=True)) or [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in found)], ["doc_id", *also, *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *also, text_of(text_col).alias("text"))
    return map_batches(rows, each, ", ".join(["doc_id long", *kinds, *(f"{c} long" for c in COUNTS)]))


def learn_from(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> list[Rule]:
    """Rules from up to `rows` labelled documents that pass the base conditions (a documented bound).

    Of rows that repeat an id one is learned from; no labels, or of one kind, give no rules.
    """
    known = text_counts(labelled_sample(docs, labels, "quality", rows), also=("y",)).where(~base_failed())
    stats = known.select("doc_id", "y", *(statistic(n).alias(f"s_{n}") for n in STATISTICS))
    found = one_per_id(stats).toPandas().sort_values(["doc_id", "y"])
    order = np.random.default_rng(7).permutation(len(found))
    return learn_rules({n: found[f"s_{n}"].to_numpy()[order] for n in STATISTICS}, found["y"].to_numpy()[order] == 0)


def quality_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) for each row: base conditions first, then the learned list.

    No shuffle: counts are taken where a text is read, and the list is a Spark expression over
    them. Null text has no words and fails the base. Repeated rows get the same answer each. Other
    columns are not read; an empty table gives an empty result; no rules keep what the base keeps.
    """
    return (
        text_counts(docs, id_col, text_col)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & keep_column(rules))
        .withColumnRenamed("doc_id", id_col)
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality_rules(docs, learn_from(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
