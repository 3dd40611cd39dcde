"""Scores of claim and evidence texts as a pair: contradiction, entailment, neutral.

A scorer takes items with a claim and an evidence text and adds `p`: three probabilities in that order. Two
are here: fixed weights over alignment features, and the same features under a fitted multinomial model.
Others (a cross-encoder served elsewhere, say) plug in as functions of the same kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions.vocab import let
from corroborate.functions.webqa import answer_only
from corroborate.operators import heads
from corroborate.operators.evidence import soft_scores

#: A scorer adds `p`: array of contradiction, entailment and neutral.
PairScorer = Callable[[DataFrame], DataFrame]
LABELS = ("contradiction", "entailment", "neutral")
FEATURES = ("jaccard", "claim_covered", "evidence_covered", "pairs_covered", "negation_differs", "numbers_shared", "numbers_differ", "length_ratio")
#: Words that turn a sentence round.
NEGATIONS = ("no", "not", "never", "none", "neither", "nor", "cannot", "without", "false", "incorrect", "untrue", "denied")
#: Weights (a row per label: one per feature, then a constant) of the scorer that needs no training.
WEIGHTS = (
    (0.5, 1.0, 0.5, 0.0, 3.0, -1.0, 3.0, 0.0, -1.5),
    (1.5, 2.0, 1.0, 1.5, -3.0, 1.0, -3.0, 0.0, -1.5),
    (-1.5, -2.0, -1.0, -1.0, 0.0, 0.0, 0.0, 0.0, 1.0),
)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _share(some: Column, of: Column) -> Column:
    """How many of one set's elements another has, as a share of the first; 0 of nothing."""
    return F.when(F.size(of) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(of, some)) / F.size(of))


def _pairs(ws: Column) -> Column:
    following = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
    return F.array_distinct(F.filter(F.zip_with(ws, following, lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull()))


def alignment(claim: Column, evidence: Column) -> Column:
    """FEATURES of a pair, array<double>. Of evidence written as question and answer the answer counts.

    Shares are of distinct words, pairs of neighbours and numbers; negation_differs: one text has an odd number
    of NEGATIONS among its words and the other hasn't; numbers_shared is 1 where the claim has none;
    numbers_differ: the claim has numbers, the evidence too, and none in common; length_ratio: the fewer words
    by the more, 0 where a text has none. Null counts as the empty text.
    """

    def made(both: Column) -> Column:
        cw, ew = both["c"], both["e"]
        c, e = F.array_distinct(cw), F.array_distinct(ew)
        union = F.size(F.array_union(c, e))
        number = lambda ws: F.filter(ws, lambda w: w.rlike("^[0-9]+$"))
        odd = lambda ws: F.size(F.filter(ws, lambda w: w.isin(*NEGATIONS))) % 2
        cn, en = number(c), number(e)
        apart = (F.size(cn) > 0) & (F.size(en) > 0) & ~F.arrays_overlap(cn, en)
        most = F.greatest(F.size(cw), F.size(ew))
        return F.array(
            F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(c, e)) / union),
            _share(e, c),
            _share(c, e),
            _share(_pairs(ew), _pairs(cw)),
            (odd(cw) != odd(ew)).cast("double"),
            F.when(F.size(cn) == 0, F.lit(1.0)).otherwise(_share(en, cn)),
            apart.cast("double"),
            F.when(most == 0, F.lit(0.0)).otherwise(F.least(F.size(cw), F.size(ew)) / most),
        )

    return let(F.struct(words(claim).alias("c"), words(answer_only(F.coalesce(evidence, F.lit("")))).alias("e")), made)


def by_weights(claim: str = "claim", evidence: str = "evidence", weights: tuple[tuple[float, ...], ...] = WEIGHTS) -> PairScorer:
    """The softmax of fixed weights over the features: no Python and no model files."""

    def scored(items: DataFrame) -> DataFrame:
        def softmax(x: Column) -> Column:
            logits = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, row[:-1])), lambda a, w: a * w), F.lit(float(row[-1])), lambda s, v: s + v) for row in weights]
            return let(F.array(*logits), lambda z: let(F.transform(z, lambda v: F.exp(v - F.array_max(z))), lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, w: s + w))))

        return items.withColumn("p", softmax(alignment(F.col(claim), F.col(evidence))))

    return scored


def fit_pairs(items: DataFrame, label: str, key: str, held_out: Column, claim: str = "claim", evidence: str = "evidence", settings: heads.Settings | None = None) -> heads.Run:
    """A multinomial model of the features, fitted on items with a label of LABELS; others are left out.

    It is the stance head without a hidden layer and without a strength."""
    code = F.array_position(F.array(*map(F.lit, LABELS)), F.col(label)) - 1
    rows = heads.training_rows(items.where(F.col(label).isNotNull()), key, alignment(F.col(claim), F.col(evidence)), code, F.lit(0.0), held_out)
    return heads.fit_heads(rows, settings or heads.Settings(hidden=0, lr=0.1, epochs=40, strength_weight=0.0))


def by_model(run: heads.Run, claim: str = "claim", evidence: str = "evidence") -> PairScorer:
    """The fitted model as a scorer."""

    def scored(items: DataFrame) -> DataFrame:
        made = heads.apply_heads(items.withColumn("x", alignment(F.col(claim), F.col(evidence))), run)
        return made.drop("x", "stance_pred", "strength_pred")

    return scored


def paired_scores(items: DataFrame, scorer: PairScorer, key: str = "claim_id") -> DataFrame:
    """A5 with a scorer's probabilities: (key, support, refute, nei) from items with texts and `confidence`."""
    return soft_scores(scorer(items), F.col("p")[LABELS.index("entailment")], F.col("p")[LABELS.index("contradiction")], key)
