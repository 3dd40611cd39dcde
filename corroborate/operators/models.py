"""Scorers of claims, threshold search, ablations and training histories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.functions.vocab import DECISION_THETA, EVIDENCE_TYPES, EVIDENCE_WEIGHTS, VERDICT_CODES, verdict_code
from corroborate.operators.evidence import claim_scores, with_decision_path
from corroborate.operators.splits import _ranked

#: A scorer takes scores (claim_id, support, refute, ...) and adds `pred`.
Scorer = Callable[[DataFrame], DataFrame]


def by_thresholds(scores: DataFrame) -> DataFrame:
    """The formula's verdict."""
    return scores.withColumn("pred", formula.verdict(F.col("support"), F.col("refute")))


def by_decision(scores: DataFrame, theta: float = DECISION_THETA) -> DataFrame:
    """The decision path's verdict (F45), undecided claims as not enough evidence."""
    return with_decision_path(scores, theta).withColumnRenamed("final", "pred").drop("path")


MODELS: dict[str, Scorer] = {"thresholds": by_thresholds, "decision": by_decision}


def by_head(model) -> Scorer:
    """The verdict of a fitted head (fit_verdict_head)."""
    return lambda scores: apply_verdict_head(model, scores).drop("nei")


def by_hybrid(model, theta: float = DECISION_THETA) -> Scorer:
    """The decision path where the scores decide (F45), the fitted head's verdict elsewhere."""

    def scored(scores: DataFrame) -> DataFrame:
        both = with_decision_path(by_head(model)(scores).withColumnRenamed("pred", "_head"), theta)
        return both.withColumn("pred", F.when(F.col("path").startswith("symbolic_"), F.col("final")).otherwise(F.col("_head"))).drop("_head", "final", "path")

    return scored


def verdict_head(seed: int = 42, epochs: int = 60) -> Pipeline:
    """A 3-32-3 perceptron on (support, refute, nei); label is the verdict's code. Sigmoid hidden
    units where other implementations may use other ones."""
    assemble = VectorAssembler(inputCols=["support", "refute", "nei"], outputCol="features")
    return Pipeline(stages=[assemble, MultilayerPerceptronClassifier(layers=[3, 32, 3], seed=seed, maxIter=epochs, featuresCol="features", labelCol="label", predictionCol="pred")])


def fit_verdict_head(scores: DataFrame, label: str = "verdict", **options):
    """The head fitted on labelled scores; verdicts without a code are left out."""
    rows = scores.withColumn("nei", 1 - F.greatest("support", "refute")).withColumn("label", verdict_code(F.col(label)).cast("double")).where("label is not null")
    return verdict_head(**options).fit(rows)


def apply_verdict_head(model, scores: DataFrame) -> DataFrame:
    names = F.array(*(F.lit(v) for v in VERDICT_CODES))
    out = model.transform(scores.withColumn("nei", 1 - F.greatest("support", "refute")))
    return out.withColumn("pred", names[F.col("pred").cast("int")]).drop("features", "rawPrediction", "probability")


def theta_search(scores: DataFrame, label: str = "label", thetas: tuple[float, ...] = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60)) -> DataFrame:
    """Accuracy of the decision path at each threshold, all in one pass: a row holds the hits at
    every threshold, and they are summed side by side."""
    def hit(t: float) -> Column:
        path = formula.decision_path(F.col("support"), F.col("refute"), t)
        pred = F.when(path == "symbolic_supported", "supported").when(path == "symbolic_refuted", "refuted").otherwise("not_enough_evidence")
        return F.avg((pred == F.col(label)).cast("double"))

    wide = scores.agg(*(hit(t).alias(f"t{i}") for i, t in enumerate(thetas)))
    pairs = F.array(*(F.struct(F.lit(t).alias("theta"), F.round(f"t{i}", 4).alias("accuracy")) for i, t in enumerate(thetas)))
    return wide.select(F.explode(pairs).alias("x")).select("x.*")


def type_counterfactuals(items: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims whose verdict changes if every item were of one type; (type, n, n_changed).

    items are scored. Each claim's scores under all types are products in one aggregate.
    """
    def scored(weight: Column, side: str) -> Column:
        return formula.rounded(formula.stance_score(F.col("stance"), formula.evidence_confidence(F.col("source_trust"), weight, F.col("inference_strength")), side), 4)

    columns = [scored(F.lit(EVIDENCE_WEIGHTS[t]), side).alias(f"{t}_{side}") for t in EVIDENCE_TYPES for side in ("supports", "refutes")]
    base = [formula.rounded(formula.stance_score(F.col("stance"), F.col("confidence"), side), 4).alias(side) for side in ("supports", "refutes")]
    wide = items.groupBy(key).agg(*base, *columns).withColumn("now", formula.verdict(F.col("supports"), F.col("refutes")))
    changed = F.array(*(F.struct(F.lit(t).alias("type"), (formula.verdict(F.col(f"{t}_supports"), F.col(f"{t}_refutes")) != F.col("now")).alias("changed")) for t in EVIDENCE_TYPES))
    return wide.select(F.explode(changed).alias("x")).groupBy("x.type").agg(F.count("*").alias("n"), F.count_if("x.changed").alias("n_changed"))


def without_each(items: DataFrame, key: str = "claim_id", item: str = "event_id") -> DataFrame:
    """For each scored item the claim's scores and verdict without it: (key, item, support, refute,
    verdict, changed: whether the verdict is another one).

    A claim's products over the rest are its products divided by the item's own factor, with factors of 0
    counted apart; so a claim costs one aggregate and one join, and none is sorted. A nudge of 1e-10 before rounding
    settles decimal ties alike, however the factors are multiplied.
    """
    def side(name: str) -> tuple[Column, Column]:
        left = F.when(F.col("stance") == name, 1 - F.col("confidence"))
        return left, F.struct(F.coalesce(F.product(F.when(left != 0, left)), F.lit(1.0)).alias("p"), F.count_if(left == 0).alias("z"))

    (for_, for_all), (against, against_all) = side("supports"), side("refutes")
    totals = items.groupBy(F.col(key).alias("_key")).agg(for_all.alias("_s"), against_all.alias("_r"))
    score = lambda p: F.round(1 - p + 1e-10, 4)
    whole = lambda t: score(F.when(F.col(t)["z"] > 0, 0.0).otherwise(F.col(t)["p"]))
    rest = lambda own, t: score(F.when(F.col(t)["z"] - F.coalesce((own == 0).cast("int"), F.lit(0)) > 0, 0.0).when(own.isNull() | (own == 0), F.col(t)["p"]).otherwise(F.col(t)["p"] / own))
    both = items.join(totals, F.col(key) == F.col("_key"))
    out = both.select(key, item, rest(for_, "_s").alias("support"), rest(against, "_r").alias("refute"), formula.verdict(whole("_s"), whole("_r")).alias("_now"))
    verdict = formula.verdict(F.col("support"), F.col("refute"))
    return out.withColumn("verdict", verdict).withColumn("changed", verdict != F.col("_now")).drop("_now")


def pass_rates(probes: DataFrame, by: str) -> DataFrame:
    """Probes (expected, pred) that pass, by hypothesis or model."""
    return probes.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg((F.col("expected") == F.col("pred")).cast("double")), 4).alias("pass_rate"))


def payload(items: DataFrame, scores: DataFrame, key: str = "claim_id", digits: int = 3) -> DataFrame:
    """A prediction with its path, reason and sorted evidence breakdown, numbers rounded half up
    from their four decimal digits (as decimals, so that ties don't depend on binary fractions)."""
    r = lambda c: F.round(F.col(c).cast("decimal(10,4)"), digits).cast("double")
    rows = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("rank"), F.col("source_id"), F.col("stance"), r("confidence").alias("confidence")))).alias("evidence"))
    reason = F.format_string("support %.4f, refute %.4f: %s", F.col("support"), F.col("refute"), F.col("path"))
    return with_decision_path(scores).join(rows, key).select(key, "final", "path", r("support").alias("support"), r("refute").alias("refute"), reason.alias("reason"), F.transform("evidence", lambda e: e.dropFields("rank")).alias("evidence"))


def stance_ordinals(evidence: DataFrame, key: str = "claim_id", order: str = "event_id") -> DataFrame:
    """Place of an item among those of its claim and stance, from 1."""
    return evidence.withColumn("nth", F.row_number().over(Window.partitionBy(key, "stance").orderBy(order)))


def best_epochs(history: DataFrame, model: str = "model", epoch: str = "epoch", loss: str = "val_loss", patience: int = 5) -> DataFrame:
    """Adds the best loss so far, epochs since it improved, and whether training has stopped."""
    upto = Window.partitionBy(model).orderBy(epoch)
    best = history.withColumn("best", F.min(loss).over(upto))
    improved = F.max(F.when(F.col(loss) <= F.col("best"), F.col(epoch))).over(upto)
    return best.withColumn("waited", F.col(epoch) - improved).withColumn("stopped", F.max(F.col("waited")).over(upto) >= patience)


def parent_relations(objects: DataFrame, hanging: tuple[str, ...] = (), surfaces: tuple[str, ...] = ()) -> DataFrame:
    """(subject, predicate, object) from each object (object_id, object_type, parents) to its
    parents, the predicate by the parent's type."""
    up = objects.select(F.col("object_id").alias("s"), F.explode("parents").alias("o"))
    kinds = objects.select(F.col("object_id").alias("o"), F.col("object_type").alias("_t"))
    p = F.when(F.col("_t").isin(*hanging) if hanging else F.lit(False), "hangingOn").when(F.col("_t").isin(*surfaces) if surfaces else F.lit(False), "onTopOf").otherwise("inside")
    return up.join(kinds, "o").select("s", p.alias("p"), "o")


def positions(claims: DataFrame, by: str = "split", order: str = "line_idx", cell: int = 100_000) -> DataFrame:
    """Place of each kept claim among its split's graphs, from 0 (only kept ones are given, Q12).

    order is a whole number, such as the line of a record. A split may hold most claims, so they are
    ranked inside ranges of `cell` numbers and shifted by the counts of the ranges before.
    """
    celled = claims.withColumn("_cell", F.floor(F.col(order) / cell))
    inside = Window.partitionBy(by, "_cell").orderBy(order)
    before = Window.partitionBy(by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sizes = celled.groupBy(by, "_cell").agg(F.count("*").alias("_n")).select(F.col(by).alias("_by"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = celled.withColumn("_r", F.row_number().over(inside)).join(sizes, F.col(by).eqNullSafe(F.col("_by")) & F.col("_cell").eqNullSafe(F.col("_c")))
    return ranked.select(*claims.columns, (F.col("_before") + F.col("_r") - 1).alias("graph"))


def skipped(ids: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Skipped ids with what is known of their records."""
    return ids.join(records, key, "left")


def distinct_claims(corpus: DataFrame) -> DataFrame:
    """U8: each claim once by its content: text, triples and label (Q1), the smallest id stays."""
    content = F.sha2(F.concat_ws("\x1f", "claim", F.to_json("claim_triples"), "label"), 256)
    return corpus.groupBy(content.alias("_c")).agg(F.min_by(F.struct(*corpus.columns), "id").alias("x")).select("x.*")


def model_pairs(names: DataFrame, column: str = "model") -> DataFrame:
    """Unordered pairs of the models, the smaller name first, each task with its share of the ranks.

    The names are ranked, and each makes the ranks above its own; the result is all pairs, so it grows with
    the square of the number of models, which are few. There is no limit.
    """
    models = names.select(F.col(column).alias("a")).where(F.col(column).isNotNull()).distinct()
    ranked = _ranked(models, "a", [F.lit(0)], 42)
    above = ranked.select("a", F.explode(F.sequence(F.lit(1).cast("long"), "_all")).alias("_other"))
    other = ranked.select(F.col("a").alias("b"), F.col("_place").alias("_other"))
    return above.join(other, "_other").where(F.col("a") < F.col("b")).select("a", "b")


def extracted_json(text: Column, schema: str) -> Column:
    """the JSON object inside free text, or null if it has none that parses."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"\{[\s\S]*\}", 0), F.lit("")), schema)


def prompt(claim: Column, evidence: Column) -> Column:
    """a claim and its numbered evidence as one text."""
    numbered = F.transform(evidence, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e))
    return F.concat(F.lit("Claim: "), claim, F.lit("\nEvidence:\n"), F.array_join(numbered, "\n"))
