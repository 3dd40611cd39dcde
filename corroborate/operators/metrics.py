"""Classification, calibration and regression metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.functions import vocab as V


def softmax(logits: Column) -> Column:
    """shifted by the largest logit."""
    powers = V.let(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return V.let(powers, lambda p: V.let(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(p, lambda x: x / total)))


def argmax(values: Column) -> Column:
    """Place of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def accuracy(df: DataFrame, pred: str = "pred", label: str = "label") -> DataFrame:
    """One row; no rows give 0."""
    return df.agg(F.round(F.coalesce(F.avg((F.col(pred) == F.col(label)).cast("double")), F.lit(0.0)), 4).alias("accuracy"), F.count("*").alias("n"))


def class_table(df: DataFrame, classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """tp, predicted and support of every class, also of those that don't occur.

    Each row is counted under its label and its prediction in one aggregate; the spine of classes
    is a literal of `classes` rows.
    """
    both = df.select(F.explode(F.array(F.struct(F.col(label).alias("class"), F.lit(1).alias("is_label"), (F.col(pred) == F.col(label)).cast("int").alias("hit")), F.struct(F.col(pred).alias("class"), F.lit(0).alias("is_label"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    found = both.groupBy("class").agg(F.sum("hit").alias("tp"), F.sum("is_label").alias("support"), F.sum(1 - F.col("is_label")).alias("predicted"))
    spine = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    return spine.join(found, "class", "left").na.fill(0, ["tp", "support", "predicted"])


def per_class(df: DataFrame, classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """Precision, recall, F1 and support of every class; nothing to divide by gives 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    t = class_table(df, classes, pred, label).withColumn("p", ratio("tp", "predicted")).withColumn("r", ratio("tp", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return t.select("class", F.round("p", 4).alias("precision"), F.round("r", 4).alias("recall"), F.round(f1, 4).alias("f1"), f1.alias("_f1"), "support")


def f1_scores(df: DataFrame, classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """Macro F1 over all classes, and F1 weighted by support."""
    return per_class(df, classes, pred, label).agg(
        F.round(F.avg("_f1"), 4).alias("macro_f1"),
        F.round(F.coalesce(F.try_divide(F.sum(F.col("_f1") * F.col("support")), F.sum("support")), F.lit(0.0)), 4).alias("weighted_f1"),
    )


def confusion(df: DataFrame, classes: int, pred: str = "pred", label: str = "label") -> DataFrame:
    """A row for each true class, a column for each prediction."""
    counts = [F.count_if(F.col(pred) == k).alias(f"pred_{k}") for k in range(classes)]
    found = df.groupBy(F.col(label).alias("label")).agg(*counts)
    spine = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return spine.join(found, "label", "left").na.fill(0)


def calibration_error(df: DataFrame, probabilities: str, pred: str = "pred", label: str = "label", bins: int = 10) -> DataFrame:
    """Mean gap of confidence and accuracy over equal bins, weighted by their rows; the last is closed."""
    c = F.array_max(probabilities)
    binned = df.select(F.least(F.floor(c * bins), F.lit(bins - 1)).alias("bin"), c.alias("c"), (F.col(pred) == F.col(label)).cast("double").alias("hit"))
    each = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("c").alias("c"), F.avg("hit").alias("a"))
    return each.agg(F.round(F.coalesce(F.try_divide(F.sum(F.abs(F.col("c") - F.col("a")) * F.col("n")), F.sum("n")), F.lit(0.0)), 4).alias("ece"))


def rmse(df: DataFrame, x: str, y: str) -> DataFrame:
    """A28."""
    return df.agg(F.round(F.coalesce(F.sqrt(F.avg(F.pow(F.col(x) - F.col(y), 2))), F.lit(0.0)), 4).alias("rmse"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Under two rows or without variance 0. Population moments merge between tasks without cancelling."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    r = F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), spread), F.lit(0.0)))
    return df.agg(F.round(r, 4).alias("pearson_r"))


def per_group_accuracy(df: DataFrame, group: str, pred: str = "pred", label: str = "label") -> DataFrame:
    """A30."""
    return df.groupBy(group).agg(F.round(F.avg((F.col(pred) == F.col(label)).cast("double")), 4).alias("accuracy"), F.count("*").alias("support"))


def path_stats(df: DataFrame, path: str = "path", source: str = "source", pred: str = "pred", label: str = "label") -> DataFrame:
    """Rows and accuracy of each decision path, overall (source null) and by source.

    One pass of grouping sets; every path has a row under every source, with 0 rows and no accuracy
    where it doesn't occur: the array of all paths is unfolded beside each source's counts.
    """
    hit = (F.col(pred) == F.col(label)).cast("double")
    sets = df.groupingSets([[F.col(path)], [F.col(source), F.col(path)]], F.col(path), F.col(source))
    counts = sets.agg(F.grouping(source).alias("every"), F.count("*").alias("n"), F.avg(hit).alias("a"))
    found = counts.groupBy("every", source).agg(F.map_from_entries(F.collect_list(F.struct(F.col(path), F.struct("n", "a")))).alias("by_path"))
    rows = found.select(source, "by_path", F.explode(F.array(*map(F.lit, V.PATHS))).alias(path))
    cell = F.try_element_at("by_path", F.col(path))
    return rows.select(source, path, F.coalesce(cell["n"], F.lit(0)).alias("n"), F.round(cell["a"], 4).alias("accuracy"))


def path_summary(df: DataFrame, path: str = "path") -> DataFrame:
    """One row: decisions by the scores and by the learned head, and the former's percentage."""
    symbolic = F.col(path).startswith("symbolic_")
    out = df.agg(F.count_if(symbolic).alias("n_symbolic"), F.count_if(~symbolic).alias("n_learned"), F.count("*").alias("n"))
    return out.withColumn("symbolic_pct", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("n_symbolic"), F.col("n")), F.lit(0.0)), 1))


def conflict_cases(df: DataFrame, key: str, path: str = "path", pred: str = "pred", label: str = "label") -> DataFrame:
    """The predictions on conflicting scores, with scores at 4 digits and whether they are right."""
    scores = (F.round(c, 4).alias(c) for c in ("support", "refute"))
    return df.where(F.col(path) == "vh_conflict").select(key, "source", label, pred, *scores, (F.col(pred) == F.col(label)).alias("correct"))


def macro_f1(classes: tuple, pred: str = "pred", label: str = "label") -> Column:
    """A24 as an aggregate over given classes; a class without hits has 0."""
    both = lambda c: F.count_if((F.col(pred) == c) & (F.col(label) == c))
    of = lambda c: F.coalesce(F.try_divide(F.lit(2.0) * both(c), F.count_if(F.col(pred) == c) + F.count_if(F.col(label) == c)), F.lit(0.0))
    return F.round(sum((of(c) for c in classes), F.lit(0.0)) / len(classes), 4)


def layer_metrics(df: DataFrame, classes: tuple, path: str = "path", pred: str = "pred", label: str = "label") -> DataFrame:
    """Coverage, accuracy and macro F1 of the symbolic and of the learned layer."""
    layer = F.when(F.col(path).startswith("symbolic_"), F.lit("ec_symbolic")).otherwise(F.lit("verdicthead"))
    each = df.groupBy(layer.alias("layer")).agg(F.count("*").alias("n"), F.avg((F.col(pred) == F.col(label)).cast("double")).alias("a"), macro_f1(classes, pred, label).alias("macro_f1"))
    return each.select("layer", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("coverage"), F.round("a", 4).alias("accuracy"), "macro_f1")


def subset_metrics(df: DataFrame, classes: tuple, pred: str = "pred", label: str = "label") -> DataFrame:
    """Rows, accuracy and macro F1 of a subset, such as the claims made to break shortcuts."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg((F.col(pred) == F.col(label)).cast("double")), 4).alias("accuracy"), macro_f1(classes, pred, label).alias("macro_f1"))


def class_weights(df: DataFrame, classes: int, label: str = "label") -> DataFrame:
    """N / (K max(n, 1)) for every class; N counts the rows of the K classes."""
    found = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    filled = spine.join(found, "class", "left").na.fill(0, ["n"])
    return filled.select("class", "n", F.round(F.sum("n").over(Window.partitionBy()) / (classes * F.greatest("n", F.lit(1))), 6).alias("weight"))


def majority(df: DataFrame, by: str, label: str) -> DataFrame:
    """Most frequent label of each group (the smaller of equals), its share and the rows."""
    pairs = df.groupBy(by, label).agg(F.count("*").alias("n"))
    ranked = pairs.groupBy(by).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.collect_list(F.struct("n", label)).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["n"] == F.col("top")), lambda x: x[label]))
    return ranked.select(by, first.alias("majority"), F.round(F.col("top") / F.col("total"), 4).alias("share"), F.col("total").alias("n"))


def failure_pattern(
    support: Column, refute: Column, pred: Column, label: Column, placeholder: Column, qa_format: Column, theta: float = 0.35, low: float = 0.20
) -> Column:
    """A44 (fixed values: the names of the kinds): kind of each prediction: missing, right, against the scores, without scores, on
    placeholder or question-answer texts, or plainly wrong, in this order."""
    against = ((refute > theta) & (pred != "refuted")) | ((support > theta) & (pred != "supported"))
    return (
        F.when(pred.isNull(), F.lit("error"))
        .when(pred == label, F.lit("correct"))
        .when(against, F.lit("ec_override_fix"))
        .when(F.greatest(support, refute) < low, F.lit("all_neutral_ec"))
        .when(placeholder, F.lit("placeholder_ev"))
        .when(qa_format, F.lit("qa_format_ev"))
        .otherwise(F.lit("genuine_error"))
    )


def model_deltas(a: DataFrame, b: DataFrame, lower_is_better: tuple[str, ...] = ("ece", "rmse")) -> DataFrame:
    """(metric, value) of two models side by side and the gain of b over a."""
    both = a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), "metric", "full")
    gain = F.col("b") - F.col("a")
    return both.withColumn("delta", F.round(F.when(F.col("metric").isin(*lower_is_better), -gain).otherwise(gain), 4))
