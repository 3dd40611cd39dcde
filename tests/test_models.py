"""Scorers, reports and histories on small tables."""

from pyspark.sql import functions as F

from corroborate.operators import models as O
from corroborate.plans import reports


def test_head_and_registry(spark):
    rows = [(f"a{i}", 0.9, 0.01 * i, "supported") for i in range(9)] + [(f"b{i}", 0.01 * i, 0.9, "refuted") for i in range(9)] + [(f"c{i}", 0.05, 0.01 * i, "not_enough_evidence") for i in range(9)]
    s = spark.createDataFrame([*rows, ("d", 0.9, 0.9, "conflicting_evidence")], "claim_id string, support double, refute double, verdict string")
    out = O.apply_verdict_head(O.fit_verdict_head(s), s).where("verdict <> 'conflicting_evidence'")
    assert out.where("pred = verdict").count() >= 25
    head = O.fit_verdict_head(s)
    hybrid = O.by_hybrid(head)(s)
    assert hybrid.columns == [*s.columns, "pred"] and hybrid.where("verdict <> 'conflicting_evidence' and pred = verdict").count() >= 25
    assert O.by_head(head)(s).columns == hybrid.columns
    assert all(f(s).where("pred = verdict").count() >= 27 for f in O.MODELS.values())
    assert O.theta_search(s.withColumnRenamed("verdict", "label"), thetas=(0.5,)).first().accuracy == round(27 / 28, 4)


def test_payload(spark):
    items = spark.createDataFrame([("a", "x", "supports", 0.5), ("a", "y", "refutes", 0.7)], "claim_id string, source_id string, stance string, confidence double")
    scores = spark.createDataFrame([("a", 0.5, 0.1)], "claim_id string, support double, refute double")
    r = O.payload(items, scores).first()
    assert r.final == "supported" and [e.source_id for e in r.evidence] == ["y", "x"] and r.reason == "support 0.5000, refute 0.1000: symbolic_supported"


def test_early_stopping(spark):
    h = spark.createDataFrame([("m", i, x) for i, x in enumerate([5.0, 4.0, 4.5, 4.0, 4.6, 4.7])], "model string, epoch int, val_loss double")
    assert [(r.best, r.waited, r.stopped) for r in O.best_epochs(h, patience=2).orderBy("epoch").collect()] == [(5.0, 0, False), (4.0, 0, False), (4.0, 1, False), (4.0, 0, False), (4.0, 1, False), (4.0, 2, True)]


def test_small_ones(spark):
    c = spark.createDataFrame([(2, "t", None, "l"), (1, "t", None, "l"), (3, "t", None, "m")], "id int, claim string, claim_triples array<array<string>>, label string")
    assert sorted(r.id for r in O.distinct_claims(c).collect()) == [1, 3]
    df = spark.createDataFrame([('so: {"verdict": "supported"} ok',), ("none",)], "t string")
    assert [r.v and r.v.verdict for r in df.select(O.extracted_json(F.col("t"), "verdict string").alias("v")).collect()] == ["supported", None]


def test_reports(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1)], "k string, n int")
    text = reports.report("Title", {"Counts": df})
    assert "# Title" in text and "| a | 2 |" in text and "Only the first 1 rows" in reports.markdown_table(df, 1)
    deltas = spark.createDataFrame([("acc", 0.5, 0.7, 0.2), ("ece", 0.1, 0.1, 0.0), ("rmse", 0.1, 0.3, -0.2)], "metric string, a double, b double, delta double")
    assert "| acc | 0.5 | 0.7 | 0.2 | new |" in (both := reports.comparison("old", "new", deltas)) and "| rmse | 0.1 | 0.3 | -0.2 | old |" in both
    assert "## Layers" in reports.evaluation_summary("m", {"Counts": df}, df, df, df)
    long = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("n"))
    assert len(reports.bars(long, "k", "n").splitlines()) == 300 and reports.export("m", {"x": long}).count('"n"') == 300  # nothing is cut
    assert reports.bars(df, "k", "n").splitlines()[0].count("#") == 40 and '"n": 2' in reports.export("m", {"x": df})
