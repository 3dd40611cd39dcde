"""Confidence of evidence: known values, and random claims recomputed in plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.functions import vocab as V
from corroborate.operators import evidence as E
from corroborate.operators import models as O
from corroborate.operators.graph import elu, sigmoid


@pytest.mark.parametrize(
    "types, expected",
    [
        (["perception"], 0.95), (["testimony"], 0.80), (["perception", "inference"], 0.9775), (["perception", "testimony"], 0.99),
        (["comparison_analogy", "testimony"], 0.93), (["perception", "comparison_analogy", "testimony"], 0.9965), ([], 0.0), (["no such type"], 0.0), (None, 0.0),
    ],
)
def test_weight(spark, types, expected):
    df = spark.createDataFrame([(types,)], "t array<string>")
    assert df.select(formula.evidence_weight(F.col("t"))).first()[0] == expected


def test_custom_weights(spark):
    df = spark.createDataFrame([(["perception", "testimony"],)], "t array<string>")
    assert df.select(formula.evidence_weight(F.col("t"), {"perception": 0.5, "testimony": 0.5})).first()[0] == 0.75


CASES = [
    ([("supports", 0.85, "testimony", 0.8)] * 2, 0.9118, 0.0, "supported"),
    ([("supports", 0.35, "testimony", 0.6)], 0.1868, 0.0, "not_enough_evidence"),
    ([("refutes", 0.40, "testimony", 0.5)], 0.0, 0.1848, "not_enough_evidence"),
    ([("supports", 0.85, "testimony", 0.8), ("refutes", 0.85, "testimony", 0.8)], 0.7030, 0.7030, "conflicting_evidence"),
    ([("supports", 0.85, "testimony", 0.8)] * 2 + [("refutes", 0.35, "testimony", 0.4)], 0.9118, 0.1288, "supported"),
    ([("supports", 1.0, "perception", 1.0)], 1.0, 0.0, "supported"),
    ([("supports", 0.90, "inference", 0.5)] * 2, 0.7181, 0.0, "not_enough_evidence"),
    ([("supports", 0.85, "comparison_analogy", 0.7)] * 2, 0.8221, 0.0, "supported"),
    ([("supports", 1.0, "perception", 0.0)], 0.0, 0.0, "not_enough_evidence"),
]


def test_claims(spark):
    rows = [(i, s, t, [k], x, f"{i}-{j}") for i, (items, *_) in enumerate(CASES) for j, (s, t, k, x) in enumerate(items)]
    ev = spark.createDataFrame(rows, "claim_id int, stance string, trust double, evidence_types array<string>, inference_strength double, source_id string")
    reg = ev.select("source_id", F.col("trust").alias("source_trust"))
    found = {r.claim_id: (r.support, r.refute, r.verdict) for r in E.claim_verdicts(ev.drop("trust"), reg).collect()}
    assert found == {i: tuple(c[1:]) for i, c in enumerate(CASES)}


def test_defaults(spark):
    ev = spark.createDataFrame([(1, "supports", ["testimony"], None, "nobody")], "claim_id int, stance string, evidence_types array<string>, inference_strength double, source_id string")
    reg = spark.createDataFrame([("x", 0.9)], "source_id string, source_trust double")
    r = E.score_items(ev, reg).first()
    assert r.source_trust == 0.40 and r.confidence == round(1 - 0.6 ** (0.8 * 0.6), 4)


def test_random_claims(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for i in range(60):
        product = {"supports": 1.0, "refutes": 1.0}
        for j in range(rng.randint(1, 6)):
            stance, kinds = rng.choice(V.STANCES), rng.sample(V.EVIDENCE_TYPES, rng.randint(1, 3))
            trust, strength = rng.random(), rng.random()
            rows.append((i, stance, kinds, strength, f"{i}-{j}", trust))
            w = round(1 - math.prod(1 - V.EVIDENCE_WEIGHTS[k] for k in kinds), 4)
            if stance in product:
                product[stance] *= 1 - round(1 - (1 - trust) ** (w * strength), 4)
        expected[i] = (1 - product["supports"], 1 - product["refutes"])
    ev = spark.createDataFrame(rows, "claim_id int, stance string, evidence_types array<string>, inference_strength double, source_id string, source_trust double")
    found = E.claim_scores(E.score_items(ev.drop("source_trust"), ev.select("source_id", "source_trust")), digits=None).collect()
    assert len(found) == 60
    for r in found:
        assert r.support == pytest.approx(expected[r.claim_id][0], abs=2e-4) and r.refute == pytest.approx(expected[r.claim_id][1], abs=2e-4)


def test_decision_path(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.5, 0.35), (0.1, 0.4), (0.35, 0.35)], "support double, refute double")
    assert [r.path for r in E.with_decision_path(df).collect()] == ["vh_conflict", "symbolic_supported", "symbolic_refuted", "vh_fallback"]


def test_training(spark):
    df = spark.createDataFrame([("supported", ["perception"]), ("conflicting_evidence", ["perception"]), ("refuted", ["postulation_derivation"]), ("refuted", None)], "verdict string, evidence_types_all array<string>")
    assert [r.excluded for r in E.training_claims(df).collect()] == [None, "conflicting_evidence", "no_training_type", "no_training_type"]


def test_clean_and_first_seen(spark):
    rows = [(1, 0, "A fact."), (1, 1, " a FACT. "), (1, 2, "No sensor evidence found for this object type."), (1, 3, "The described compound is here"), (1, 4, "  "), (1, 5, None), (2, 0, "A fact.")]
    df = spark.createDataFrame(rows, "claim_id int, ord int, text string")
    kept = E.first_seen(E.clean(df), ["claim_id"], ["ord"])
    assert sorted((r.claim_id, r.ord) for r in kept.collect()) == [(1, 0), (2, 0)]


def test_encoders(spark):
    df = spark.createDataFrame([("pdf", ["testimony", "inference"], "supports"), ("unanswerable", [], "conflicting_evidence")], "m string, t array<string>, s string")
    a, b = df.select(V.one_hot(F.col("m"), V.ENCODED_MODALITIES, "unknown").alias("m"), V.multi_hot(F.col("t"), V.TRAINING_TYPES).alias("t"), V.stance_code(F.col("s")).alias("s")).collect()
    assert a.m.index(1.0) == 5 and b.m.index(1.0) == 9 and a.t == [0, 1, 0, 0, 1] and b.t == [0] * 5 and (a.s, b.s) == (0, 2)


def test_small_functions(spark):
    r = spark.createDataFrame([(0.0,)], "x double").select(elu(F.col("x") - 1).alias("e"), sigmoid(F.col("x")).alias("s")).first()
    assert r.e == pytest.approx(math.exp(-1) - 1) and r.s == 0.5


def test_scores_round_as_sql_does(spark):
    """1 - 0.75 * 0.775 lies a bit below 0.41875: scaled by 10,000 it is a tie, which goes up (F1 of round 3)."""
    items = spark.createDataFrame([("a", "supports", 0.25), ("a", "supports", 0.225), ("b", "refutes", 0.12344)], "claim_id string, stance string, confidence double")
    found = {r.claim_id: r for r in E.claim_scores(items).collect()}
    assert (found["a"].support, found["a"].refute, found["b"].refute) == (0.4188, 0.0, 0.1234)
    scored = E.claim_scores(items)
    reasons = {r.claim_id: r.reason for r in O.payload(items.withColumn("source_id", F.lit("s")), scored).collect()}
    assert reasons["a"] == "support 0.4188, refute 0.0000: symbolic_supported"
