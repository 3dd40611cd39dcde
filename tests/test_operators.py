"""Triples, sources, metrics, splits, graphs, converters and generators on small tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corroborate.functions import domains as D
from corroborate.functions import realize as Z
from corroborate.functions import uris as U
from corroborate.functions import webqa as W
from corroborate.operators import convert as C
from corroborate.operators import generate as G
from corroborate.operators import graph as N
from corroborate.operators import metrics as M
from corroborate.operators import models as O
from corroborate.operators import profile as P
from corroborate.operators import resolve as R
from corroborate.operators import splits as S
from corroborate.operators import triples as T
from corroborate.operators import validate as X
from corroborate.sources import records as IO


def value(spark, expr, **fields):
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{k} string" for k in fields)) if fields else spark.range(1)
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "raw, name", [("reuters.com", "reuters"), ("bbc.co.uk", "bbc"), ("news.bbc.co.uk", "news_bbc"), ("indiatoday.in", "indiatoday"), ("localhost", "localhost"), ("a-b.c.org", "a_b_c"), ("co.uk", "co")]
)
def test_domain_names(spark, raw, name):
    assert value(spark, D.registry_name(F.col("x")), x=raw) == name


@pytest.mark.parametrize(
    "domain, modality, expected",
    [
        ("reuters.com", "web_text", "reuters_web_text"), ("uk.reuters.com", "web_text", "reuters_web_text"), ("web.archive.org", "web_text", "webarchive_web_text"),
        ("cdc.gov", "web_text", "government_web_text"), ("cdc.gov", "pdf", "government_pdf"), ("m.facebook.com", "web_text", "social_media_web_text"),
        ("nobody.net", "web_table", "general_web_table"), ("nobody.net", "pdf", "academic_pdf"), ("nobody.net", "web_text", "unknown_web"), (None, "pdf", "unknown_web"),
    ],
)
def test_resolution(spark, domain, modality, expected):
    reg = spark.createDataFrame([("reuters_web_text",), ("government_web_text",), ("government_pdf",)], "source_id string")
    df = spark.createDataFrame([(domain, modality)], "domain string, modality string")
    assert R.resolve_sources(df, reg).first().source_id == expected


def test_urls(spark):
    host = lambda u: value(spark, D.url_host(D.unwrapped_url(F.col("x"))), x=u)
    assert host("https://web.archive.org/web/20200101id_/www.Reuters.com/a") == "reuters.com"
    assert host("https://WWW.a.org:8080/x?y") == "a.org:8080"
    assert host("no url") is None


def test_registry_gaps(spark):
    reg = spark.createDataFrame([("news_pdf", "news", "pdf"), ("x", "news", "web_text")], "source_id string, source_type string, modality string")
    assert [r.source_id for r in R.registry_gaps(reg).collect()] == ["news_web_text"]
    with pytest.raises(ValueError, match="news_web_text"):
        R.checked_registry(reg)


def test_uris(spark):
    assert value(spark, U.short_uri(F.col("x")), x="http://a/b#Mug%7C+01.13%7C2") == "Mug|+01.13|2"
    assert value(spark, U.entity_type(F.col("x")), x="http://a/Mug%7C1") == "Mug"
    assert value(spark, U.entity_type(F.col("x")), x="Table_3") == "Table"
    assert [value(spark, U.flip_boolean(F.col("x")), x=v) for v in (" Yes", "f", "maybe")] == ["False", "True", "True"]
    assert value(spark, U.percent_encode(F.col("x")), x="a b*~+") == "a%20b%2A~%2B"
    assert value(spark, U.percent_decode(F.col("x")), x="100% a+b%2F") in ("100% a+b%2F", "100% a+b/")


def test_triples(spark):
    rows = [("c/1", "hasObject", "m", 1), ("m", "color", "red", 2), ("m", "color", "red", 3), ("n", "inScene", "x/contexts/9", 4), ("z", "p", "o", 5), ("x/contexts/1/a", "hasObject", "m", 6)]
    t = spark.createDataFrame(rows, "s string, p string, o string, ord int")
    assert T.dedupe(t, "ord").count() == 5 and T.match(t, p="color").count() == 2 and T.exists(t, s="z") and not T.exists(t, s="y")
    assert sorted(r.key for r in T.by_context(t, "contexts").collect()) == ["1", "1", "1", "1", "9"]
    assert {r.node for r in T.nodes_of(t, ["color", "p"]).collect()} == {"m", "red", "z", "o"}
    assert {(r.s, r.p): r.is_boolean for r in T.boolean_predicates(t).collect()}[("m", "color")] is False
    assert {r.key for r in T.by_entity(t, r"contexts/\d+", "hasObject", "inScene").collect()} == {"contexts/1", "contexts/9", "UNKNOWN"}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0, "a"), (1, 0, "a"), (1, 1, "b"), (2, 2, "b")], "pred int, label int, g string")
    assert M.accuracy(df).first().accuracy == 0.75
    rows = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in M.per_class(df, 4).collect()}
    assert rows == {0: (1.0, 0.5, 0.6667, 2), 1: (0.5, 1.0, 0.6667, 1), 2: (1.0, 1.0, 1.0, 1), 3: (0.0, 0.0, 0.0, 0)}
    assert M.f1_scores(df, 4).first().asDict() == {"macro_f1": 0.5833, "weighted_f1": 0.75}
    assert [tuple(r) for r in M.confusion(df, 3).orderBy("label").collect()] == [(0, 1, 1, 0), (1, 0, 1, 0), (2, 0, 0, 1)]
    assert {r.g: r.accuracy for r in M.per_group_accuracy(df, "g").collect()} == {"a": 0.5, "b": 1.0}
    assert M.accuracy(df.limit(0)).first().accuracy == 0.0


def test_calibration_and_regression(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (0, 1, [0.75, 0.25])], "pred int, label int, p array<double>")
    assert M.calibration_error(df, "p").first().ece == 0.375
    xy = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)], "x double, y double")
    assert M.pearson(xy, "x", "y").first()[0] == 1.0 and M.pearson(xy.withColumn("y", F.lit(1.0)), "x", "y").first()[0] == 0.0 and M.pearson(xy.limit(1), "x", "y").first()[0] == 0.0
    assert M.rmse(xy, "x", "y").first()[0] == 2.1602
    probs = spark.createDataFrame([([1000.0, 1000.0],)], "l array<double>").select(M.softmax(F.col("l")).alias("p"), M.argmax(F.col("l")).alias("a")).first()
    assert probs.p == [0.5, 0.5] and probs.a == 0


def test_text_rules(spark):
    def rules(text):
        return sorted(i.rule for i in spark.createDataFrame([(text,)], "t string").select(X.text_issues(F.col("t")).alias("i")).first().i)

    assert rules("The apple is on the wooden table.") == []
    assert rules("  ") == ["V8"] and rules(None) == ["V8"]
    assert rules("hot") == ["V11", "V12", "V13", "V14", "V9"]
    assert "V15" in rules("See http://a.b for more apples here.") and "V16" in rules("The Mug|1 is 3% full today.")
    assert rules("The apple is true.").count("V17") == 1


def record(spark, **change):
    item = ("e1", "A sensor saw the mug.", [], None, "sensor", "supports", ["perception"], "sensor_perception", 1.0, None)
    base = {
        "schema_version": "3.0", "id": "r", "claim": "The mug is on the table.", "verdict": ("supported", None, "annotated"), "epistemic": (["perception"], "simulator"),
        "claim_triples": [["m", "on", "t"]], "reasoning": ("one_hop", "direct_observation"), "evidence": [item], "provenance": ("ai2thor", None, None), "meta": ("3.0", "2024-01-01T00:00:00Z", None, None),
    } | change
    return spark.createDataFrame([tuple(base.values())], IO.RECORD)


def test_record_rules(spark):
    rules = lambda **c: sorted(i.rule for r in X.validated(record(spark, **c)).collect() for i in (*r.issues, *r.dataset_issues))
    assert rules() == []
    assert rules(claim_triples=[]) == ["V1"]
    assert rules(verdict=("refuted", None, "annotated")) == ["V21"]
    assert rules(schema_version="2.0") == ["V0"]
    assert rules(epistemic=(["testimony"], "simulator")) == ["V19", "V33"]
    assert "V25" in rules(meta=("3.0", "yesterday", None, None)) and rules(evidence=[]) == ["V0", "V19", "V28"]
    kept, dropped = X.schema_gate(record(spark).union(record(spark, evidence=[])))
    assert (kept.count(), dropped.count()) == (1, 1)


def test_batch(spark):
    df = spark.createDataFrame([("a", "supported", "supported", True, 0), ("b", "refuted", "supported", False, 0)], "id string, verdict string, recomputed string, is_shortcut_breaking boolean, n_missing_fields int")
    r = X.batch_report(df).first()
    assert (r.n, r.n_mismatch, r.shortcut_fraction, r.passed) == (2, 1, 0.5, False)
    assert X.batch_report(df.limit(1)).first().passed and not X.batch_report(df.limit(0)).first().passed


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("label"), (F.col("id") % 20).cast("string").alias("g"))
    s = S.stratified_split(df, "id", "label")
    assert {(r.label, r.split): r.n for r in s.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}[("0", "train")] == int(334 * 0.8)
    assert s.count() == 1000 and s.select("id").distinct().count() == 1000
    g = S.split_groups(df, "g")
    assert g.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty() and g.select("split").distinct().count() == 3
    assert [r.id for r in S.sample(df, "id", 5).collect()] == [r.id for r in S.sample(df.repartition(7), "id", 5).collect()]
    assert S.pick_one(df, ["label"], "id").count() == 3


def test_apportion(spark):
    shares = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "ord int, share double")
    assert [r.n for r in S.apportion(shares, 10).orderBy("ord").collect()] == [4, 3, 3]


def test_graph(spark):
    items = spark.createDataFrame([(1, i) for i in range(8)] + [(2, 0)], "claim_id int, ord int")
    edges = {}
    for r in N.co_evidence(N.indexed_evidence(items)).collect():
        edges.setdefault((r.claim_id, r.src), []).append(r.dst)
    for i in range(8):
        assert sorted(edges[(1, i)]) == sorted(sorted((j for j in range(8) if j != i), key=lambda j: (abs(j - i), j))[:5])
    assert (2, 0) not in edges
    claim = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "claim_id int, ord long, text string")
    ev = spark.createDataFrame([(1, 0, 0, "z"), (1, 1, 0, "x"), (1, 1, 1, "x")], "claim_id int, i int, ord long, text string")
    assert {r.text: r.t for r in N.triple_index(claim, ev).collect()} == {"x": 0, "y": 1, "z": 2}
    kinds = {r.kind: r.n for r in N.edges(N.indexed_evidence(items), claim, ev).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"has_evidence": 9, "connected_to": 9, "co_evidence": 40, "has_triple": 2, "from_triple": 3}


def test_sentences(spark):
    t = lambda form, p, o: value(spark, Z.triple_text(F.col("s"), F.col("p"), F.col("o"), F.lit(form)), s="apple", p=p, o=o)
    assert t("prep", "on", "table") == "An apple is on the table." and t("adj", "dirty", "false") == "The apple is not dirty."
    assert t("attr", "temperature", "RoomTemp") == "The apple's temperature is at room temperature." and t("prop_verb", "weighs", "0.2") == "The apple weighs 0.2 kg."
    assert t("prop_value", "material", "food, glass, tin") == "The apple is made up of food, glass and tin." and t("no form", "x", "y") is None
    join = Z.joined_text(F.col("a"), F.col("b"), F.lit(True), F.lit("apple"))
    assert value(spark, join, a="The apple is hot.", b="The apple is dirty.") == "The apple is hot and dirty."
    assert value(spark, join, a="The apple is made up of food and glass.", b="The apple is dirty.") == "The apple is made up of food and glass, and dirty."
    assert value(spark, Z.type_label(F.col("x")), x="PaperTowelRoll") == "paper towel roll"
    assert value(spark, Z.sentence(F.col("x")), x="  the  mug ") == "The mug."


def test_web_fields(spark):
    assert [value(spark, W.label(F.col("x")), x=v) for v in ("Supported", "cherrypicking", "hm", None)] == ["supported", "conflicting_evidence", "not_enough_evidence", "not_enough_evidence"]
    kinds = [("Web table", "u", "", "web_table"), ("Other", "u", "", "web_text"), ("Other", "", "", "other"), ("Metadata", "", "", "annotator_knowledge"), ("", "", "unanswerable", "unanswerable"), ("YouTube clip", "", "", "video")]
    for m, u, a, expected in kinds:
        assert value(spark, W.modality(F.col("m"), F.col("u"), F.col("a")), m=m, u=u, a=a) == expected
    types = lambda text: value(spark, W.base_types(F.lit("web_text"), F.lit("extractive"), F.col("x")), x=text)
    assert types("GDP grew by 50%") == ["testimony", "comparison_analogy"] and types("40% of it") == ["testimony"]
    assert value(spark, W.answer_only(F.col("x")), x="Question: a? Answer: it is a long answer") == "it is a long answer"
    assert value(spark, W.answer_only(F.col("x")), x="Question: a? Answer: no") == "Question: a? Answer: no"


def test_web_converter(spark):
    answers = [("No", "Boolean", "https://www.reuters.com/a", "Web text", "They said so"), ("It fell", "Abstractive", "https://x.gov/b.pdf", "PDF", None)]
    rows = [("1", "A claim.", "Refuted", None, ["Consultation"], [("Is it?", answers)]), ("2", "No evidence.", "Supported", None, None, [])]
    raw = spark.createDataFrame(rows, IO.WEB_RECORD)
    reg = spark.createDataFrame([("reuters_web_text", 0.85), ("government_pdf", 0.3)], "source_id string, source_trust double")
    found = C.convert("averitec", raw, registry=reg).collect()
    assert [r.id for r in found] == ["1"]
    a, b = found[0].evidence
    assert a.text == "Question: Is it? Answer: No. Explanation: They said so" and a.source_id == "reuters_web_text" and a.inference_strength == 0.8 and a.evidence_types == ["testimony", "inference"]
    assert b.source_id == "government_pdf" and b.inference_strength == 0.3 and b.evidence_types == ["testimony", "inference"] and b.stance == "refutes"
    assert found[0].epistemic.evidence_types_all == ["inference", "testimony"] and found[0].reasoning.strategy == "multi_hop_inference"


def test_simulator_converter(spark):
    raw = record(spark, claim_triples=[["http://x/Mug%7C1", "http://x/on", "http://x/T"], ["bad"]], epistemic=([], "rule_based"))
    r = C.convert("ai2thor", raw).first()
    assert r.claim_triples == [["http://x/Mug|1", "on", "http://x/T"]] and r.epistemic.assignment_method == "simulator" and r.epistemic.evidence_types_all == ["perception"]


def test_generation(spark):
    rows = [("mug_1", "on", "table_1"), ("mug_1", "isDirty", "true"), ("cup_1", "on", "shelf_1"), ("cup_1", "temperature", "Hot"), ("mug_1", "on", "table_1")]
    t = spark.createDataFrame(rows, "s string, p string, o string")
    rules = spark.createDataFrame([("mug", "shelf"), ("cup", "table")], "object_type string, receptacle string")
    bad = {(r.s, r.p): (r.bad_o, r.how) for r in G.corruption_candidates(t, rules).collect()}
    assert bad[("mug_1", "isDirty")] == ("False", "boolean_flip") and bad[("mug_1", "on")] == ("shelf_1", "receptacle_substitution") and bad[("cup_1", "temperature")] == ("Cold", "temperature_change")
    claims = G.one_hop_claims(t, rules, 6).collect()
    truth = set(rows)
    assert all(((c.s, c.p, c.claimed_o) in truth) == (c.label == "supported") for c in claims) and len(claims) == 6
    registry = spark.createDataFrame([("reuters_web_text", 0.85), ("apnews_web_text", 0.82), ("bbc_web_text", 0.85), ("social_media_web_text", 0.35), ("sensor_perception", 1.0), ("academic_pdf", 0.9), ("general_web_text", 0.55)], "source_id string, source_trust double")
    synthetic = {r.template: r.verdict for r in G.synthetic_claims(G.template_table(spark), registry, 300).collect()}
    assert len(synthetic) == 15
    for name, verdict in synthetic.items():  # a template's name says what its items should come to
        want = "supported" if name in ("corroborating_3", "perception_direct", "non_apprehension_absent", "strong_support_weak_refute") or name.endswith("_supported") else None
        want = want or ("not_enough_evidence" if name.endswith("_nee") else "conflicting_evidence" if name == "conflicting" else "refuted")
        assert verdict == want or name == "inference_nee", name
    some = G.synthetic_claims(G.template_table(spark, {"conflicting": 0.5, "perception_direct": 0.5}), registry, 7)
    assert sorted(r["count"] for r in some.groupBy("template").count().collect()) == [3, 4]
    present = spark.createDataFrame([("k1", "mug"), ("k2", "cup")], "context string, object_type string")
    assert sorted(tuple(r) for r in G.absence_draws(present, present, 9).collect()) == [("k1", "cup"), ("k2", "mug")]


def test_absence_has_no_limit(spark):
    """50,000 types and a few that are none; what is absent is exact."""
    universe = spark.range(50_000).select(F.concat(F.lit("t"), "id").alias("object_type")).union(spark.createDataFrame([("None",), ("true",), (None,)], "object_type string"))
    present = spark.range(0, 50_000, 2).select(F.lit("k").alias("context"), F.concat(F.lit("t"), "id").alias("object_type")).union(spark.createDataFrame([("other", "t1")], "context string, object_type string"))
    counts = {r.context: (r.n_present, r.n_absent) for r in G.absent_counts(universe, present).collect()}
    assert counts == {"k": (25_000, 25_000), "other": (1, 49_999)}
    every = present.select("context").distinct().crossJoin(universe)
    asked = G.absent_among(every, universe, present)
    assert {r.context: r["count"] for r in asked.groupBy("context").count().collect()} == {"k": 25_000, "other": 49_999}
    drawn = G.absence_draws(universe, present, 25_100)
    assert {r.context: r["count"] for r in drawn.groupBy("context").count().collect()} == {"k": 25_000, "other": 25_100}
    assert drawn.join(present, ["context", "object_type"]).isEmpty() and drawn.distinct().count() == drawn.count()


def test_absence_draws_follow_the_ring(spark):
    """Against a walk over the sorted list of types, with contexts that lack few or no types; no table of all pairs."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    types = [f"type{i}" for i in range(30)]
    has = {f"c{k}": {t for i, t in enumerate(types) if (i * 7 + k) % 30 < k} for k in range(1, 31)}
    present = spark.createDataFrame([(c, t) for c, ts in has.items() for t in ts] + [("c1", "unheard of")], "context string, object_type string")
    universe = spark.createDataFrame([(t,) for t in types * 2] + [(None,)], "object_type string")
    ring = sorted(types, key=lambda t: (md5(f"42-{t}"), t))
    want = set()
    for c, ts in has.items():
        start = int(md5(f"42-ring-{c}")[:8], 16) % 30
        want |= {(c, t) for t in [t for t in ring[start:] + ring[:start] if t not in ts][:4]}
    found = G.absence_draws(universe, present, 4)
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert not any(c == "c30" for c, _ in want)  # it has them all
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    empty = present.limit(0)
    assert G.absence_draws(universe, empty, 4).collect() == [] == G.absence_draws(universe.limit(0), present, 4).collect()
    assert G.absence_claims(universe, present, 2).groupBy("label").count().count() == 2


def test_conjunctions(spark):
    """Each mode corrupts what it says, what can't be corrupted isn't made, labels follow."""
    rows = [(f"e{i}", p, o) for i in range(40) for p, o in (("is", "true"), ("temperature", "Hot"), ("zname", f"n{i}"))]
    claims = G.conjunction_claims(spark.createDataFrame(rows, "s string, p string, o string"), spark.createDataFrame([], "object_type string, receptacle string")).collect()
    assert {c["mode"] for c in claims} == {0, 1, 2, 3}
    for c in claims:
        first, second = c.o != c.true_o, c.o2 != c.true_o2
        assert (c.label == "supported") == (c["mode"] == 0) == (not first and not second)
        assert not (c["mode"] == 1 and second) and not (c["mode"] == 2 and first)
    assert any(c.o != c.true_o and c.o2 != c.true_o2 for c in claims)


def test_contexts(spark):
    t = spark.createDataFrame([(f"k{i % 4}", f"e{i}", "is", "true") for i in range(40)], "key string, s string, p string, o string")
    rules = spark.createDataFrame([], "object_type string, receptacle string")
    made = G.context_claims(t, rules, 6)
    assert {(r.key, r.label): r["count"] for r in made.groupBy("key", "label").count().collect()} == {(f"k{i}", x): 3 for i in range(4) for x in ("supported", "refuted")}
    assert {r.context for r in G.first_contexts(t.withColumnRenamed("key", "context"), 2).collect()} == {"k0", "k1"}


def test_templates_of_sentences(spark):
    assert value(spark, Z.filled("The {s} is {o}.", {"s", "o"}, s=F.lit("cup"), o=F.lit("red"))) == "The cup is red."
    with pytest.raises(ValueError, match="without"):
        Z.filled("The {s}.", {"s", "o"}, s=F.lit("cup"), o=F.lit("red"))
    with pytest.raises(ValueError, match="no value"):
        Z.filled("The {s} {x}.", s=F.lit("cup"))


def test_dataset_rules_are_pluggable(spark):
    X.register_rules("other", lambda: F.array(F.struct(F.lit("X1").alias("rule"), F.lit("dataset").alias("category"), F.lit("error").alias("severity"))))
    row = lambda d: spark.range(1).select(F.from_json(F.lit('{"provenance": {"dataset": "%s"}}' % d), IO.RECORD).alias("x")).select("x.*")
    rules = lambda d: [i.rule for i in X.validated(row(d)).first().dataset_issues]
    assert rules("other") == ["X1"] and rules("none") == [] and "V28" in rules("ai2thor") and "V38" in rules("averitec")
    del X._DATASET_RULES["other"]


def test_positions_across_ranges(spark):
    c = spark.createDataFrame([("a", i) for i in range(0, 500, 3)] + [("b", i) for i in range(7)], "split string, line_idx long")
    got = {(r.split, r.line_idx): r.graph for r in O.positions(c, cell=10).collect()}
    assert got == {**{("a", i): k for k, i in enumerate(range(0, 500, 3))}, **{("b", i): i for i in range(7)}}


def test_config_and_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert IO.load_config(str(tmp_path / "c.json")) == {"a": {"b": 1}}
    at = str(tmp_path / "cache")
    build = lambda n: lambda: spark.range(n)
    assert IO.cached_frame(spark, at, "1", build(3)).count() == 3
    assert IO.cached_frame(spark, at, "1", build(5)).count() == 3 and IO.cached_frame(spark, at, "2", build(5)).count() == 5


def test_profiles(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x"]), ("b", None)], "k string, t array<string>")
    counts = P.distributions(df, {"k": F.col("k"), "t": F.col("t")})
    assert {(r.dim, r.key): r.n for r in counts.collect()} == {("k", "a"): 2, ("k", "b"): 1, ("t", "x"): 2, ("t", "y"): 1}
    assert P.search(df, equals={"k": ""}).count() == 3 and P.search(df, equals={"k": "a"}).count() == 2


def test_sources(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id": "a", "claim": "é"}\n\nnot json\n{"id": "b"}\n', encoding="utf-8")
    assert sorted(r.id for r in IO.read_jsonl(spark, str(p)).where("id is not null").collect()) == ["a", "b"]
    assert [(r.line_idx, r.value[:3]) for r in IO.with_line_index(spark, str(p)).collect()] == [(0, '{"i'), (1, "not"), (2, '{"i')]
    q = tmp_path / "o.json"
    q.write_text('{"a": 1}')
    with pytest.raises(ValueError, match="list"):
        IO.read_json_array(spark, str(q))
    q.write_text('[{"id": "1"}, {"id": "2"}]')
    assert IO.read_json_array(spark, str(q)).count() == 2
    t = spark.createDataFrame([("http://a", "http://p", "http://b"), ("http://a", "http://p", 'say "hi"')], "s string, p string, o string")
    IO.write_ntriples(t, str(tmp_path / "nt"))
    assert sorted(tuple(r) for r in IO.read_ntriples(spark, str(tmp_path / "nt")).collect()) == sorted(tuple(r) for r in t.collect())
    (tmp_path / "x.ttl").write_text('@prefix e: <http://e/> .\ne:a e:p e:b , "lit" ; a e:T .\n<http://x> e:q 0.5 .\n')
    found = {tuple(r) for r in IO.read_turtle(spark, str(tmp_path / "x.ttl")).collect()}
    assert found == {("http://e/a", "http://e/p", "http://e/b"), ("http://e/a", "http://e/p", "lit"), ("http://e/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T"), ("http://x", "http://e/q", "0.5")}
    assert IO.markdown_table(["x", "| a | b |", "|---|---|", "| 1 | 2 |"]) == [{"a": "1", "b": "2"}]


def test_scene(spark):
    rows = [("s1", "Mug|1", "Mug", {"isDirty": "true", "secret": None}, [("onTopOf", "Table|1")])]
    objects = spark.createDataFrame(rows, "scene_id string, object_id string, object_type string, properties map<string,string>, relations array<struct<predicate: string, object: string>>")
    ontology = spark.createDataFrame([("isDirty", "http://k/relations/isDirty"), ("onTopOf", "http://k/relations/onTopOf")], "name string, uri string")
    found = {(r.s.split("/")[-1], r.p.split("/")[-1].split("#")[-1], r.o.split("/")[-1]) for r in T.scene_triples(objects, ontology, "http://k").collect()}
    assert found == {("s1", "hasObject", "Mug%7C1"), ("Mug%7C1", "type", "Mug"), ("Mug%7C1", "isDirty", "true"), ("Mug%7C1", "onTopOf", "Table%7C1")}


def test_stream(spark, tmp_path):
    from corroborate.streaming.scores import windowed_scores

    schema = "claim_id string, stance string, evidence_types array<string>, inference_strength double, source_id string, ts timestamp"
    rows = [("c", "supports", ["testimony"], 0.8, "s", "2024-01-01 01:00:00"), ("c", "supports", ["testimony"], 0.8, "s", "2024-01-01 02:00:00"), ("c", "refutes", ["testimony"], 0.8, "s", "2024-01-05 01:00:00")]
    spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    reg = spark.createDataFrame([("s", 0.85)], "source_id string, source_trust double")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = windowed_scores(stream, reg).writeStream.outputMode("complete").format("memory").queryName("scores_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.support, r.refute, r.verdict) for r in spark.table("scores_out").collect()) == [(0.0, 0.703, "not_enough_evidence"), (0.9118, 0.0, "supported")]


def test_scenes_and_seeds(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"graph_id": "g",\n "objects": [{"object_id": "Mug|1", "object_type": "Mug", "properties": {"isDirty": "true"}, "parents": ["T"]}]}')
    r = IO.objects_of_scenes(IO.read_scenes(spark, str(tmp_path / "s.json"))).first()
    assert (r.scene_id, r.object_id, r.properties, r.parents) == ("g", "Mug|1", {"isDirty": "true"}, ["T"])
    pool = IO.seed_pool(spark.createDataFrame([("Iron is heavy.", "testimony", "d", "A book says so.", "A book denies it.")], IO.SEED_POOL))
    items = spark.createDataFrame([("c", i, s, "testimony", x) for i, (s, x) in enumerate([("supports", 0.8), ("supports", 0.8), ("refutes", 0.2)])], "claim_id string, ord int, stance string, evidence_type string, strength double")
    texts = {r.ord: r.text for r in G.grounded_items(items, pool).collect()}
    assert texts[0] == "A book says so." and texts[1].endswith(" a book says so.") and texts[2].endswith(" a book denies it.")


def test_assert_valid(spark):
    assert X.assert_valid(record(spark)).count() == 1
    with pytest.raises(ValueError, match="r: .*V21"):
        X.assert_valid(record(spark, verdict=("refuted", None, "annotated")))


def test_absent_pairs_are_all_there(spark):
    """Every pair that isn't present (F2 and F3 of round 3), over several blocks of types, with null contexts and types."""
    types = [f"t{i}" for i in range(2500)]
    has = {"a": types[::2], "b": ["t1", "unheard of"], "c": types, None: ["t3"]}
    universe = spark.createDataFrame([(t,) for t in types * 2] + [(" None ",), (None,)], "object_type string")
    present = spark.createDataFrame([(c, t) for c, ts in has.items() for t in ts] + [("a", None), ("a", "t0")], "context string, object_type string")
    found = [tuple(r) for r in G.absent_types(universe, present).collect()]
    assert len(found) == len(set(found)) and set(found) == {(c, t) for c, ts in has.items() for t in set(types) - set(ts)}
    assert G.absent_types(universe.limit(0), present).collect() == [] == G.absent_types(universe, present.limit(0)).collect()


def test_absence_queries_return_every_pair(spark):
    """F2, F3 of round 3: a row a pair of context and type, neither counts nor a few draws."""
    from corroborate.plans.triple_queries import QUERIES

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no test data")
    counts = QUERIES["absent_counts"][0](spark, d).agg(F.sum("n_absent")).first()[0]
    assert QUERIES["absent_types"][0](spark, d).count() == QUERIES["realize_absence"][0](spark, d).count() == counts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corruptions_are_dealt_by_rows(spark):
    """F4 to F7, F9, F12 of round 3: tasks get a bounded number of triples, repeats and true candidates among them."""
    rows = [(f"{k}_{i}", "is", ("true", "No", "Hot", "x")[i % 4]) for k in ("mug", "cup") for i in range(40)] + [("mug_0", "is", "False"), ("mug_1", "in", "shelf_2"), ("mug_1", "in", "shelf_1")]
    rules = spark.createDataFrame([("mug", "shelf"), ("cup", "table")], "object_type string, receptacle string")
    t = spark.createDataFrame(rows * 3, "s string, p string, o string")
    few, many = (G.corruption_candidates(t, rules, n=n) for n in (1, 7))
    assert many.rdd.getNumPartitions() == 7 and sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    found = {(r.s, r.p, r.o): (r.how, r.bad_o) for r in many.collect()}
    assert found["cup_0", "is", "true"] == ("boolean_flip", "False") and found["mug_2", "is", "Hot"] == ("temperature_change", "Cold")
    assert found["mug_0", "is", "true"][0] == "receptacle_substitution"  # what the flip gives is true
    assert ("cup_3", "is", "x") not in found and len(found) == len(set(rows)) - 10 - 2  # no table to put cups on; mug_1 is on both shelves
    tried = G.attempts(t, rules)
    assert tried.where("label = 'supported'").count() == len(set(rows)) and tried.where("how is not null").count() == len(found)


def test_frequent_terms_are_no_group_of_one_task(spark):
    """F8 of round 3: a term of most triples is told to every task; keys are the same, nulls and repeats among the terms."""
    rows = [(f"e{i}", "is", "false", i) for i in range(50)] + [(None, "is", "false", 90), ("e1", "is", None, 91), ("c1", "hasObject", "e1", 92), ("c2", "hasObject", "false", 93), ("e3", "near", "e1", 94), ("e3", "near", "e1", 94)]
    t = spark.createDataFrame(rows, "s string, p string, o string, ord int")
    mapping = spark.createDataFrame([("e1", "c1"), ("false", "c2"), (None, "never")], "node string, value string")
    direct = F.nullif(F.regexp_extract(F.coalesce("s", F.lit("")), "c[0-9]", 0), F.lit(""))
    cold, hot = (sorted(map(repr, T._mapped(t, direct, mapping, hot=n).select("s", "p", "o", "ord", "key").collect())) for n in (1000, 3))
    assert cold == hot and len(hot) == len(rows) and sum("key='c2'" in r for r in hot) == 51
    assert "Broadcast" in plan_of(T._mapped(t, direct, mapping))


def test_lexicon_goes_to_the_triples(spark):
    """F10, F11 of round 3: most triples share a few predicates, so they aren't dealt by predicate."""
    t = spark.createDataFrame([(f"http://e/x{i}", "http://e/relations/mass", "1") for i in range(9)], "s string, p string, o string")
    found = T.with_labels(t, spark.createDataFrame([("mass", "weighs", "prop_verb")], "predicate string, label string, form string"))
    assert "SortMergeJoin" not in plan_of(found) and "hashpartitioning" not in plan_of(found) and found.count() == 9


def test_scene_triples_shuffle_objects_once(spark):
    """F13 of round 3: objects are dealt, not each of their triples, and they are read once; still a set."""
    kinds = "scene_id string, object_id string, object_type string, properties map<string,string>, relations array<struct<predicate: string, object: string>>"
    rows = [("k", "cup|1", "Cup", {"is": "http://k/types/Cup", "no": "x", "mass": None}, [("on", "table|1"), None, ("none", "y")]), ("k", None, None, None, None)]
    ontology = spark.createDataFrame([("is", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"), ("on", "http://k/relations/onTopOf"), ("mass", "http://k/mass")], "name string, uri string")
    found = T.scene_triples(spark.createDataFrame(rows * 2, kinds), ontology, "http://k")
    got = [tuple(r) for r in found.collect()]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Union" not in plan
    assert len(got) == len(set(got)) and {t for t in got if t[0] and "cup" in t[0]} == {("http://k/entities/cup%7C1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://k/types/Cup"), ("http://k/entities/cup%7C1", "http://k/relations/onTopOf", "http://k/entities/table%7C1")}


def test_issues_are_made_once(spark):
    """Rules run once a record: no filter on the issues' number repeats them below."""
    texts = spark.range(9).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("see http://x.org/"), F.col("id").cast("string"))).alias("claim"))
    checked = texts.select(X.text_issues(F.col("claim")).alias("issues"))
    found = X.issue_counts(checked)
    counts = {r.rule: r.n for r in found.collect()}
    assert counts["V8"] == 3 and counts["V11"] == counts["V12"] == counts["V13"] == counts["V15"] == 6
    assert found._jdf.queryExecution().optimizedPlan().toString().count("V15") == 1
    odd = spark.createDataFrame([([("a", "c", "e"), None, ("a", "c", "e")],), ([],), (None,)], "issues array<struct<rule: string, category: string, severity: string>>")
    assert {(r.rule, r.n) for r in X.issue_counts(odd).collect()} == {("a", 2), (None, 1)}
