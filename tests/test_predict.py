"""Prediction from raw records to explained verdicts."""

from pyspark.sql import functions as F

from corroborate.operators import models as O
from corroborate.operators import pairs as P
from corroborate.operators import predict as PR

ITEM = "struct<text: string, triples: array<array<string>>, modality: string, stance: string, evidence_types: array<string>, source_id: string, inference_strength: double, source_url: string>"
SCHEMA = f"id string, claim string, claim_triples array<array<string>>, evidence array<{ITEM}>"


def item(text="said", stance="supports", source=None, url=None, types=("testimony",), strength=1.0, triples=None, modality="web_text"):
    return (text, triples, modality, stance, list(types) if types else None, source, strength, url)


ROWS = [
    ("own", "The cup is red.", [["cup", "is", "red"]], [item(source="known"), item(source="known", stance="refutes", strength=0.1)]),
    ("url", "A", None, [item(url="https://www.example.com/x.html", source="unheard of")]),
    ("gov", "B", None, [item(url="https://health.gov/x", stance="refutes"), item(url="https://twitter.com/x", strength=0.1)]),
    ("none", "C", None, []), ("null", None, None, None),
    ("unusable", "D", None, [item(text="  "), item(text="No sensor evidence found for this object type."), item(text="the described entity is old")]),
    ("triples", "E", None, [item(text=None, triples=[["a", "b", "c"], ["a", "b", "d"]], source="known"), item(text="", triples=[])]),
]


def made(spark):
    records = spark.createDataFrame(ROWS, SCHEMA)
    registry = spark.createDataFrame([("known", 0.9), ("example_web_text", 0.8), ("government_web_text", 0.85), ("social_media_web_text", 0.4), ("unknown_web", 0.3)], "source_id string, source_trust double")
    return records, registry


def test_from_records_to_verdicts(spark):
    records, registry = made(spark)
    found = {r.id: r for r in PR.predict(records, registry).collect()}
    assert set(found) == {r[0] for r in ROWS}
    assert (found["own"].verdict, found["own"].path, found["own"].decided_by, found["own"].n_items) == ("supported", "symbolic_supported", "scores", 2)
    assert [e.stance for e in found["own"].evidence] == ["supports", "refutes"] and found["own"].reason.startswith("support 0.8")
    assert found["url"].evidence[0].source_id == "example_web_text"
    assert [e.source_id for e in found["gov"].evidence] == ["government_web_text", "social_media_web_text"] and found["gov"].verdict == "refuted"
    for name in ("none", "null", "unusable"):
        assert (found[name].verdict, found[name].n_items, found[name].support, found[name].evidence) == ("not_enough_evidence", 0, 0.0, None)
    assert found["triples"].n_items == 1 and found["triples"].verdict == "supported"
    assert PR.predict(records.limit(0), registry).collect() == []


def test_scorers_plug_in(spark):
    records, registry = made(spark)
    always = lambda scores: scores.withColumn("pred", F.lit("conflicting_evidence"))
    found = {r.id: r for r in PR.predict(records, registry, verdicts=always).collect()}
    assert found["none"].verdict == "conflicting_evidence" and found["none"].decided_by == "fallback" and found["own"].verdict == "supported"
    assert PR.predict(records, registry, O.by_thresholds).count() == len(ROWS)
    soft = {r.id: r for r in PR.predict(records, registry, pairs=P.by_weights()).collect()}
    assert 0 < soft["triples"].support < 1 and soft["none"].support == 0


def test_graphs_of_records(spark):
    items, edges = PR.graph_tables(made(spark)[0])
    assert sorted(r.i for r in items.where("id = 'own'").collect()) == [0, 1]
    kinds = {(r.id, r.kind): r["count"] for r in edges.groupBy("id", "kind").count().collect()}
    assert kinds["own", "has_triple"] == 1 and kinds["own", "co_evidence"] == 2 and kinds["triples", "from_triple"] == 2 and ("unusable", "has_evidence") not in kinds
