"""Bounded examples, recorded scenes, leave-one-out scores and the stream of items."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corroborate.operators import examples as EX
from corroborate.operators import models as O
from corroborate.sources import scenes as SC
from corroborate.streaming.items import running_scores


def test_least_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(40)]), f"v{i}", [i]) for i in range(3000)]
    df = spark.createDataFrame(rows, "rule string, ord int, v string, more array<int>").repartition(7)
    found = EX.least_rows(df, ["rule"], ["ord", "v"], 3)
    want = {r: sorted((x for x in rows if x[0] == r), key=lambda x: (x[1] is None, x[1] or 0, x[2]))[:3] for r in ("hot", "a", "b", None)}
    got = {}
    for r in found.collect():
        got.setdefault(r.rule, []).append(tuple(r))
    assert {k: sorted(v, key=lambda x: (x[1], x[2])) for k, v in got.items()} == want
    plan = found._jdf.queryExecution().toString()
    assert "Window" not in plan and "Sort" not in plan
    monkeypatch.setattr(EX, "GROUPS_HELD", 1)  # buffers that are handed on early
    assert sorted(map(str, EX.least_rows(df, ["rule"], ["ord", "v"], 3).collect())) == sorted(map(str, found.collect()))
    assert EX.least_rows(df.limit(0), ["rule"], ["ord"], 2).collect() == []
    assert EX.least_rows(df, ["rule"], ["ord", "v"], 10_000).count() == 3000


def test_issue_examples(spark):
    kind = "id string, issues array<struct<rule: string, category: string, severity: string>>"
    rows = [(f"r{i}", [("V1", "c", "error")] * (1 + i % 2) + [(f"X{k}", "c", "warning") for k in range(6)]) for i in range(5)] + [("r9", [])]
    found = {(r.rule, r.id): r for r in EX.issue_examples(spark.createDataFrame(rows, kind)).collect()}
    assert sorted(i for rule, i in found if rule == "V1") == ["r0", "r1", "r2"] and len(found) == 21
    assert found["V1", "r1"].n == 2 and found["V1", "r1"].messages[0] == "[c:error] V1" and len(found["V1", "r0"].messages) == 5


def test_scenes_open_only_what_is_asked(spark, tmp_path):
    kinds = "scene_id string, object_id string, object_type string, properties map<string,string>, relations array<struct<predicate: string, object: string>>"
    rows = [(f"s/{k}", f"Mug|{i}", "Mug", {"isDirty": "true", "x": None}, [("onTopOf", f"Table|{i}")]) for k in range(6) for i in range(4)] + [(None, "lost", "Mug", None, None), ("bare", "Cup|1", "Cup", None, None)]
    objects = spark.createDataFrame(rows, kinds)
    at = str(tmp_path / "scenes")
    SC.write_scenes(objects, at)
    files = sorted(f.name for f in (tmp_path / "scenes").iterdir())
    assert files == sorted([f"s%2F{k}.scene.json" for k in range(6)] + ["bare.scene.json"])
    whole = SC.read_scenes(spark, at)
    assert whole.count() == 25 and sorted(r.object_id for r in whole.where("scene_id = 's/2'").collect()) == [f"Mug|{i}" for i in range(4)]
    first = whole.where("scene_id = 's/2' and object_id = 'Mug|1'").first()
    assert first.properties == {"isDirty": "true", "x": None} and [tuple(r) for r in first.relations] == [("onTopOf", "Table|1")]
    for k in (0, 1, 3, 4, 5):
        (tmp_path / "scenes" / f"s%2F{k}.scene.json").write_text("{ not read")
    assert SC.read_scenes(spark, at, ["s/2", "bare", "unknown"]).count() == 5  # the others would fail
    assert SC.read_scenes(spark, at).where(F.col("scene_id") == "s/2").count() == 4
    assert SC.read_scenes(spark, at, []).count() == 0 == SC.read_scenes(spark, at, ["unknown"]).count()
    with pytest.raises(Exception, match="JSON|Expecting"):
        SC.read_scenes(spark, at).count()


def test_partitions_hold_bounded_scenes(tmp_path):
    class Fixed:
        def scenes(self):
            return iter([("a", 10), ("b", SC.PARTITION_BYTES), ("c", 5), ("d", 5)])

    reader = SC._SceneReader(Fixed())
    assert [p.ids for p in reader.partitions()] == [["a"], ["b"], ["c", "d"]]
    assert list(reader.pushFilters([SC.In(("scene_id",), ("a", "d")), SC.EqualTo(("object_id",), "x"), SC.EqualTo(("scene_id",), "d")])) == [SC.EqualTo(("object_id",), "x")]
    assert [p.ids for p in reader.partitions()] == [["d"]]


def test_without_each(spark):
    rng = random.Random(16)
    rows = [(f"c{c}", c * 100 + i, rng.choice(["supports", "refutes", "not_enough_evidence"]), rng.choice([0.0, 0.3, 0.8, 0.95, 1.0])) for c in range(40) for i in range(rng.randint(1, 7))]
    found = {r.event_id: r for r in O.without_each(spark.createDataFrame(rows, "claim_id string, event_id long, stance string, confidence double")).collect()}
    assert len(found) == len(rows)
    for c, i, _, _ in rows:
        rest = [r for r in rows if r[0] == c and r[1] != i]
        score = lambda s: 1 - math.prod(1 - r[3] for r in rest if r[2] == s)  # noqa: E731, B023
        assert abs(found[i].support - score("supports")) < 6e-5 and abs(found[i].refute - score("refutes")) < 6e-5
    alone = [i for c, i, _, _ in rows if sum(r[0] == c for r in rows) == 1]
    assert alone and all(found[i].support == 0 and found[i].verdict == "not_enough_evidence" for i in alone)


def test_pairs_of_many_models(spark):
    names = spark.range(1200).select(F.format_string("m%04d", "id").alias("model"))
    pairs = O.model_pairs(names.unionByName(names).unionByName(spark.createDataFrame([(None,)], "model string")))
    assert pairs.count() == 1200 * 1199 // 2 and pairs.where("a >= b").isEmpty()


def test_stream_forgets_after_keep(spark, tmp_path):
    schema = "claim_id string, event_id long, stance string, evidence_types array<string>, inference_strength double, source_id string, ts timestamp"
    item = lambda i, day: ("c", i, "supports", ["testimony"], 0.5, "s", f"2024-01-{day:02d} 00:00:00")
    batches = [[item(1, 1), item(1, 1), (None, 9, "supports", ["testimony"], 0.5, "s", "2024-01-01 00:00:00")], [item(1, 2), item(2, 20)], [item(4, 21), item(2, 20)], [item(3, 1)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reg = spark.createDataFrame([("s", 0.85)], "source_id string, source_trust double")
    counts = {}
    for name, options in (("kept", {}), ("forgets", {"ts": "ts", "keep": "3 days"})):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = running_scores(stream, reg, **options).writeStream.outputMode("update").format("memory").queryName(f"running_{name}")
        out.option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        counts[name] = spark.table(f"running_{name}").agg(F.max("n")).first()[0]
    assert counts == {"kept": 4, "forgets": 3}  # item 3 came too late for the second
    with pytest.raises(ValueError, match="together"):
        running_scores(spark.createDataFrame([], schema), reg, ts="ts")


def test_large_scenes_are_many_files(spark, tmp_path, monkeypatch):
    """A scene of more objects than a file takes is written and read by several tasks, and replaced whole."""
    monkeypatch.setattr(SC, "OBJECTS_PER_FILE", 100)
    kinds = "scene_id string, object_id string, object_type string, properties map<string,string>, relations array<struct<predicate: string, object: string>>"
    thing = lambda s, i: (s, f'Mug|{i} "é \\\n', "Mug", {"n": str(i), "x": None}, [("onTopOf", f"Table|{i}")] if i % 2 else None)
    rows = [thing("hot+1", i) for i in range(1000)] + [thing("hot", i) for i in range(150)] + [thing("cold", i) for i in range(3)]
    at = str(tmp_path / "scenes")
    plain = lambda df: sorted((r.scene_id, r.object_id, r.object_type, sorted(r.properties.items(), key=str), [tuple(x) for x in r.relations]) for r in df.collect())
    want = lambda rows: sorted((s, o, t, sorted(p.items(), key=str), r or []) for s, o, t, p, r in rows)
    SC.write_scenes(spark.createDataFrame(rows, kinds), at)
    files = [f for f in (tmp_path / "scenes").iterdir() if f.name.startswith("hot%2B1")]
    assert len(files) == 10 and max(len(f.read_text().split("\n")) for f in files) < 200 and (tmp_path / "scenes" / "cold.scene.json").exists()
    assert plain(SC.read_scenes(spark, at)) == want(rows)
    assert plain(SC.read_scenes(spark, at, ["hot+1"])) == want(rows[:1000])
    monkeypatch.setattr(SC, "PARTITION_BYTES", 20_000)
    assert len(SC._SceneReader(SC.FolderOfScenes(at)).partitions()) > 4
    assert dict(SC.FolderOfScenes(at).scenes()).keys() == {"hot+1", "hot", "cold"}
    fewer = [thing("hot+1", i) for i in range(250)] + [thing("hot", 7)] + [thing("cold", i) for i in range(300)]
    SC.write_scenes(spark.createDataFrame(fewer, kinds), at)
    assert plain(SC.read_scenes(spark, at)) == want(fewer)
