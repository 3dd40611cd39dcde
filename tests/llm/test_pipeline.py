"""The corpus pipeline: each stage against what it promises on its own input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corroborate.llm import quality_classifier
from tests.llm.test_llm import brute_jaccard

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    before, after = seen["quality_classifier"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = before.join(labels.where("quality = 1"), "doc_id")
    assert good.join(after, "doc_id", "left_anti").count() <= 0.05 * good.count()
    before, after = seen["exact_dedup"]
    text = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    want = {r.m for r in before.groupBy(text.alias("t")).agg(F.min("doc_id").alias("m")).collect()}
    assert {r.doc_id for r in after.collect()} == want and after.count() == len(want)
    before, after = seen["simhash_near_dedup"]
    assert after.join(before, "doc_id", "left_semi").count() == after.count() <= before.count()
    texts = {r.doc_id: r.text for r in before.collect()}
    ids, kept = sorted(texts), {r.doc_id for r in after.collect()}
    near = {(ids[i], ids[j]): x for (i, j), x in brute_jaccard([texts[i] for i in ids]).items() if x >= 0.8}
    alone = set(ids) - {i for pair in near for i in pair}
    assert alone <= kept  # what is like nothing else stays
    assert all(not {a, b} <= kept for a, b in near)  # of a near pair one stays at most
    assert all(any(i in pair for pair in near) for i in set(ids) - kept)
    before, after = seen["source_mix"]
    words = lambda d: d.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words(after) == pytest.approx(words(before), rel=0.05)
    before, after = seen["byte_level_bpe"]
    both = before.select("doc_id", F.sha2("text", 256).alias("want"))
    assert sorted((r.doc_id, r.want) for r in both.collect()) == sorted((r.doc_id, r.decoded_sha256) for r in after.collect())


@pytest.mark.parametrize("stage", [x for x, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(odd, spark, stage, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing and repeated names, no rows: no stage fails."""
    spark.createDataFrame([(1, 1, "?"), (4, 0, "?"), (None, 1, "?")], "doc_id long, quality int, y string").write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, odd, str(tmp_path))
    assert stage == "byte_level_bpe" or out.columns == odd.columns
    assert out.count() > 0 or stage == "quality_classifier"
    assert run(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert quality_classifier.THRESHOLD == 0.7


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
