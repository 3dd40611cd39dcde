"""Reading and writing records, triples, splits and registries."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corroborate.sources.turtle import bracketed, is_node, plain, quoted, read_turtle, write_turtle

__all__ = ["read_turtle", "write_turtle"]  # Turtle has its own module

TRIPLE_LIST = "array<array<string>>"
ITEM = (
    f"struct<evidence_id: string, text: string, triples: {TRIPLE_LIST}, triple_source: string, modality: string, stance: string, "
    "evidence_types: array<string>, source_id: string, inference_strength: double, source_url: string>"
)
#: The v3.0 record schema.
RECORD = (
    "schema_version string, id string, claim string, verdict struct<label: string, justification: string, derivation_method: string>, "
    f"epistemic struct<evidence_types_all: array<string>, assignment_method: string>, claim_triples {TRIPLE_LIST}, "
    f"reasoning struct<structural: string, strategy: string>, evidence array<{ITEM}>, "
    "provenance struct<dataset: string, split: string, context_id: string>, "
    "meta struct<schema_version: string, created_utc: string, template_type: string, is_shortcut_breaking: boolean>"
)
WEB_RECORD = (
    "id string, claim string, label string, justification string, fact_checking_strategies array<string>, "
    "questions array<struct<question: string, answers array<struct<answer: string, answer_type: string, source_url: string, "
    "source_medium: string, boolean_explanation: string>>>>"
).replace("answers array", "answers: array")
REGISTRY = (
    "source_id string, source_name string, domain string, source_type string, modality string, source_trust double, prior_trust double, "
    "default_evidence_types array<string>, default_inference_strength double, "
    "trust_metadata struct<correct_reports: int, incorrect_reports: int, total_reports: int, last_updated: string, trust_version: string, methodology_ref: string>"
)
SEED_POOL = "claim string, evidence_type string, domain string, supporting_evidence string, refuting_evidence string"

_TRIPLE = r'^\s*(?:<([^>]*)>|(_:\S+))\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"([^"\\]*+(?:\\.[^"\\]*+)*+)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType = RECORD, keep_malformed: bool = False) -> DataFrame:
    """A record per line, with a fixed schema; blank lines are skipped, malformed ones dropped
    (or kept in _corrupt_record)."""
    if keep_malformed:
        return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType = WEB_RECORD) -> DataFrame:
    """S3: one top-level list; ValueError if a file's first character isn't a bracket."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.trim("value"), 1, 1).alias("c"))
    if not first.where("c <> '['").isEmpty():
        raise ValueError(f"expected a JSON list at the top of {path}")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S7."""
    df.write.mode(mode).json(path)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines, escapes undone; comments and other lines are skipped."""
    lines = spark.read.option("lineSep", "\n").text(path).where(F.col("value").rlike(_TRIPLE))
    part = lambda k: F.nullif(F.regexp_extract("value", _TRIPLE, k), F.lit(""))
    literal = F.regexp_extract("value", _TRIPLE, 6)
    first = lambda *c: plain(F.coalesce(*c))
    return lines.select(first(part(1), part(2)).alias("s"), plain(part(3)).alias("p"), first(part(4), part(5), literal).alias("o"))


def ntriples_line(s: Column, p: Column, o: Column) -> Column:
    """An object is a URI if it starts with http, a blank node if with _:, else a literal. One line,
    whatever the literal holds."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(bracketed(c))
    return F.concat(node(s), F.lit(" "), bracketed(p), F.lit(" "), F.when(is_node(o), node(o)).otherwise(quoted(o)), F.lit(" ."))


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S5, S6."""
    triples.select(ntriples_line(F.col("s"), F.col("p"), F.col("o")).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The trust registry; ValueError if its generic entries don't cover it."""
    from corroborate.operators.resolve import checked_registry

    return checked_registry(read_jsonl(spark, path, REGISTRY))


def with_line_index(spark: SparkSession, path: str) -> DataFrame:
    """(line_idx, value) of a text file's non-blank lines, in order, from 0.

    zipWithIndex counts lines per partition first, so the order of the file holds at any size.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.rdd.zipWithIndex().map(lambda x: (x[1], x[0].value)).toDF("line_idx long, value string")


def write_split_index(split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(line_idx, split), a folder per split."""
    split.select("line_idx", "split").write.mode(mode).partitionBy("split").parquet(path)


def read_split_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def claim_pool(records: DataFrame) -> DataFrame:
    """Items that have triples, with their claim and stance."""
    items = records.select("claim", F.explode("evidence").alias("e")).where(F.size("e.triples") > 0)
    return items.select("claim", "e.stance", "e.text", "e.triples")


def cached_embeddings(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (key, text) with their cached vectors, and the distinct texts that miss one."""
    keyed = texts.withColumn("hash", F.substring(F.sha2("text", 256), 1, 16))
    misses = keyed.select("hash", "text").dropDuplicates(["hash"]).join(cache.select("hash"), "hash", "left_anti")
    return keyed.join(cache, "hash"), misses


def scene_objects(raw: DataFrame, flags: dict[str, str], included: tuple[str, ...]) -> DataFrame:
    """Properties that the policy allows and position as doubles.

    raw: properties map<string, string>, position struct. An attribute in `flags` stays if its flag
    property is true; others stay if they are included; nulls go.
    """
    allowed = F.map_filter("properties", lambda k, v: v.isNotNull() & F.coalesce(
        F.create_map(*(F.lit(x) for kv in flags.items() for x in kv))[k].isNotNull()
        & (F.lower(F.col("properties")[F.create_map(*(F.lit(x) for kv in flags.items() for x in kv))[k]]) == "true"), F.lit(False))
        | (v.isNotNull() & k.isin(*included)))
    at = lambda axis: F.coalesce(F.col(f"position.{axis}").cast("double"), F.lit(0.0)).alias(axis)
    return raw.withColumn("properties", allowed).withColumn("position", F.struct(at("x"), at("y"), at("z")))


def latest_run(runs: DataFrame) -> DataFrame:
    """Of each model (model, run_id, finished) the last run."""
    return runs.groupBy("model").agg(F.max_by("run_id", "finished").alias("run_id"))


def probes(raw: DataFrame) -> DataFrame:
    """Probes (id, claim, expected_verdict, evidence) as evidence rows with default strength."""
    return raw.select(F.col("id").alias("claim_id"), "expected_verdict", F.explode("evidence").alias("e")).select("claim_id", "expected_verdict", "e.*")


def markdown_table(lines: list[str]) -> list[dict[str, str]]:
    """Rows of the first table in a report's lines."""
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    rows = [cells(x) for x in lines if x.strip().startswith("|")]
    return [dict(zip(rows[0], r, strict=False)) for r in rows[2:]] if len(rows) > 2 else []


def write_report(row: dict, path: str) -> None:
    """A collected one-row result as indented JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, ensure_ascii=False, default=str)


SCENE = (
    "graph_id string, objects array<struct<object_id: string, object_type: string, properties: map<string, string>, "
    "position: struct<x: double, y: double, z: double>, parents: array<string>>>, "
    "relationships array<struct<subject: string, predicate: string, object: string, confidence: double>>, metadata map<string, string>"
)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """Scenes, a JSON document per file; files are spread over tasks like any other input."""
    return spark.read.schema(SCENE).option("multiLine", True).json(path)


def objects_of_scenes(scenes: DataFrame) -> DataFrame:
    """A row per object of a scene: scene_id, object_id, object_type, properties, position, parents."""
    return scenes.select(F.col("graph_id").alias("scene_id"), F.explode("objects").alias("x")).select("scene_id", "x.*")


def seed_pool(pool: DataFrame) -> DataFrame:
    """Seeds of each evidence type and stance, one text per row: evidence_type, stance, claim, text."""
    side = lambda stance, c: F.struct(F.lit(stance).alias("stance"), F.col(c).alias("text"))
    both = F.explode(F.array(side("supports", "supporting_evidence"), side("refutes", "refuting_evidence"))).alias("x")
    return pool.select("evidence_type", "claim", both).select("evidence_type", "claim", "x.stance", "x.text").where("text is not null")


def load_config(path: str) -> dict:
    """A configuration file as a dictionary on the driver: JSON, or YAML where a reader for it is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"no YAML reader is installed for {path}") from e
        return yaml.safe_load(f)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Metric reports, JSON documents in a folder per model (model=...), as one frame with the model."""
    return spark.read.json(path)


def cached_frame(spark: SparkSession, path: str, stamp: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The frame that was written under this stamp (such as its input's time of change), or else the
    one that build makes, written there first. path is a folder that driver and executors share."""
    at = f"{path.rstrip('/')}/stamp={stamp}"
    try:
        return spark.read.parquet(at)
    except AnalysisException:
        build().write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)
