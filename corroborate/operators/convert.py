"""Converters to the v3.0 record schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import uris as U
from corroborate.functions import webqa as W
from corroborate.functions.vocab import DEFAULT_TRUST, SCHEMA_VERSION
from corroborate.operators.resolve import resolve_urls
from corroborate.operators.validate import schema_gate

Converter = Callable[..., DataFrame]
_CONVERTERS: dict[str, Converter] = {}

SPATIAL, TRIPLES = ("inside", "ontopof", "near", "in", "on"), "array<array<string>>"


def converter(name: str) -> Callable[[Converter], Converter]:
    """G1: register a converter of a dataset by name."""

    def register(f: Converter) -> Converter:
        _CONVERTERS[name] = f
        return f

    return register


def convert(name: str, raw: DataFrame, **options) -> DataFrame:
    """The named converter's records that follow the schema; others are left out."""
    return schema_gate(_CONVERTERS[name](raw, **options))[0]


def _sorted_types(evidence: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.transform(evidence, lambda e: F.coalesce(e["evidence_types"], F.array().cast("array<string>"))))))


@converter("averitec")
def web_claims(raw: DataFrame, registry: DataFrame, created: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Question-answer records (id, claim, label, justification, fact_checking_strategies,
    questions) to records, one item per answer.

    Answers are unnested (J22), their sources resolved in joins (J3, J1), and put together again by
    record in question and answer order. Records without answers have no evidence, as before.
    """
    url, answer = F.trim(F.coalesce("a.source_url", F.lit(""))), W.answer_type(F.col("a.answer_type"))
    answers = (
        raw.select("id", "label", "fact_checking_strategies", F.posexplode("questions").alias("qi", "q"))
        .select("id", "label", "fact_checking_strategies", "qi", "q.question", F.posexplode("q.answers").alias("ai", "a"))
        .select("*", url.alias("url"), answer.alias("answer"), W.modality(F.col("a.source_medium"), url, answer).alias("modality"))
    )
    trust = registry.select("source_id", "source_trust")
    resolved = resolve_urls(answers, registry).join(trust, "source_id", "left").withColumn("source_trust", F.coalesce("source_trust", F.lit(DEFAULT_TRUST)))
    urls = answers.where("a.source_url <> ''").select("id", "a.source_url").distinct().groupBy("id").agg((F.count("*") >= 2).alias("several"))
    base = W.base_types(F.col("modality"), F.col("answer"), F.trim(F.coalesce("a.answer", F.lit(""))))
    types = W.enriched_types(base, F.col("modality"), F.col("answer"), F.coalesce("several", F.lit(False)), F.col("fact_checking_strategies"))
    text = W.evidence_text(F.col("question"), F.col("a.answer"), F.col("a.boolean_explanation"))
    stance = F.when(F.col("modality") == "unanswerable", F.lit("not_enough_evidence")).otherwise(W.stance(W.label(F.col("label"))))
    item = F.struct(
        F.format_string("%s-q%d-a%d", "id", F.col("qi") + 1, F.col("ai") + 1).alias("evidence_id"),
        F.nullif(text, F.lit("")).alias("text"), F.array().cast(TRIPLES).alias("triples"), F.lit(None).cast("string").alias("triple_source"),
        F.col("modality"), stance.alias("stance"), types.alias("evidence_types"), F.col("source_id"),
        W.strength(F.col("answer"), F.col("source_trust")).alias("inference_strength"), F.col("a.source_url").alias("source_url"),
    )
    lists = (
        resolved.join(urls, "id", "left").select("id", F.struct("qi", "ai", item.alias("e")).alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    )
    kind = "array<struct<evidence_id:string,text:string,triples:array<array<string>>,triple_source:string,modality:string,stance:string,evidence_types:array<string>,source_id:string,inference_strength:double,source_url:string>>"
    evidence = F.coalesce(F.transform("xs", lambda x: x["e"]).cast(kind), F.array().cast(kind))
    joined = raw.join(lists, "id", "left").withColumn("evidence", evidence)
    return joined.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "id", F.trim(F.coalesce("claim", F.lit(""))).alias("claim"),
        F.struct(W.label(F.col("label")).alias("label"), "justification", F.lit("annotated").alias("derivation_method")).alias("verdict"),
        F.struct(_sorted_types(F.col("evidence")).alias("evidence_types_all"), F.lit("heuristic").alias("assignment_method")).alias("epistemic"),
        F.lit(None).cast(TRIPLES).alias("claim_triples"),
        F.struct(F.lit("one_hop").alias("structural"), W.strategy(F.col("fact_checking_strategies")).alias("strategy")).alias("reasoning"),
        "evidence",
        F.struct(F.lit("averitec").alias("dataset"), F.lit(None).cast("string").alias("split"), F.lit("schlichtkrull2023averitec").alias("context_id")).alias("provenance"),
        F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(created).alias("created_utc")).alias("meta"),
    )


def strategy_of(predicate: Column, has_triples: Column, affordances: tuple[str, ...] = ()) -> Column:
    """how an item was observed."""
    p = F.lower(predicate)
    return (
        F.when(~has_triples, F.lit("absence_detection"))
        .when(p.isin(*SPATIAL), F.lit("spatial_reasoning"))
        .when(p.isin(*affordances) if affordances else F.lit(False), F.lit("action_testing"))
        .otherwise(F.lit("direct_observation"))
    )


def types_of(strategy: Column, has_triples: Column) -> Column:
    """F23."""
    of = lambda *names: F.array(*map(F.lit, names))
    return (
        F.when(strategy == "direct_observation", of("perception"))
        .when(strategy == "absence_detection", of("perception", "non_apprehension"))
        .when(strategy == "spatial_reasoning", of("perception", "comparison_analogy"))
        .when(strategy == "action_testing", of("perception", "inference"))
        .when(has_triples, of("perception"))
        .otherwise(of("perception", "non_apprehension"))
    )


def justification(label: Column, predicate: Column, claimed: Column, observed: Column) -> Column:
    """claimed and observed are triple lists."""
    right = label == "supported"
    value = lambda t: F.coalesce(F.try_element_at(F.try_element_at(t, F.lit(1)), F.lit(3)), F.lit("unknown"))
    heat = F.concat(F.lit("Sensor shows temperature="), value(observed))
    return (
        F.when((F.lower(predicate) == "temperature") & right, F.concat(heat, F.lit(", matching claim.")))
        .when(F.lower(predicate) == "temperature", F.concat(heat, F.lit(", contradicting claimed value ("), value(claimed), F.lit(").")))
        .when(F.lower(predicate).isin(*SPATIAL), F.concat(F.lit("Sensor "), F.when(right, F.lit("confirms")).otherwise(F.lit("contradicts")), F.lit(" spatial relation ("), predicate, F.lit(").")))
        .when(F.size(F.coalesce(observed, F.array().cast(TRIPLES))) == 0, F.lit("No sensor evidence found to support the claim."))
        .otherwise(F.concat(F.lit("Sensor observation "), F.when(right, F.lit("matches")).otherwise(F.lit("contradicts")), F.lit(" the claim.")))
    )


@converter("ai2thor")
def simulator_claims(raw: DataFrame) -> DataFrame:
    """Simulator records, already in the v3.0 layout: triples normalised, types united, the
    assignment rewritten. One projection, no shuffle."""
    fix = lambda e: F.struct(
        e["evidence_id"].alias("evidence_id"), e["text"].alias("text"), U.normalised_triples(e["triples"]).alias("triples"), e["triple_source"].alias("triple_source"),
        e["modality"].alias("modality"), e["stance"].alias("stance"), e["evidence_types"].alias("evidence_types"), e["source_id"].alias("source_id"),
        e["inference_strength"].alias("inference_strength"), e["source_url"].alias("source_url"),
    )
    evidence = F.transform("evidence", fix)
    label = W.lookup({"supported": "supported", "refuted": "refuted", "not_enough_evidence": "not_enough_evidence", "conflicting_evidence": "conflicting_evidence"}, F.lower(F.trim(F.col("verdict.label"))))
    triples = F.when(F.col("claim_triples").isNotNull(), U.normalised_triples(F.col("claim_triples")))
    return raw.withColumn("evidence", evidence).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "id", F.trim("claim").alias("claim"),
        F.struct(label.alias("label"), "verdict.justification", "verdict.derivation_method").alias("verdict"),
        F.struct(_sorted_types(F.col("evidence")).alias("evidence_types_all"), F.lit("simulator").alias("assignment_method")).alias("epistemic"),
        triples.alias("claim_triples"), "reasoning", "evidence", "provenance", "meta",
    )


def simulator_claims_legacy(raw: DataFrame) -> DataFrame:
    """Records whose evidence is one struct (triples, text, predicate) become one-item lists."""
    e = F.col("evidence")
    triples = U.normalised_triples(e["triples"])
    label = F.lower(F.trim("label"))
    has = F.size(triples) > 0
    strategy = strategy_of(e["predicate"], has)
    stance = F.when(label == "supported", F.lit("supports")).when(label == "refuted", F.lit("refutes"))
    item = F.struct(
        F.concat("id", F.lit("-e0")).alias("evidence_id"), e["text"].alias("text"), triples.alias("triples"), F.lit("ground_truth").alias("triple_source"),
        F.lit("sensor").alias("modality"), stance.alias("stance"), types_of(strategy, has).alias("evidence_types"), F.lit("sensor_perception").alias("source_id"),
        F.lit(1.0).alias("inference_strength"), F.lit(None).cast("string").alias("source_url"),
    )
    return raw.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), "id", F.trim("claim").alias("claim"),
        F.struct(label.alias("label"), justification(label, e["predicate"], F.col("claim_triples"), triples).alias("justification"), F.lit("annotated").alias("derivation_method")).alias("verdict"),
        F.struct(_sorted_types(F.array(item)).alias("evidence_types_all"), F.lit("simulator").alias("assignment_method")).alias("epistemic"),
        U.normalised_triples(F.col("claim_triples")).alias("claim_triples"),
        F.struct(F.lit("one_hop").alias("structural"), F.when(strategy == "spatial_reasoning", "spatial_comparison").when(strategy == "action_testing", "multi_hop_inference").otherwise(strategy).alias("strategy")).alias("reasoning"),
        F.array(item).alias("evidence"),
        F.struct(F.lit("ai2thor").alias("dataset"), F.lit(None).cast("string").alias("split"), F.lit(None).cast("string").alias("context_id")).alias("provenance"),
        F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit("1970-01-01T00:00:00Z").alias("created_utc")).alias("meta"),
    )


def united(parts: list[DataFrame]) -> DataFrame:
    """All converted sources, by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
