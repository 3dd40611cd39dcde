"""Validation rules as one array of issues per record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import vocab as V

ISSUE = "struct<rule: string, category: string, severity: string>"

# Words that carry no meaning, tokens of negation, awkward phrases.
COMMON_WORDS = (
    "the a an and or but in on at to for of with by is are was were has have had will would can could should not"
).split()
NEGATIONS = ("not", "false", "n't", "never", "no ")
AWKWARD = ("is temperature", " is true.", " is false.")
SIMULATOR_TYPES = ("perception", "non_apprehension", "comparison_analogy", "inference")


def issue(rule: str, category: str, severity: str, condition: Column) -> Column:
    """A rule's issue where the condition holds, else null."""
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity")))


def _list(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _items(evidence: Column) -> Column:
    return F.coalesce(evidence, F.array())


def _each(evidence: Column, rule: str, category: str, severity: str, condition: Callable[[Column], Column]) -> Column:
    """One issue for each item that the condition holds for."""
    bad = F.filter(evidence, lambda e: F.coalesce(condition(e), F.lit(False)))
    return F.transform(bad, lambda e: F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity")))


def words(text: Column) -> Column:
    """Words between white space; none in a blank text."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def has_words(text: Column, n: int) -> Column:
    """Whether there are n words or more; reads no further than the n-th."""
    return text.rlike(r"\S" + r"+\s+\S" * (n - 1))


def text_issues(text: Column) -> Column:
    """V8-V17 for a claim's text. An empty text has that one issue."""
    t = F.btrim(_text(text), F.lit(" \t\n\r\x0b\x0c"))
    low = F.lower(t)
    # two words of three or more characters that aren't common ones; stops at the second
    meaningful = r"(?!(?:" + "|".join(COMMON_WORDS) + r")(?!\S))\S{3,}"
    rules = _list(
        issue("V9", "quality", "warning", F.length(t) < 10),
        issue("V10", "quality", "warning", F.length(t) > 250),
        issue("V11", "quality", "warning", ~t.rlike(r"[.!?]$")),
        issue("V12", "quality", "warning", ~F.substring(t, 1, 1).rlike(r"^\p{Lu}$")),
        issue("V13", "quality", "warning", ~has_words(t, 3)),
        issue("V14", "quality", "warning", ~low.rlike(rf"(?s)(?<!\S){meaningful}\s(?:.*?\s)?{meaningful}")),
        issue("V15", "quality", "error", t.contains("http://") | t.contains("https://")),
        issue("V16", "quality", "warning", t.contains("|") & t.contains("%")),
        *(issue("V17", "quality", "warning", low.contains(phrase)) for phrase in AWKWARD),
    )
    return F.when(t == "", _list(issue("V8", "quality", "error", F.lit(True)))).otherwise(rules)


def quality_score(text: Column, issues: Column) -> Column:
    """points off by severity, points for length, punctuation and words, within 0 and 1."""
    off = {"error": 0.3, "warning": 0.1, "info": 0.02}
    lost = F.aggregate(issues, F.lit(0.0), lambda a, i: a + V.lookup(off, i["severity"], 0.0))
    t = _text(text)
    bonus = (
        F.when(F.length(t).between(10, 150), 0.05).otherwise(0.0)
        + F.when(t.rlike(r"[.!?]$"), 0.02).otherwise(0.0)
        + F.when(has_words(t, 5), 0.03).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - lost + bonus))


def quality_bucket(score: Column) -> Column:
    """Excellent, good, fair or poor from 0.9, 0.7 and 0.5 on."""
    return F.when(score >= 0.9, F.lit("excellent")).when(score >= 0.7, F.lit("good")).when(score >= 0.5, F.lit("fair")).otherwise(F.lit("poor"))


def semantic_issues() -> Column:
    """V1-V7 for a record of the v3.0 schema (columns claim, claim_triples, reasoning, evidence, ...)."""
    triples, structure, text = F.col("claim_triples"), F.col("reasoning.structural"), F.lower(_text(F.col("claim")))
    n = F.coalesce(F.size(triples), F.lit(0))
    n = F.when(triples.isNull(), 0).otherwise(n)
    expected = triples.isNotNull() | F.coalesce(F.col("provenance.dataset") == "ai2thor", F.lit(False))
    negated = F.lit(False)
    for token in NEGATIONS:
        negated = negated | text.contains(token)
    evidence = _items(F.col("evidence"))
    malformed = F.filter(F.coalesce(triples, F.array().cast("array<array<string>>")), lambda t: F.coalesce(F.size(t), F.lit(0)) != 3)
    return F.concat(
        _list(
            issue("V1", "semantic", "error", expected & (structure == "one_hop") & (n != 1)),
            issue("V2", "semantic", "error", expected & (structure == "conjunction") & (n < 2)),
            issue("V3", "semantic", "warning", (structure == "negation") & ~negated & ~F.col("verdict.label").eqNullSafe(F.lit("refuted"))),
        ),
        F.transform(malformed, lambda t: F.struct(F.lit("V4").alias("rule"), F.lit("semantic").alias("category"), F.lit("error").alias("severity"))),
        _each(evidence, "V5", "semantic", "warning", lambda e: F.array_contains(e["evidence_types"], "non_apprehension") & (e["stance"] == "supports") & (F.size(e["triples"]) > 0)),
        _each(evidence, "V6", "semantic", "error", lambda e: (e["text"] != "") & e["text"].rlike(r"^\s+$")),
        _each(evidence, "V7", "semantic", "error", lambda e: (_text(e["modality"]) != "unanswerable") & (F.coalesce(F.size(e["evidence_types"]), F.lit(0)) < 1)),
    )


def _types(evidence: Column) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.transform(evidence, lambda e: F.coalesce(e["evidence_types"], F.array().cast("array<string>"))))))


def consistency_issues() -> Column:
    """V18-V27 for a record of the v3.0 schema."""
    label, dataset, evidence = F.col("verdict.label"), F.col("provenance.dataset"), _items(F.col("evidence"))
    declared = F.coalesce(F.col("epistemic.evidence_types_all"), F.array().cast("array<string>"))
    absent = F.array_contains(declared, "non_apprehension")
    stances = F.filter(F.transform(evidence, lambda e: e["stance"]), lambda s: s.isNotNull())
    some, has = F.size(stances) > 0, lambda s: F.array_contains(stances, s)
    created = F.col("meta.created_utc")
    return _list(
        issue("V18", "consistency", "error", label.isNotNull() & (label != "") & ~label.isin(*V.VERDICTS)),
        issue("V19", "consistency", "error", _types(evidence) != F.sort_array(declared)),
        issue("V20", "consistency", "error", (label == "supported") & some & ~has("supports")),
        issue("V21", "consistency", "error", (label == "refuted") & some & ~has("refutes")),
        issue("V22", "consistency", "warning", (label == "conflicting_evidence") & some & ~has("supports") & ~has("refutes")),
        issue("V23", "consistency", "error", (label == "not_enough_evidence") & absent),
        issue("V24", "consistency", "error", absent & ~has("supports") & ~has("refutes")),
        issue("V25", "consistency", "warning", (created != "") & F.try_to_timestamp(created).isNull()),
        issue("V26", "consistency", "warning", (dataset == "ai2thor") & F.col("claim_triples").isNull() & ~absent & ~F.col("reasoning.structural").eqNullSafe(F.lit("absence"))),
        issue("V27", "consistency", "info", (dataset == "averitec") & F.col("claim_triples").isNotNull()),
    )


def schema_issues() -> Column:
    """V0: the first violation of the schema's enums, ranges and required fields, as one issue."""
    evidence = F.col("evidence")
    inside = lambda c, values: c.isNotNull() & c.isin(*values)
    item_ok = lambda e: (
        (_text(e["evidence_id"]) != "") & (_text(e["text"]) != "") & (_text(e["source_id"]) != "") & inside(e["modality"], V.MODALITIES) & inside(e["stance"], V.STANCES)
        & e["evidence_types"].isNotNull() & (F.size(F.array_except(e["evidence_types"], F.array(*map(F.lit, V.EVIDENCE_TYPES)))) == 0)
        & F.coalesce(e["inference_strength"].between(0, 1), F.lit(False)) & (e["triple_source"].isNull() | e["triple_source"].isin("ground_truth", "extracted"))
    )
    ok = (
        (F.col("schema_version") == V.SCHEMA_VERSION) & F.col("id").isNotNull() & F.col("claim").isNotNull()
        & inside(F.col("verdict.label"), V.VERDICTS) & inside(F.col("verdict.derivation_method"), V.DERIVATIONS)
        & inside(F.col("epistemic.assignment_method"), V.ASSIGNMENTS)
        & (F.col("reasoning.structural").isNull() | F.col("reasoning.structural").isin(*V.STRUCTURES))
        & (F.col("reasoning.strategy").isNull() | F.col("reasoning.strategy").isin(*V.STRATEGIES))
        & evidence.isNotNull() & (F.size(evidence) > 0) & F.forall(evidence, lambda e: F.coalesce(item_ok(e), F.lit(False)))
        & F.col("provenance.dataset").rlike("^[a-z0-9_]+$") & (F.col("provenance.split").isNull() | F.col("provenance.split").isin("train", "dev", "test"))
    )
    return _list(issue("V0", "schema", "error", ~F.coalesce(ok, F.lit(False))))


def simulator_issues() -> Column:
    """Rules of simulator records; a record without evidence has that one issue."""
    evidence = _items(F.col("evidence"))
    first, declared = F.try_element_at(evidence, F.lit(1)), F.coalesce(F.col("epistemic.evidence_types_all"), F.array().cast("array<string>"))
    absent = F.array_contains(declared, "non_apprehension")
    add = lambda rule, c: issue(rule, "dataset", "error", F.coalesce(c, F.lit(False)))
    each = lambda rule, c: _each(evidence, rule, "dataset", "error", c)
    unexpected = F.filter(declared, lambda t: ~t.isin(*SIMULATOR_TYPES))
    rules = F.concat(
        _list(
            add("V29", absent & (first["stance"] == "supports") & (F.size(first["triples"]) > 0)),
            add("V30", absent & ~F.coalesce(first["stance"].isin("supports", "refutes"), F.lit(False))),
            add("V31", ~absent & ~F.col("reasoning.structural").eqNullSafe(F.lit("absence")) & F.col("claim_triples").isNull()),
            add("V32", F.col("reasoning").isNull()),
        ),
        F.transform(unexpected, lambda t: F.struct(F.lit("V33").alias("rule"), F.lit("dataset").alias("category"), F.lit("error").alias("severity"))),
        _list(add("V34", ~F.col("epistemic.assignment_method").eqNullSafe(F.lit("simulator")))),
        each("V35", lambda e: ~e["modality"].eqNullSafe(F.lit("sensor"))),
        each("V36", lambda e: ~e["source_id"].eqNullSafe(F.lit("sensor_perception"))),
        each("V37", lambda e: ~e["inference_strength"].eqNullSafe(F.lit(1.0))),
    )
    return F.when(F.size(evidence) == 0, _list(issue("V28", "dataset", "error", F.lit(True)))).otherwise(rules)


def web_issues() -> Column:
    """Rules of web question-answer records."""
    evidence, label = _items(F.col("evidence")), F.col("verdict.label")
    some = F.size(evidence) > 0
    stances = F.array_distinct(F.filter(F.transform(evidence, lambda e: e["stance"]), lambda s: s.isNotNull()))
    only = lambda s: (F.size(stances) > 0) & (F.size(F.array_except(stances, F.array(F.lit(s)))) == 0)
    add = lambda rule, c: issue(rule, "dataset", "error", F.coalesce(c, F.lit(False)))
    return F.concat(
        _list(
            add("V38", ~some),
            add("V39", label.isNull() & some),
            add("V40", label.isNotNull() & ~some),
            add("V41", F.col("claim_triples").isNotNull()),
            add("V42", F.array_contains(F.col("epistemic.evidence_types_all"), "non_apprehension")),
            add("V43", (label == "conflicting_evidence") & only("supports")),
            add("V44", (label == "conflicting_evidence") & only("refutes")),
            add("V45", some & F.forall(evidence, lambda e: e["text"].isNull())),
            add("V46", ~F.col("epistemic.assignment_method").eqNullSafe(F.lit("heuristic"))),
        ),
        _each(evidence, "V47", "dataset", "error", lambda e: e["modality"] == "sensor"),
        _each(evidence, "V48", "dataset", "error", lambda e: e["stance"].isin("supports", "refutes") & (F.coalesce(F.size(e["evidence_types"]), F.lit(0)) < 1)),
    )


#: Rules of one dataset by its name, as an expression over a record's columns.
DatasetRules = Callable[[], Column]
_DATASET_RULES: dict[str, DatasetRules] = {"ai2thor": simulator_issues, "averitec": web_issues}


def register_rules(dataset: str, rules: DatasetRules) -> None:
    """The rules that records of a dataset must follow besides the shared ones."""
    _DATASET_RULES[dataset] = rules


def dataset_issues(dataset: Column) -> Column:
    """The issues by the rules of a record's dataset; none where it has no rules."""
    found = F.array().cast(f"array<{ISSUE}>")
    for name, rules in _DATASET_RULES.items():
        found = F.when(dataset == name, rules()).otherwise(found)
    return found


def missing_fields(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Adds n_missing_fields, the required columns that a record has null or that aren't there."""
    absent = [F.col(c).isNull().cast("int") if c in records.columns else F.lit(1) for c in required]
    return records.withColumn("n_missing_fields", sum(absent, F.lit(0)))


def validated(records: DataFrame) -> DataFrame:
    """Adds issues (all families), is_valid (no error) and quality (F44; 0 for a record without text)."""
    shared = F.concat(schema_issues(), semantic_issues(), text_issues(F.col("claim")), consistency_issues())
    out = records.withColumn("issues", shared)
    return (
        out.withColumn("is_valid", ~F.exists("issues", lambda i: i["severity"] == "error"))
        .withColumn("quality", quality_score(F.col("claim"), F.col("issues")))
        .withColumn("dataset_issues", dataset_issues(F.col("provenance.dataset")))
    )


def schema_gate(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that follow the schema, and those that don't."""
    bad = F.size(schema_issues()) > 0
    return records.where(~bad), records.where(bad)


def each_of(rows: DataFrame, items: Column, name: str, *kept: str) -> DataFrame:
    """The columns to keep, with a row for each item of an array. For a plain explode Spark adds a filter on the array's size and
    pushes it down to the scan, so all rules ran twice, there with the columns' expressions at each place that names one."""
    return rows.select(*kept, F.posexplode_outer(items).alias("_at", name)).where("_at IS NOT NULL").drop("_at")


def issue_counts(checked: DataFrame, column: str = "issues") -> DataFrame:
    """Issues by rule, category and severity."""
    return each_of(checked, F.col(column), "i").groupBy("i.rule", "i.category", "i.severity").agg(F.count("*").alias("n"))


def batch_report(records: DataFrame, min_shortcut: float = 0.35) -> DataFrame:
    """One row on a batch of synthetic records: id, stored verdict, recomputed verdict,
    is_shortcut_breaking, n_missing_fields."""
    out = records.agg(
        F.count("*").alias("n"),
        F.count_if("is_shortcut_breaking").alias("n_shortcut"),
        F.count_if(F.col("n_missing_fields") > 0).alias("n_missing"),
        F.count_if(~F.col("verdict").eqNullSafe(F.col("recomputed"))).alias("n_mismatch"),
    )
    share = F.coalesce(F.try_divide(F.col("n_shortcut").cast("double"), F.col("n")), F.lit(0.0))
    passed = (F.col("n") > 0) & (share >= min_shortcut) & (F.col("n_missing") == 0) & (F.col("n_mismatch") == 0)
    return out.withColumn("shortcut_fraction", F.round(share, 4)).withColumn("passed", passed)


def assert_valid(records: DataFrame, shown: int = 20) -> DataFrame:
    """The records, or ValueError that names rules and ids of some records with errors."""
    bad = validated(records).where(~F.col("is_valid")).select("id", F.array_join(F.transform("issues", lambda i: i["rule"]), ",").alias("rules"))
    found = [f"{r.id}: {r.rules}" for r in bad.limit(shown).collect()]
    if found:
        raise ValueError("; ".join(found))
    return records
