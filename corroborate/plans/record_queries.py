"""Queries over whole v3.0 records: validation rule by rule, converters, files; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import vocab as V
from corroborate.operators import convert as C
from corroborate.operators import examples as EX
from corroborate.operators import generate as G
from corroborate.operators import models as O
from corroborate.operators import predict as PR
from corroborate.operators import profile as P
from corroborate.operators import splits as S
from corroborate.operators import validate as X
from corroborate.operators.lineage import new_folder
from corroborate.plans import bindings as B
from corroborate.plans.claim_queries import SHARED_TEXT_RULES
from corroborate.sources import records as R
from corroborate.sources import scenes as SC
from corroborate.sources import turtle as TTL

CLAIMS = (
    "", "short.", "The cup is not in the sink.", "the lamp is true.", "The kettle is temperature hot.", "See https://example.org for the answer of this claim.", "A | B is 5 % of all cups.",
    "Cups.", "The Fork lies on the table!", "Never was the plate on the shelf.", "The the of and.", "Is the knife in the drawer", "The pan is in the oven, which stands near the window of the kitchen.",
)
STRUCTURES = ("one_hop", "conjunction", "negation", "absence", None, "odd", "multi_hop")
LABELS = ("supported", "refuted", "not_enough_evidence", "conflicting_evidence", "unknown", "", None, "refuted")
TYPES = (("perception",), ("testimony",), (), None, ("non_apprehension", "perception"), ("non_apprehension",), ("telepathy",))


def _pick(values: tuple, at: Column, kind: str = "string") -> Column:
    """values[at mod their number]."""
    lits = [F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, tuple) else F.lit(v).cast(kind) for v in values]
    return F.element_at(F.array(*lits), (at % len(values) + 1).cast("int"))


def _item(i: Column, j: Column, sensor: Column, label: Column) -> Column:
    """The j-th item of record i: every third record has only right ones, the others all kinds of faults."""
    k, clean = i + j, i % 3 == 0
    side = F.when(label == "supported", F.lit("supports")).when(label == "refuted", F.lit("refutes")).when(label == "conflicting_evidence", F.when(j % 2 == 0, "supports").otherwise("refutes")).otherwise("not_enough_evidence")
    one = F.array(F.array(F.lit("http://e.org/x%7C1"), F.lit("http://e.org/r/in"), F.lit("box")))
    return F.struct(
        F.concat(F.lit("e"), j.cast("string")).alias("evidence_id"),
        F.when(clean, F.lit("Item text.")).when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, F.lit("   ")).when(k % 9 == 2, F.lit("")).otherwise(F.lit("Item text.")).alias("text"),
        F.when(clean | (k % 2 == 0), one).otherwise(F.array().cast("array<array<string>>")).alias("triples"),
        F.when(clean, F.lit("ground_truth")).otherwise(_pick(("ground_truth", None, "guessed", "extracted"), k)).alias("triple_source"),
        F.when(clean, F.when(sensor, "sensor").otherwise("web_text")).otherwise(_pick(("sensor", "web_text", "unanswerable", "hologram", None, "sensor"), k)).alias("modality"),
        F.when(clean, side).otherwise(_pick(("supports", "refutes", "not_enough_evidence", None, "supports"), k)).alias("stance"),
        F.when(clean, F.array(F.when(sensor, "perception").otherwise("testimony"))).otherwise(_pick(TYPES, k, "array<string>")).alias("evidence_types"),
        F.when(clean & sensor, F.lit("sensor_perception")).when(clean, F.lit("src")).when(k % 10 == 0, F.lit("")).when(k % 3 == 0, F.lit("sensor_perception")).otherwise(F.lit("src")).alias("source_id"),
        F.when(clean, F.lit(1.0)).otherwise(_pick((1.0, 0.5, 1.5, 1.0), k, "double")).alias("inference_strength"), F.lit(None).cast("string").alias("source_url"),
    )


def records(spark, d) -> DataFrame:
    """A v3.0 record for each event, of two datasets, with faults of every kind by the event's number."""
    i, clean = F.col("i"), F.col("i") % 3 == 0
    sensor = i % 2 == 0
    label = F.when(clean, _pick(LABELS[:4], F.floor(i / 3))).otherwise(_pick(LABELS, i))
    triple, two = F.array(F.array(F.lit("cup"), F.lit("in"), F.lit("sink"))), F.array(F.array(F.lit("cup"), F.lit("in"), F.lit("sink")), F.array(F.lit("cup"), F.lit("is"), F.lit("hot")))
    broken = F.array(F.array(F.lit("cup"), F.lit("in")), F.array(F.lit("cup"), F.lit("in"), F.lit("sink")))
    none = F.lit(None).cast("array<array<string>>")
    n = F.when(clean, i % 2 + 1).otherwise(i % 4)
    items = F.transform(F.sequence(F.lit(0).cast("long"), n), lambda j: _item(i, j, sensor, label))
    rows = B.table(spark, d, "events").select(F.col("event_id").alias("i")).select(
        F.when(~clean & (i % 97 == 1), F.lit("2.9")).otherwise(F.lit("3.0")).alias("schema_version"), F.concat(F.lit("rec-"), i.cast("string")).alias("id"), _pick(CLAIMS, i).alias("claim"),
        F.struct(label.alias("label"), F.lit(None).cast("string").alias("justification"), F.when(~clean & (i % 19 == 1), F.lit("guessed")).otherwise(F.lit("annotated")).alias("derivation_method")).alias("verdict"),
        F.struct(
            F.when(clean, F.array(F.when(sensor, "perception").otherwise("testimony"))).otherwise(_pick((("testimony",), ("non_apprehension",), ("perception",), ("non_apprehension", "perception"), None), i, "array<string>")).alias("evidence_types_all"),
            F.when(clean, F.when(sensor, "simulator").otherwise("heuristic")).otherwise(_pick(("simulator", "heuristic", "guess"), F.floor(i / 2))).alias("assignment_method"),
        ).alias("epistemic"),
        F.when(sensor, F.when(clean, triple).when(i % 11 == 0, none).when(i % 11 == 2, two).when(i % 11 == 4, broken).otherwise(triple)).when(i % 23 == 1, triple).otherwise(none).alias("claim_triples"),
        F.when(~(~clean & (i % 29 == 1)), F.struct(F.when(clean, F.lit("one_hop")).otherwise(_pick(STRUCTURES, i)).alias("structural"), F.when(~clean & (i % 17 == 1), F.lit("luck")).alias("strategy"))).alias("reasoning"),
        F.slice(items, F.lit(1), n.cast("int")).alias("evidence"),
        F.struct(F.when(~clean & (i % 41 == 1), F.lit("Bad Name")).when(sensor, F.lit("ai2thor")).otherwise(F.lit("averitec")).alias("dataset"), F.when(clean, F.lit("train")).otherwise(_pick(("train", "valid", None), i)).alias("split"), F.lit(None).cast("string").alias("context_id")).alias("provenance"),
        F.struct(F.lit("3.0").alias("schema_version"), _pick(("2020-01-01T00:00:00Z", "yesterday", "", None), F.floor(i / 3)).alias("created_utc"), F.lit(None).cast("string").alias("template_type"), (i % 5 == 0).alias("is_shortcut_breaking")).alias("meta"),
    )
    return rows


def _sql_list(values: tuple) -> str:
    one = lambda v: "NULL" if v is None else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    return "[" + ", ".join(map(one, values)) + "]"


def _at(values: tuple, at: str) -> str:
    return f"({_sql_list(values)})[CAST({at} AS BIGINT) % {len(values)} + 1]"


_DECLARED = (("testimony",), ("non_apprehension",), ("perception",), ("non_apprehension", "perception"), None)
REC = f"""rec AS (SELECT *, CASE WHEN clean THEN i % 2 + 1 ELSE i % 4 END AS n_items, CASE WHEN bare THEN NULL WHEN clean THEN 'one_hop' ELSE {_at(STRUCTURES, "i")} END AS structural,
  CASE WHEN NOT bare AND NOT clean AND i % 17 = 1 THEN 'luck' END AS strategy, CASE WHEN clean THEN {_at(LABELS[:4], "i // 3")} ELSE {_at(LABELS, "i")} END AS label,
  CASE WHEN clean THEN [CASE WHEN sensor THEN 'perception' ELSE 'testimony' END] ELSE {_at(_DECLARED, "i")} END AS declared,
  CASE WHEN clean THEN CASE WHEN sensor THEN 'simulator' ELSE 'heuristic' END ELSE {_at(("simulator", "heuristic", "guess"), "i // 2")} END AS method,
  CASE WHEN sensor THEN CASE WHEN clean THEN 1 WHEN i % 11 = 0 THEN NULL WHEN i % 11 = 2 THEN 2 WHEN i % 11 = 4 THEN 2 ELSE 1 END WHEN i % 23 = 1 THEN 1 END AS n_triples,
  CASE WHEN sensor AND NOT clean AND i % 11 = 4 THEN 1 ELSE 0 END AS n_broken, CASE WHEN NOT clean AND i % 41 = 1 THEN 'Bad Name' WHEN sensor THEN 'ai2thor' ELSE 'averitec' END AS dataset,
  CASE WHEN clean THEN 'train' ELSE {_at(("train", "valid", None), "i")} END AS split, {_at(("2020-01-01T00:00:00Z", "yesterday", "", None), "i // 3")} AS created, {_at(CLAIMS, "i")} AS claim
  FROM (SELECT event_id AS i, event_id % 3 = 0 AS clean, event_id % 2 = 0 AS sensor, event_id % 3 <> 0 AND event_id % 29 = 1 AS bare FROM events)),
it AS (SELECT i, j, clean, sensor, CASE WHEN clean THEN 'Item text.' WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN '   ' WHEN k % 9 = 2 THEN '' ELSE 'Item text.' END AS text,
  clean OR k % 2 = 0 AS has_triple, CASE WHEN clean THEN 'ground_truth' ELSE {_at(("ground_truth", None, "guessed", "extracted"), "k")} END AS triple_source,
  CASE WHEN clean THEN CASE WHEN sensor THEN 'sensor' ELSE 'web_text' END ELSE {_at(("sensor", "web_text", "unanswerable", "hologram", None, "sensor"), "k")} END AS modality,
  CASE WHEN clean THEN CASE label WHEN 'supported' THEN 'supports' WHEN 'refuted' THEN 'refutes' WHEN 'conflicting_evidence' THEN CASE WHEN j % 2 = 0 THEN 'supports' ELSE 'refutes' END ELSE 'not_enough_evidence' END ELSE {_at(("supports", "refutes", "not_enough_evidence", None, "supports"), "k")} END AS stance,
  CASE WHEN clean THEN [CASE WHEN sensor THEN 'perception' ELSE 'testimony' END] ELSE {_at(TYPES, "k")} END AS types,
  CASE WHEN clean AND sensor THEN 'sensor_perception' WHEN clean THEN 'src' WHEN k % 10 = 0 THEN '' WHEN k % 3 = 0 THEN 'sensor_perception' ELSE 'src' END AS source_id,
  CASE WHEN clean THEN 1.0::DOUBLE ELSE {_at((1.0, 0.5, 1.5, 1.0), "k")} END AS strength
  FROM (SELECT rec.*, j, i + j AS k FROM rec, range(3) r(j) WHERE j < n_items)),
of AS (SELECT i, list_sort(list_distinct(flatten(list(coalesce(types, []))))) AS types, count(stance) AS n_stances, bool_or(stance = 'supports') AS sup, bool_or(stance = 'refutes') AS ref,
  bool_and(stance = 'supports') AS only_sup, bool_and(stance = 'refutes') AS only_ref, bool_and(text IS NULL) AS no_text, bool_and({{ok}}) AS ok FROM it GROUP BY 1),
wh AS (SELECT rec.*, coalesce(of.types, []) AS types, coalesce(n_stances, 0) AS n_stances, coalesce(sup, false) AS sup, coalesce(ref, false) AS ref, coalesce(only_sup, false) AS only_sup, coalesce(only_ref, false) AS only_ref, coalesce(no_text, false) AS no_text, coalesce(ok, false) AS items_ok,
  coalesce(list_contains(declared, 'non_apprehension'), false) AS absent, n_triples IS NOT NULL OR dataset = 'ai2thor' AS expected, f.stance AS first_stance, f.has_triple AS first_triple
  FROM rec LEFT JOIN of USING (i) LEFT JOIN it f ON f.i = rec.i AND f.j = 0)""".replace(
    "{ok}",
    f"coalesce(text, '') <> '' AND source_id <> '' AND coalesce(modality IN {V.MODALITIES}, false) AND coalesce(stance IN {V.STANCES}, false) AND types IS NOT NULL AND len(list_filter(types, lambda t: t NOT IN {V.EVIDENCE_TYPES})) = 0 "
    "AND strength BETWEEN 0 AND 1 AND (triple_source IS NULL OR triple_source IN ('ground_truth', 'extracted'))",
)
_NEGATED = " OR ".join(f"""contains(lower(claim), '{n.replace("'", "''")}')""" for n in X.NEGATIONS)
#: SQL: (i, rule) of each issue, with its severity: of the shared families, and of either dataset.
SHARED = {
    "V0": ("error", f"wh WHERE NOT coalesce(NOT (NOT clean AND i % 97 = 1) AND label IN {V.VERDICTS} AND NOT (NOT clean AND i % 19 = 1) AND method IN {V.ASSIGNMENTS} AND (structural IS NULL OR structural IN {V.STRUCTURES}) AND strategy IS NULL AND n_items > 0 AND items_ok AND dataset <> 'Bad Name' AND (split IS NULL OR split = 'train'), false)"),
    "V1": ("error", "wh WHERE expected AND structural = 'one_hop' AND coalesce(n_triples, 0) <> 1"),
    "V2": ("error", "wh WHERE expected AND structural = 'conjunction' AND coalesce(n_triples, 0) < 2"),
    "V3": ("warning", f"wh WHERE structural = 'negation' AND NOT ({_NEGATED}) AND label IS DISTINCT FROM 'refuted'"),
    "V4": ("error", "wh WHERE n_broken = 1"),
    "V5": ("warning", "it WHERE list_contains(types, 'non_apprehension') AND stance = 'supports' AND has_triple"),
    "V6": ("error", "it WHERE text = '   '"),
    "V7": ("error", "it WHERE coalesce(modality, '') <> 'unanswerable' AND coalesce(len(types), 0) < 1"),
    "V18": ("error", f"wh WHERE label <> '' AND label NOT IN {V.VERDICTS}"),
    "V19": ("error", "wh WHERE types <> list_sort(coalesce(declared, []))"),
    "V20": ("error", "wh WHERE label = 'supported' AND n_stances > 0 AND NOT sup"),
    "V21": ("error", "wh WHERE label = 'refuted' AND n_stances > 0 AND NOT ref"),
    "V22": ("warning", "wh WHERE label = 'conflicting_evidence' AND n_stances > 0 AND NOT sup AND NOT ref"),
    "V23": ("error", "wh WHERE label = 'not_enough_evidence' AND absent"),
    "V24": ("error", "wh WHERE absent AND NOT sup AND NOT ref"),
    "V25": ("warning", "wh WHERE created = 'yesterday'"),
    "V26": ("warning", "wh WHERE dataset = 'ai2thor' AND n_triples IS NULL AND NOT absent AND structural IS DISTINCT FROM 'absence'"),
    "V27": ("info", "wh WHERE dataset = 'averitec' AND n_triples IS NOT NULL"),
}
_SIM = "i IN (SELECT i FROM rec WHERE dataset = 'ai2thor')"
_NET = "i IN (SELECT i FROM rec WHERE dataset = 'averitec')"
DATASET = {
    "V28": f"wh WHERE n_items = 0 AND {_SIM}",
    "V29": f"wh WHERE n_items > 0 AND {_SIM} AND absent AND first_stance = 'supports' AND first_triple",
    "V30": f"wh WHERE n_items > 0 AND {_SIM} AND absent AND NOT coalesce(first_stance IN ('supports', 'refutes'), false)",
    "V31": f"wh WHERE n_items > 0 AND {_SIM} AND NOT absent AND structural IS DISTINCT FROM 'absence' AND n_triples IS NULL",
    "V32": f"wh WHERE n_items > 0 AND {_SIM} AND bare",
    "V33": f"(SELECT i, unnest(declared) AS t FROM wh WHERE n_items > 0 AND {_SIM}) WHERE t NOT IN {X.SIMULATOR_TYPES}",
    "V34": f"wh WHERE n_items > 0 AND {_SIM} AND method <> 'simulator'",
    "V35": f"it WHERE {_SIM} AND modality IS DISTINCT FROM 'sensor'",
    "V36": f"it WHERE {_SIM} AND source_id <> 'sensor_perception'",
    "V37": f"it WHERE {_SIM} AND strength <> 1",
    "V38": f"wh WHERE {_NET} AND n_items = 0",
    "V39": f"wh WHERE {_NET} AND n_items > 0 AND label IS NULL",
    "V40": f"wh WHERE {_NET} AND n_items = 0 AND label IS NOT NULL",
    "V41": f"wh WHERE {_NET} AND n_triples IS NOT NULL",
    "V42": f"wh WHERE {_NET} AND absent",
    "V43": f"wh WHERE {_NET} AND label = 'conflicting_evidence' AND n_stances > 0 AND only_sup",
    "V44": f"wh WHERE {_NET} AND label = 'conflicting_evidence' AND n_stances > 0 AND only_ref",
    "V45": f"wh WHERE {_NET} AND n_items > 0 AND no_text",
    "V46": f"wh WHERE {_NET} AND method <> 'heuristic'",
    "V47": f"it WHERE {_NET} AND modality = 'sensor'",
    "V48": f"it WHERE {_NET} AND stance IN ('supports', 'refutes') AND coalesce(len(types), 0) < 1",
}
CHECKED = f"""{REC}, cl AS (SELECT i AS doc_id, claim AS text FROM rec), {SHARED_TEXT_RULES},
sh AS ({" UNION ALL ".join(f"SELECT i, '{r}' AS rule, '{s}' AS severity FROM {t}" for r, (s, t) in SHARED.items())} UNION ALL
  SELECT doc_id, rule, CASE WHEN rule IN ('V8', 'V15') THEN 'error' ELSE 'warning' END FROM (SELECT doc_id, unnest(rules) AS rule FROM iss)),
ds AS ({" UNION ALL ".join(f"SELECT i, '{r}' AS rule FROM {t}" for r, t in DATASET.items())})"""
_LOST = "sum(CASE severity WHEN 'error' THEN 0.3::DOUBLE WHEN 'warning' THEN 0.1::DOUBLE ELSE 0.02::DOUBLE END)"


def _names(column: str) -> Column:
    return F.array_join(F.array_sort(F.transform(column, lambda x: x["rule"])), ",")


def record_issues(spark, d):
    """Every rule of every record, V0 to V48, with validity and quality."""
    checked = X.validated(records(spark, d))
    return checked.select("id", _names("issues").alias("rules"), _names("dataset_issues").alias("dataset_rules"), "is_valid", F.round("quality", 4).alias("quality"))


SOURCES = (("sensor_perception", 0.95), ("src", 0.7), ("unknown_web", 0.35))


def predicted_records(spark, d):
    """Every raw record from its evidence to its verdict; the formula decides where the scores don't."""
    registry = spark.createDataFrame(list(SOURCES), "source_id string, source_trust double")
    out = PR.predict(records(spark, d), registry, O.by_thresholds)
    return out.select("id", "verdict", "path", "decided_by", "support", "refute", "n_items", "reason", F.element_at("evidence", 1)["source_id"].alias("first_source"))


def record_graphs(spark, d):
    """Edges of each kind in the records' graphs."""
    _, edges = PR.graph_tables(records(spark, d))
    return edges.groupBy("id", "kind").agg(F.count("*").alias("n"))


def issue_examples(spark, d):
    """O2: the first three records that break each rule, with five messages at most."""
    found = EX.issue_examples(X.validated(records(spark, d)).select("id", "issues"))
    return found.select("rule", "id", "n", F.size("messages").cast("long").alias("n_messages"))


def record_issue_counts(spark, d):
    checked = X.validated(records(spark, d)).select(F.concat("issues", "dataset_issues").alias("issues"))
    return X.issue_counts(checked)


def record_gate(spark, d):
    kept, dropped = X.schema_gate(records(spark, d))
    return kept.select("id", F.lit(True).alias("kept")).unionByName(dropped.select("id", F.lit(False).alias("kept")))


def split_profile(spark, d):
    """Counts of all dimensions by split, and averages of evidence and triples."""
    return P.split_profile(records(spark, d))


def split_averages(spark, d):
    return P.split_averages(records(spark, d))


def simulator_records(spark, d):
    """Records of the simulator in the unified layout."""
    c = C.simulator_claims(records(spark, d).where("provenance.dataset = 'ai2thor'"))
    first = F.try_element_at(F.col("evidence"), F.lit(1))
    return c.select(
        "id", F.col("verdict.label").alias("label"), F.array_join("epistemic.evidence_types_all", ",").alias("types"), F.col("epistemic.assignment_method").alias("method"),
        F.size("claim_triples").cast("long").alias("n_triples"), F.array_join(F.flatten(first["triples"]), ",").alias("first"),
    )


_PREDICATES = ("temperature", "inside", "near", "isDirty", "openable")


def _legacy(spark, d):
    i = F.col("event_id")
    triple = F.array(F.array(F.lit("cup%7C1"), F.concat(F.lit("http://e.org/r/"), _pick(_PREDICATES, i)), F.concat(F.lit("v"), (i % 3).cast("string"))))
    observed = F.when(i % 6 == 0, F.array().cast("array<array<string>>")).otherwise(triple)
    return B.table(spark, d, "events").select(
        F.concat(F.lit("leg-"), i.cast("string")).alias("id"), F.lit(" The cup is so. ").alias("claim"), F.when(i % 2 == 0, " Supported").otherwise("REFUTED ").alias("label"),
        F.struct(observed.alias("triples"), F.lit("Seen.").alias("text"), _pick(_PREDICATES, i).alias("predicate")).alias("evidence"), triple.alias("claim_triples"),
    )


def legacy_records(spark, d):
    """Records whose evidence is one struct."""
    c = C.simulator_claims_legacy(_legacy(spark, d))
    e = F.col("evidence")[0]
    return c.select(
        "id", F.col("verdict.label").alias("label"), F.col("verdict.justification").alias("why"), F.col("reasoning.strategy").alias("strategy"), F.array_join("epistemic.evidence_types_all", ",").alias("types"),
        e["stance"].alias("stance"), F.array_join(F.flatten("claim_triples"), ",").alias("triples"),
    )


def template_registry(spark) -> DataFrame:
    """Trusts of the sources that the templates of synthetic claims name."""
    rows = [("reuters_web_text", 0.85), ("apnews_web_text", 0.82), ("bbc_web_text", 0.85), ("social_media_web_text", 0.35), ("sensor_perception", 0.95), ("academic_pdf", 0.9), ("general_web_text", 0.55)]
    return spark.createDataFrame(rows, "source_id string, source_trust double")


def _synthetic(spark, d):
    """As many synthetic claims as there are labelled documents."""
    return G.synthetic_claims(G.template_table(spark), template_registry(spark), B.table(spark, d, "labels").count())


def template_claims(spark, d):
    return _synthetic(spark, d).select("id", "template", "is_shortcut_breaking", "support", "refute", "verdict")


def batch_report(spark, d):
    """The synthetic claims, some with a changed verdict or without a field."""
    n = F.regexp_extract("id", r"(\d+)$", 1).cast("long")
    c = _synthetic(spark, d).withColumn("stored", F.when(n % 10 == 0, F.lit("refuted")).otherwise(F.col("verdict"))).withColumn("claim", F.when(n % 7 != 0, F.lit("A claim.")))
    missing = X.missing_fields(c, ("id", "claim", "stored"))
    return X.batch_report(missing.select("id", F.col("stored").alias("verdict"), F.col("verdict").alias("recomputed"), "is_shortcut_breaking", "n_missing_fields"))


def _weight(t: str) -> float:
    return V.EVIDENCE_WEIGHTS[t]


def _template_sql() -> str:
    trust = {"reuters_web_text": 0.85, "apnews_web_text": 0.82, "bbc_web_text": 0.85, "social_media_web_text": 0.35, "sensor_perception": 0.95, "academic_pdf": 0.9, "general_web_text": 0.55}
    rows = []
    for k, (name, breaks, share, items) in enumerate(G.TEMPLATES):
        part = lambda side: " * ".join(["1.0::DOUBLE", *(f"(1 - round(1 - pow(1 - {trust.get(s, 0.4)}::DOUBLE, {_weight(t)}::DOUBLE * {x}::DOUBLE), 4))" for st, s, t, x in items if st == side)])  # noqa: B023, E731
        rows.append(f"SELECT {k} AS k, '{name}' AS template, {str(breaks).lower()} AS is_shortcut_breaking, {share}::DOUBLE AS share, round(1 - {part('supports')}, 4) AS support, round(1 - {part('refutes')}, 4) AS refute")
    return f"""tm AS ({" UNION ALL ".join(rows)}), nn AS (SELECT count(*) AS n FROM labels), ex AS (SELECT *, share / (SELECT sum(share) FROM tm) * (SELECT n FROM nn) AS e FROM tm),
ap AS (SELECT *, floor(e) + CASE WHEN row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, k) <= (SELECT n FROM nn) - (SELECT sum(floor(e)) FROM ex) THEN 1 ELSE 0 END AS n FROM ex),
sy AS (SELECT 'synthetic-' || template || '-' || lpad(CAST(r AS VARCHAR), 6, '0') AS id, template, is_shortcut_breaking, support, refute, {B.VERDICT} AS verdict, r FROM (SELECT *, unnest(range(1, CAST(n AS BIGINT) + 1)) AS r FROM ap))"""


# Files: written to a folder that driver and executors share, read back, and compared with what went in.


def _folder(spark) -> str:
    """A new folder of this run under the shared one."""
    return new_folder(spark, "files")


def jsonl_files(spark, d):
    """Records as JSON lines and back."""
    at = _folder(spark)
    R.write_jsonl(records(spark, d), at)
    return R.read_jsonl(spark, at).select("id", "claim", F.col("verdict.label").alias("label"), F.size("evidence").cast("long").alias("n"))


def ntriples_files(spark, d):
    """Triples as N-Triples lines and back."""
    at = _folder(spark)
    R.write_ntriples(B.triples(spark, d), at)
    return R.read_ntriples(spark, at)


def turtle_files(spark, d):
    """Turtle text with prefixes and lists."""
    at = _folder(spark)
    n = B.table(spark, d, "nation")
    head = F.lit("@prefix e: <http://e.org/> .\n")
    body = F.concat(F.lit("e:n"), F.col("n_nationkey").cast("string"), F.lit(" a e:Nation ;\n  e:in e:r"), F.col("n_regionkey").cast("string"), F.lit(', <http://e.org/world> ;\n  e:name "'), "n_name", F.lit('" .'))
    n.select(F.concat(head, body).alias("value")).repartition("value").write.option("lineSep", "\n").text(at)
    return R.read_turtle(spark, at)


def turtle_round_trip(spark, d):
    """All triples as Turtle with prefixes and lists, and texts with line breaks, and back."""
    at = _folder(spark)
    said = B.table(spark, d, "conversations").select(F.format_string("http://e.org/turn#c%s-%d", F.col("conv_id").cast("string"), F.col("turn").cast("long")).alias("s"), F.lit("http://e.org/said").alias("p"), F.concat("role", F.lit(':\n"\t'), "text", F.lit('\\"')).alias("o"))
    TTL.write_turtle(B.triples(spark, d).select("s", "p", "o").unionByName(said), at, {"kg": f"{B.BASE}/entities/"})
    return TTL.read_turtle(spark, at, strict=True)


def scene_files(spark, d):
    """Orders as recorded scenes of their lines, a scene a customer's nation; two of them are read back."""
    at = _folder(spark)
    rel = F.array(F.struct(F.lit("isInside").alias("predicate"), F.concat(F.lit("Order|"), "l_orderkey").alias("object")))
    li = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(B.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    objects = li.select(
        F.concat(F.lit("nation "), "c_nationkey").alias("scene_id"), F.concat_ws("|", F.lit("Part"), "l_partkey", "l_orderkey", "l_linenumber").alias("object_id"), F.lit("Part").alias("object_type"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("quantity"), F.col("l_quantity").cast("int").cast("string")).alias("properties"), rel.alias("relations"),
    )
    SC.write_scenes(objects, at)
    two = SC.read_scenes(spark, at, ["nation 3", "nation 11"])
    return two.select("scene_id", "object_id", F.col("properties")["flag"].alias("flag"), F.col("properties")["quantity"].alias("quantity"), F.col("relations")[0]["object"].alias("inside"))


def split_files(spark, d):
    """A split index by line, written, read, and used to take the test rows."""
    at = _folder(spark)
    c = B.claims(spark, d).select(F.col("doc_id").alias("line_idx"), "label")
    R.write_split_index(S.stratified_split(c, "line_idx", "label"), at)
    return S.members(c, R.read_split_index(spark, at), "test")


def registry_files(spark, d):
    """A registry as JSON lines, read with its check."""
    at = _folder(spark)
    R.write_jsonl(B.web_registry(spark).withColumn("source_id", F.concat_ws("_", "source_type", "modality")).dropDuplicates(["source_id"]), at)
    return R.read_registry(spark, at).select("source_id", "source_trust")


def report_files(spark, d):
    """Metric reports as JSON documents of models, read as one frame."""
    at = _folder(spark)
    e = B.table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.round(F.avg("value"), 4).alias("loss"))
    e.write.partitionBy("model").json(at)
    return R.read_reports(spark, at).select("model", "loss")


def cached_graphs(spark, d):
    """A frame built once and read from its files after that, while its stamp is the same."""
    at = _folder(spark)
    build = lambda: B.triples(spark, d).groupBy("p").agg(F.count("*").alias("n"))
    R.cached_frame(spark, at, "v1", build)
    return R.cached_frame(spark, at, "v1", lambda: spark.range(0).select(F.lit("").alias("p"), F.lit(0).alias("n")))


QUERIES = {
    "record_issues": (record_issues, f"WITH {CHECKED}, q AS (SELECT i, string_agg(rule, ',' ORDER BY rule) AS rules, bool_or(severity = 'error') AS bad, {_LOST} AS lost FROM sh GROUP BY 1), dq AS (SELECT i, string_agg(rule, ',' ORDER BY rule) AS rules FROM ds GROUP BY 1), x AS (SELECT rec.i, claim, coalesce(q.rules, '') AS rules, coalesce(dq.rules, '') AS dataset_rules, NOT coalesce(bad, false) AS is_valid, coalesce(lost, 0) AS lost FROM rec LEFT JOIN q USING (i) LEFT JOIN dq USING (i)) "
        "SELECT 'rec-' || CAST(i AS VARCHAR) AS id, rules, dataset_rules, is_valid, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - lost + CASE WHEN length(claim) BETWEEN 10 AND 150 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(claim, '[.!?]$') THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(claim, '\\s+'), lambda w: w <> '')) >= 5 THEN 0.03::DOUBLE ELSE 0 END)), 4) AS quality FROM x"),
    "predicted_records": (
        predicted_records,
        f"""WITH {REC}, us AS (SELECT i, j, stance, CASE WHEN source_id IN ('sensor_perception', 'src') THEN source_id ELSE 'unknown_web' END AS source_id, types, strength FROM it WHERE trim(coalesce(text, '')) <> '' OR has_triple),
wt AS (SELECT *, CASE source_id {" ".join(f"WHEN '{s}' THEN {t}::DOUBLE" for s, t in SOURCES)} END AS trust, round(1 - coalesce(list_aggregate([1 - CASE t {" ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, w in V.EVIDENCE_WEIGHTS.items())} ELSE 0.0::DOUBLE END FOR t IN types], 'product'), 1.0), 4) AS weight FROM us),
cf AS (SELECT *, CASE WHEN weight * strength = 0 THEN 0.0 ELSE round(1 - pow(1 - trust, weight * strength), 4) END AS confidence FROM wt),
sc AS (SELECT i, round(1 - coalesce(product(1 - confidence) FILTER (stance = 'supports'), 1.0), 4) AS support, round(1 - coalesce(product(1 - confidence) FILTER (stance = 'refutes'), 1.0), 4) AS refute, count(*) AS n_items, arg_min(source_id, (-confidence, j)) AS first_source FROM cf GROUP BY 1),
al AS (SELECT rec.i, coalesce(support, 0.0) AS support, coalesce(refute, 0.0) AS refute, coalesce(sc.n_items, 0) AS n_items, first_source FROM rec LEFT JOIN sc USING (i)), pt AS (SELECT *, {B.PATH} AS path, {B.VERDICT} AS formula FROM al)
SELECT 'rec-' || CAST(i AS VARCHAR) AS id, CASE path WHEN 'symbolic_supported' THEN 'supported' WHEN 'symbolic_refuted' THEN 'refuted' ELSE formula END AS verdict, path, CASE WHEN starts_with(path, 'symbolic_') THEN 'scores' ELSE 'fallback' END AS decided_by, support, refute, n_items,
  printf('support %.4f, refute %.4f, %d items: %s', support, refute, n_items, path) AS reason, first_source FROM pt""",
    ),
    "record_graphs": (record_graphs, f"""WITH {REC}, us AS (SELECT i, has_triple, count(*) OVER (PARTITION BY i) AS n FROM it WHERE trim(coalesce(text, '')) <> '' OR has_triple), ev AS (SELECT i, count(*) AS n, count(*) FILTER (has_triple) AS n_from FROM us GROUP BY 1),
ed AS (SELECT i, 'has_evidence' AS kind, n FROM ev UNION ALL SELECT i, 'connected_to', n FROM ev UNION ALL SELECT i, 'co_evidence', n * (n - 1) FROM ev UNION ALL SELECT i, 'has_triple', n_triples FROM rec UNION ALL SELECT i, 'from_triple', n_from FROM ev)
SELECT 'rec-' || CAST(i AS VARCHAR) AS id, kind, CAST(n AS BIGINT) AS n FROM ed WHERE n > 0"""),
    "issue_examples": (issue_examples, f"WITH {CHECKED}, al AS (SELECT i, least(5, count(*)) AS n_messages FROM sh GROUP BY 1), ea AS (SELECT rule, 'rec-' || CAST(i AS VARCHAR) AS id, count(*) AS n, n_messages FROM sh JOIN al USING (i) GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY id) AS k FROM ea) SELECT rule, id, n, n_messages FROM rk WHERE k <= 3"),
    "record_issue_counts": (record_issue_counts, f"WITH {CHECKED} SELECT rule, CASE WHEN rule = 'V0' THEN 'schema' WHEN CAST(substr(rule, 2) AS INT) < 8 THEN 'semantic' WHEN CAST(substr(rule, 2) AS INT) < 18 THEN 'quality' ELSE 'consistency' END AS category, severity, count(*) AS n FROM sh GROUP BY ALL UNION ALL SELECT rule, 'dataset', 'error', count(*) FROM ds GROUP BY ALL"),
    "record_gate": (record_gate, f"WITH {REC} SELECT 'rec-' || CAST(i AS VARCHAR) AS id, i NOT IN (SELECT i FROM {SHARED['V0'][1]}) AS kept FROM rec"),
    "split_profile": (split_profile, f"WITH {REC}, sp AS (SELECT coalesce(split, 'null') AS split, * EXCLUDE (split) FROM rec), si AS (SELECT sp.split, it.* FROM it JOIN sp USING (i)) SELECT split, 'source' AS dim, dataset AS key, count(*) AS n FROM sp GROUP BY ALL UNION ALL SELECT split, 'verdict', coalesce(label, 'null'), count(*) FROM sp GROUP BY ALL UNION ALL SELECT split, 'modality', coalesce(modality, 'null'), count(*) FROM si GROUP BY ALL UNION ALL SELECT split, 'stance', coalesce(stance, 'null'), count(*) FROM si GROUP BY ALL UNION ALL SELECT split, 'type', t, count(*) FROM (SELECT split, unnest(types) AS t FROM si) GROUP BY ALL"),
    "split_averages": (split_averages, f"WITH {REC}, w AS (SELECT i, count(*) AS n FROM it WHERE trim(coalesce(text, '')) <> '' GROUP BY 1) SELECT coalesce(split, 'null') AS split, count(*) AS n, round(sum(coalesce(w.n, 0))::DOUBLE / count(*), 2) AS avg_evidence, round(sum(coalesce(n_triples, 0))::DOUBLE / count(*), 2) AS avg_triples FROM rec LEFT JOIN w USING (i) GROUP BY 1"),
    "simulator_records": (simulator_records, f"WITH {REC} SELECT 'rec-' || CAST(i AS VARCHAR) AS id, CASE WHEN label IN {V.VERDICTS} THEN label END AS label, array_to_string(types, ',') AS types, 'simulator' AS method, CAST(n_triples - n_broken AS BIGINT) AS n_triples, CASE WHEN n_items = 0 THEN NULL WHEN first_triple THEN 'http://e.org/x|1,in,box' ELSE '' END AS first FROM wh WHERE dataset = 'ai2thor'"),
    "legacy_records": (legacy_records, f"""WITH x AS (SELECT event_id AS i, event_id % 2 = 0 AS good, event_id % 6 = 0 AS none, {_at(_PREDICATES, "event_id")} AS p, 'v' || CAST(event_id % 3 AS VARCHAR) AS v FROM events),
y AS (SELECT *, CASE WHEN none THEN 'absence_detection' WHEN p IN ('inside', 'near') THEN 'spatial_comparison' ELSE 'direct_observation' END AS strategy FROM x)
SELECT 'leg-' || CAST(i AS VARCHAR) AS id, CASE WHEN good THEN 'supported' ELSE 'refuted' END AS label, CASE WHEN p = 'temperature' THEN 'Sensor shows temperature=' || CASE WHEN none THEN 'unknown' ELSE v END || CASE WHEN good THEN ', matching claim.' ELSE ', contradicting claimed value (' || v || ').' END
  WHEN p IN ('inside', 'near') THEN 'Sensor ' || CASE WHEN good THEN 'confirms' ELSE 'contradicts' END || ' spatial relation (' || p || ').' WHEN none THEN 'No sensor evidence found to support the claim.' ELSE 'Sensor observation ' || CASE WHEN good THEN 'matches' ELSE 'contradicts' END || ' the claim.' END AS why, strategy,
  CASE strategy WHEN 'absence_detection' THEN 'non_apprehension,perception' WHEN 'spatial_comparison' THEN 'comparison_analogy,perception' ELSE 'perception' END AS types, CASE WHEN good THEN 'supports' ELSE 'refutes' END AS stance, 'cup|1,' || p || ',' || v AS triples FROM y"""),
    "template_claims": (template_claims, f"WITH {_template_sql()} SELECT id, template, is_shortcut_breaking, support, refute, verdict FROM sy"),
    "batch_report": (batch_report, f"WITH {_template_sql()}, b AS (SELECT count(*) AS n, count(*) FILTER (is_shortcut_breaking) AS n_shortcut, count(*) FILTER (r % 7 = 0) AS n_missing, count(*) FILTER (r % 10 = 0 AND verdict <> 'refuted') AS n_mismatch FROM sy) SELECT *, round(n_shortcut::DOUBLE / n, 4) AS shortcut_fraction, n > 0 AND n_shortcut::DOUBLE / n >= 0.35::DOUBLE AND n_missing = 0 AND n_mismatch = 0 AS passed FROM b"),
    "jsonl_files": (jsonl_files, f"WITH {REC} SELECT 'rec-' || CAST(i AS VARCHAR) AS id, claim, label, n_items AS n FROM rec"),
    "ntriples_files": (ntriples_files, f"WITH {B.TR} SELECT s, p, o FROM tr"),
    "scene_files": (scene_files, "SELECT 'nation ' || CAST(c_nationkey AS VARCHAR) AS scene_id, 'Part|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS object_id, l_returnflag AS flag, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, 'Order|' || CAST(l_orderkey AS VARCHAR) AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 11)"),
    "turtle_round_trip": (turtle_round_trip, f"WITH {B.TR} SELECT s, p, o FROM tr UNION ALL SELECT 'http://e.org/turn#c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'http://e.org/said', role || ':' || chr(10) || '\"' || chr(9) || text || chr(92) || '\"' FROM conversations"),
    "turtle_files": (turtle_files, "WITH n AS (SELECT 'http://e.org/n' || CAST(n_nationkey AS VARCHAR) AS s, n_name, 'http://e.org/r' || CAST(n_regionkey AS VARCHAR) AS r FROM nation) SELECT s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'http://e.org/Nation' AS o FROM n UNION ALL SELECT s, 'http://e.org/in', r FROM n UNION ALL SELECT s, 'http://e.org/in', 'http://e.org/world' FROM n UNION ALL SELECT s, 'http://e.org/name', n_name FROM n"),
    "split_files": (split_files, f"WITH {B.CL}, rk AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM cl) SELECT doc_id AS line_idx, label FROM rk WHERE r > floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE)"),
    "registry_files": (registry_files, f"WITH {B.WEB} SELECT source_type || '_' || modality AS source_id, max(source_trust)::DOUBLE AS source_trust FROM wreg GROUP BY 1"),
    "report_files": (report_files, "SELECT event_type AS model, round(avg(value), 4) AS loss FROM events GROUP BY 1"),
    "cached_graphs": (cached_graphs, f"WITH {B.TR} SELECT p, count(*) AS n FROM tr GROUP BY 1"),
}
