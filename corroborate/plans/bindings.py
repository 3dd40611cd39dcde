"""Views that turn the input tables into evidence, registries, triples, claims and predictions.

Each exists twice: as a DataFrame for the queries, and as a common table expression for the SQL that
checks them. Both read the same tables and say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "http://example.org/kg"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence items from events: a claim per user and day."""
    kind = F.col("event_type")
    first = F.when(kind == "signup", "perception").when(kind == "purchase", "testimony").when(kind == "error", "non_apprehension").when(kind == "view", "comparison_analogy").otherwise("inference")
    stance = F.when(kind.isin("purchase", "signup"), "supports").when(kind == "error", "refutes").otherwise("not_enough_evidence")
    return table(spark, sf_dir, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("claim_id"), "event_id", "ts",
        stance.alias("stance"), F.when(F.col("event_id") % 5 == 0, F.array(first, F.lit("postulation_derivation"))).otherwise(F.array(first)).alias("evidence_types"),
        F.least(F.col("value") / 50, F.lit(1.0)).alias("inference_strength"), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("source_id"),
        "event_type", F.element_at(F.array(*map(F.lit, ("web_text", "pdf", "web_table", "sensor"))), (F.col("event_id") % 4 + 1).cast("int")).alias("modality"),
    )


EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS claim_id, event_id, ts,
         CASE WHEN event_type IN ('purchase','signup') THEN 'supports' WHEN event_type = 'error' THEN 'refutes' ELSE 'not_enough_evidence' END AS stance,
         CASE event_type WHEN 'signup' THEN 'perception' WHEN 'purchase' THEN 'testimony' WHEN 'error' THEN 'non_apprehension' WHEN 'view' THEN 'comparison_analogy' ELSE 'inference' END AS t1,
         event_id % 5 = 0 AS has_post, least(value / 50, 1.0) AS inference_strength, 'src' || CAST(event_id % 20 AS VARCHAR) AS source_id, event_type,
         CASE event_id % 4 WHEN 0 THEN 'web_text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'web_table' ELSE 'sensor' END AS modality
  FROM events)"""


def registry(spark: SparkSession) -> DataFrame:
    """15 of the 20 sources that events name, with trust, type and modality."""
    i = F.col("id")
    return spark.range(15).select(
        F.concat(F.lit("src"), i.cast("string")).alias("source_id"), F.round(0.30 + 0.04 * i, 2).alias("source_trust"),
        F.element_at(F.array(*map(F.lit, ("news_media", "government", "scientific_paper", "social_media", "sensor"))), (i % 5 + 1).cast("int")).alias("source_type"),
        F.element_at(F.array(*map(F.lit, ("web_text", "pdf", "web_table"))), (i % 3 + 1).cast("int")).alias("modality"),
        F.concat(F.lit("Source "), i.cast("string")).alias("source_name"),
    )


REG = """reg AS (
  SELECT 'src' || CAST(i AS VARCHAR) AS source_id, CAST(round(0.30 + 0.04 * i, 2) AS DOUBLE) AS source_trust,
         CASE i % 5 WHEN 0 THEN 'news_media' WHEN 1 THEN 'government' WHEN 2 THEN 'scientific_paper' WHEN 3 THEN 'social_media' ELSE 'sensor' END AS source_type,
         CASE i % 3 WHEN 0 THEN 'web_text' WHEN 1 THEN 'pdf' ELSE 'web_table' END AS modality, 'Source ' || CAST(i AS VARCHAR) AS source_name
  FROM range(15) t(i))"""

WEIGHT_OF = "CASE {t} WHEN 'perception' THEN 0.95 WHEN 'testimony' THEN 0.80 WHEN 'non_apprehension' THEN 0.75 WHEN 'comparison_analogy' THEN 0.65 WHEN 'inference' THEN 0.55 ELSE 0.40 END"
ITEMS = f"""{EV}, {REG}, wt AS (
  SELECT ev.*, coalesce(source_trust, 0.40::DOUBLE) AS source_trust,
         round(1 - 1.0::DOUBLE * (1 - CAST({WEIGHT_OF.format(t="t1")} AS DOUBLE)) * (CASE WHEN has_post THEN 1 - 0.40::DOUBLE ELSE 1.0::DOUBLE END), 4) AS weight
  FROM ev LEFT JOIN reg USING (source_id)), items AS (
  SELECT *, CASE WHEN weight * inference_strength = 0 THEN 0.0 ELSE round(1 - pow(1 - source_trust, weight * inference_strength), 4) END AS confidence FROM wt)"""
SCORES = f"""{ITEMS}, scores AS (
  SELECT claim_id, round(1 - coalesce(product(1 - confidence) FILTER (stance = 'supports'), 1.0), 4) AS support,
         round(1 - coalesce(product(1 - confidence) FILTER (stance = 'refutes'), 1.0), 4) AS refute FROM items GROUP BY claim_id)"""
VERDICT = "CASE WHEN support >= 0.75 AND refute < 0.40 THEN 'supported' WHEN refute >= 0.75 AND support < 0.40 THEN 'refuted' WHEN support >= 0.40 AND refute >= 0.40 THEN 'conflicting_evidence' ELSE 'not_enough_evidence' END"
PATH = "CASE WHEN support > 0.35 AND refute > 0.35 THEN 'vh_conflict' WHEN support > 0.35 THEN 'symbolic_supported' WHEN refute > 0.35 THEN 'symbolic_refuted' ELSE 'vh_fallback' END"


def _uri(kind: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"{BASE}/{kind}/"), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o, ord) about customers, suppliers, orders and parts; regions are contexts."""
    read = lambda name: table(spark, sf_dir, name)
    rel = lambda name: F.lit(f"{BASE}/relations/{name}").alias("p")
    at = lambda kind, key: (F.lit(kind * 10**12) + F.col(key).cast("long")).alias("ord")
    nation = lambda key: _uri("entities", "nation_", F.col(key))
    parts = [
        read("nation").select(nation("n_nationkey").alias("s"), rel("inRegion"), _uri("entities", "region_", F.col("n_regionkey")).alias("o"), at(1, "n_nationkey")),
        read("nation").select(_uri("contexts", "region_", F.col("n_regionkey")).alias("s"), rel("hasObject"), nation("n_nationkey").alias("o"), at(2, "n_nationkey")),
        read("customer").select(_uri("entities", "customer_", F.col("c_custkey")).alias("s"), rel("inNation"), nation("c_nationkey").alias("o"), at(3, "c_custkey")),
        read("customer").select(_uri("entities", "customer_", F.col("c_custkey")).alias("s"), rel("segment"), F.col("c_mktsegment").alias("o"), at(4, "c_custkey")),
        read("customer").where("c_custkey % 2 = 0").select(_uri("entities", "customer_", F.col("c_custkey")).alias("s"), rel("inScene"), _uri("contexts", "region_", F.col("c_nationkey") % 5).alias("o"), at(5, "c_custkey")),
        read("supplier").select(_uri("entities", "supplier_", F.col("s_suppkey")).alias("s"), rel("inNation"), nation("s_nationkey").alias("o"), at(6, "s_suppkey")),
        read("orders").select(_uri("entities", "order_", F.col("o_orderkey")).alias("s"), rel("placedBy"), _uri("entities", "customer_", F.col("o_custkey")).alias("o"), at(7, "o_orderkey")),
        read("orders").select(_uri("entities", "order_", F.col("o_orderkey")).alias("s"), rel("isUrgent"), F.when(F.col("o_orderpriority") == "1-URGENT", "true").otherwise("false").alias("o"), at(8, "o_orderkey")),
        read("part").select(_uri("entities", "Part%7C", F.col("p_partkey")).alias("s"), rel("mass"), (F.col("p_size") % 10).cast("string").alias("o"), at(9, "p_partkey")),
        read("part").select(_uri("entities", "Part%7C", F.col("p_partkey")).alias("s"), rel("temperature"), F.element_at(F.array(*map(F.lit, ("Hot", "Cold", "RoomTemp"))), (F.col("p_size") % 3 + 1).cast("int")).alias("o"), at(10, "p_partkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql_triples() -> str:
    e = lambda kind, key: f"'{BASE}/entities/{kind}' || CAST({key} AS VARCHAR)"
    c = lambda key: f"'{BASE}/contexts/region_' || CAST({key} AS VARCHAR)"
    row = lambda s, p, o, k, key, t: f"SELECT {s} AS s, '{BASE}/relations/{p}' AS p, {o} AS o, CAST({k * 10**12} + {key} AS BIGINT) AS ord FROM {t}"
    rows = [
        row(e("nation_", "n_nationkey"), "inRegion", e("region_", "n_regionkey"), 1, "n_nationkey", "nation"),
        row(c("n_regionkey"), "hasObject", e("nation_", "n_nationkey"), 2, "n_nationkey", "nation"),
        row(e("customer_", "c_custkey"), "inNation", e("nation_", "c_nationkey"), 3, "c_custkey", "customer"),
        row(e("customer_", "c_custkey"), "segment", "c_mktsegment", 4, "c_custkey", "customer"),
        row(e("customer_", "c_custkey"), "inScene", c("c_nationkey % 5"), 5, "c_custkey", "customer WHERE c_custkey % 2 = 0"),
        row(e("supplier_", "s_suppkey"), "inNation", e("nation_", "s_nationkey"), 6, "s_suppkey", "supplier"),
        row(e("order_", "o_orderkey"), "placedBy", e("customer_", "o_custkey"), 7, "o_orderkey", "orders"),
        row(e("order_", "o_orderkey"), "isUrgent", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END", 8, "o_orderkey", "orders"),
        row(e("Part%7C", "p_partkey"), "mass", "CAST(p_size % 10 AS VARCHAR)", 9, "p_partkey", "part"),
        row(e("Part%7C", "p_partkey"), "temperature", "CASE p_size % 3 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Cold' ELSE 'RoomTemp' END", 10, "p_partkey", "part"),
    ]
    return "tr AS (" + " UNION ALL ".join(rows) + ")"


TR = _sql_triples()
LOCAL = "regexp_extract(replace({x}, '%7C', '|'), '([^#/]*)$', 1)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits of ten classes, each the sum of every tenth number of a vector, and the label."""
    every_tenth = lambda k: F.filter("embedding", lambda x, i: i % 10 == k)
    logits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.aggregate(every_tenth(k), F.lit(0.0), lambda a, x: a + x.cast("double")) * 10)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), logits.alias("logits"), F.concat(F.lit("g"), (F.col("vec_id") % 4).cast("string")).alias("source"))


PRED = """pr0 AS (SELECT vec_id, CAST(label AS INTEGER) AS label, [list_sum([CAST(x AS DOUBLE) FOR x IN embedding[k:len(embedding):10]]) * 10 FOR k IN range(1, 11)] AS logits, 'g' || CAST(vec_id % 4 AS VARCHAR) AS source FROM embeddings),
pr AS (SELECT vec_id, label, logits, source, CAST(list_position(logits, list_max(logits)) - 1 AS INTEGER) AS pred, exp(0) / list_sum([exp(x - list_max(logits)) FOR x IN logits]) AS conf FROM pr0)"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim texts with a label: documents and what is known of their quality."""
    labels = table(spark, sf_dir, "labels")
    label = F.when(F.col("quality").isNull(), "not_enough_evidence").when(F.col("toxic") == 1, "conflicting_evidence").when(F.col("quality") == 1, "supported").otherwise("refuted")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", label.alias("label"))


CL = """cl AS (SELECT d.doc_id, d.text, d.lang, d.source, CASE WHEN quality IS NULL THEN 'not_enough_evidence' WHEN toxic = 1 THEN 'conflicting_evidence' WHEN quality = 1 THEN 'supported' ELSE 'refuted' END AS label
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def web_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a modality; some pages are taken as archived."""
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("https://web.archive.org/web/20200101000000/"), "url")).otherwise(F.col("url"))
    kind = F.element_at(F.array(*map(F.lit, ("web_text", "pdf", "web_table"))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), kind.alias("modality"))


def web_registry(spark: SparkSession) -> DataFrame:
    """A registry that knows three of the hosts' parent names for texts, and the generic entries."""
    rows = [
        ("example_web_text", "news_media", "web_text", 0.8), ("tionsh_example_web_text", "news_media", "web_text", 0.7), ("ththly_example_pdf", "scientific_paper", "pdf", 0.9),
        ("general_web_table", "web_text", "web_table", 0.6), ("academic_pdf", "scientific_paper", "pdf", 0.9), ("unknown_web", "unknown", "web_text", 0.4),
        ("government_web_text", "government", "web_text", 0.85),
    ]
    return spark.createDataFrame(rows, "source_id string, source_type string, modality string, source_trust double")


WEB = """web AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'https://web.archive.org/web/20200101000000/' || url ELSE url END AS url, CASE page_id % 3 WHEN 0 THEN 'web_text' WHEN 1 THEN 'pdf' ELSE 'web_table' END AS modality FROM pages),
wreg AS (SELECT * FROM (VALUES ('example_web_text','news_media','web_text',0.8),('tionsh_example_web_text','news_media','web_text',0.7),('ththly_example_pdf','scientific_paper','pdf',0.9),('general_web_table','web_text','web_table',0.6),('academic_pdf','scientific_paper','pdf',0.9),('unknown_web','unknown','web_text',0.4),('government_web_text','government','web_text',0.85)) t(source_id, source_type, modality, source_trust)),
host AS (SELECT page_id, modality, regexp_replace(lower(regexp_extract(CASE WHEN regexp_matches(url, 'web\\.archive\\.org/web/[0-9]+[^/]*/.+') THEN regexp_extract(url, 'web\\.archive\\.org/web/[0-9]+[^/]*/(.+)', 1) ELSE url END, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM web),
keyed AS (SELECT page_id, modality, domain, translate(regexp_replace(domain, '\\.[^.]*$', ''), '.-', '__') || '_' || modality AS exact_key,
  CASE WHEN length(domain) - length(replace(domain, '.', '')) > 1 THEN translate(regexp_replace(regexp_replace(domain, '^[^.]*\\.', ''), '\\.[^.]*$', ''), '.-', '__') || '_' || modality END AS parent_key FROM host),
resolved AS (SELECT page_id, domain, k.modality, coalesce(a.source_id, b.source_id, CASE k.modality WHEN 'web_table' THEN 'general_web_table' WHEN 'pdf' THEN 'academic_pdf' ELSE 'unknown_web' END) AS source_id
  FROM keyed k LEFT JOIN wreg a ON a.source_id = exact_key LEFT JOIN wreg b ON b.source_id = parent_key)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as evidence items of a claim."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id"), F.col("turn").alias("ord"), "role", "text")


TURN = "tn AS (SELECT conv_id AS claim_id, turn AS ord, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)"
