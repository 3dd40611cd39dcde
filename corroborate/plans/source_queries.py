"""Queries over sources of records, scenes, registries and small text rules, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corroborate.functions import domains as D
from corroborate.functions import realize as Z
from corroborate.functions import uris as U
from corroborate.operators import evidence as E
from corroborate.operators import resolve
from corroborate.operators import splits as S
from corroborate.operators import triples as T
from corroborate.operators.lineage import new_folder
from corroborate.plans import bindings as B
from corroborate.sources import records as R

KG = "http://example.org/kg"
ONTOLOGY = (("isDirty", f"{KG}/relations/isDirty"), ("flag", f"{KG}/attributes/flag"), ("partOf", f"{KG}/relations/partOf"))


def json_arrays(spark, d):
    """S3: suppliers as files that hold a JSON list of some 1,000 each, read back."""
    at = new_folder(spark, "arrays")
    s = B.table(spark, d, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    n = math.ceil(s.count() / 1000) or 1
    lists = s.groupBy((F.col("s_suppkey") % n).alias("list")).agg(F.to_json(F.collect_list(F.struct(*s.columns))).alias("value"))
    lists.write.partitionBy("list").text(at)
    return R.read_json_array(spark, f"{at}/*", "s_suppkey long, s_name string, s_acctbal double")


def line_index(spark, d):
    """Turns as lines of a text, blank ones among them, numbered without these."""
    at = new_folder(spark, "lines")
    t = B.turns(spark, d).select(F.concat_ws(" ", F.col("claim_id").cast("string"), F.col("ord").cast("string"), F.col("role")).alias("value"), "claim_id", "ord")
    blank = t.where("ord % 3 = 0").withColumn("value", F.lit("  "))
    t.unionByName(blank).orderBy("claim_id", "ord", "value").select("value").coalesce(1).write.text(at)  # one file, as it is read
    return R.with_line_index(spark, at).select(F.col("line_idx").cast("long").alias("line_idx"), "value")


def scene_policy(spark, d):
    """Parts as objects: an attribute stays if its flag is true, others if they are on the list."""
    p = B.table(spark, d, "part")
    properties = F.create_map(
        F.lit("isDirty"), F.when(F.col("p_size") % 3 == 0, F.lit("true")), F.lit("dirtyable"), F.when(F.col("p_size") % 2 == 0, "True").otherwise("false"),
        F.lit("mass"), F.col("p_size").cast("string"), F.lit("secret"), F.lit("x"),
    )
    raw = p.select("p_partkey", properties.alias("properties"), F.struct(F.col("p_size").cast("float").alias("x"), F.lit(None).cast("float").alias("y"), F.lit(1).alias("z")).alias("position"))
    out = R.scene_objects(raw, {"isDirty": "dirtyable"}, ("mass", "dirtyable"))
    keys = F.array_join(F.array_sort(F.map_keys("properties")), ",")
    return out.select("p_partkey", keys.alias("kept"), F.col("properties")["mass"].alias("mass"), F.col("position.x").alias("x"), F.col("position.y").alias("y"))


def scene_graph(spark, d):
    """Triples of orders as scenes of their lines; predicates that the ontology doesn't have are dropped."""
    li = B.table(spark, d, "lineitem")
    objects = li.select(
        F.concat(F.lit("order "), "l_orderkey").alias("scene_id"), F.concat_ws("|", F.lit("Line"), "l_orderkey", "l_linenumber").alias("object_id"), F.lit("Line").alias("object_type"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("tax"), F.lit("1"), F.lit("isDirty"), F.when(F.col("l_linestatus") == "F", F.lit("true"))).alias("properties"),
        F.array(F.struct(F.lit("partOf").alias("predicate"), F.concat(F.lit("Part|"), "l_partkey").alias("object")), F.struct(F.lit("unknown").alias("predicate"), F.lit("x").alias("object"))).alias("relations"),
    )
    return T.scene_triples(objects, spark.createDataFrame(list(ONTOLOGY), "name string, uri string"), KG)


def _curated(spark, d):
    """The hosts of web pages as a curated list, with a type by their length."""
    hosts = B.web_items(spark, d).select(D.url_host(D.unwrapped_url(F.col("url"))).alias("domain"), "modality").where("domain is not null").distinct()
    kind = F.when(F.length("domain") % 2 == 0, "government").otherwise("news_media")
    return hosts.select("domain", "modality", kind.alias("source_type"), F.lit(0.7).alias("source_trust"))


def missing_domains(spark, d):
    """Hosts that no registered source resolves."""
    return resolve.missing_domains(_curated(spark, d), B.web_registry(spark)).select("domain", "modality")


def enriched_registry(spark, d):
    """The registry with these hosts; governments get an entry for pdf as well."""
    return resolve.enriched_registry(B.web_registry(spark), _curated(spark, d)).select("source_id", "source_type", "modality")


def _stepped(spark, d):
    """Page hosts with endings that lead to each step of the resolution."""
    host = D.url_host(D.unwrapped_url(F.col("url")))
    k = F.col("page_id") % 8
    social = F.element_at(F.array(*map(F.lit, D.SOCIAL_DOMAINS)), (F.col("page_id") % len(D.SOCIAL_DOMAINS) + 1).cast("int"))
    domain = (
        F.when(k == 1, F.concat(host, F.lit(".gov"))).when(k == 2, F.concat(host, F.lit(".edu"))).when(k == 3, social).when(k == 4, F.concat(F.lit("m."), social))
        .when(k == 5, F.lit(D.ARCHIVE_HOST)).when(k == 6, F.lit(None).cast("string")).otherwise(host)
    )
    return B.web_items(spark, d).select("page_id", domain.alias("domain"), "modality")


def resolve_steps(spark, d):
    """Every step: exact, parent, archive, public-sector and academic endings, social media, defaults, none."""
    return resolve.resolve_sources(_stepped(spark, d), B.web_registry(spark)).select("page_id", "source_id")


def text_rules(spark, d):
    """names and texts through the small rules."""
    p = B.table(spark, d, "part")
    listed = F.concat("p_brand", F.lit(", "), "p_type", F.when(F.col("p_size") % 2 == 0, F.lit(" ,, last")).otherwise(F.lit("")))
    url = F.concat(F.lit("http://e.org/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, F.lit(".PDF")).otherwise(F.lit(".html")))
    return p.select(
        "p_partkey", U.mint(KG, "entities", F.concat(F.lit("Part|"), "p_name")).alias("uri"), Z.list_text(listed).alias("listed"), Z.with_article(F.col("p_name")).alias("noun"),
        Z.title(F.concat(F.lit("part_"), F.lower(F.col("p_type")))).alias("title"), Z.decapitalised(F.col("p_type")).alias("after"), D.url_modality(url).alias("modality"),
    )


def split_names(spark, d):
    """Files by the split in their name, and ids in order."""
    c = B.claims(spark, d)
    name = F.concat("source", F.lit("_"), F.element_at(F.array(*map(F.lit, ("TRAIN", "dev", "valid", "Test", "other"))), (F.col("doc_id") % 5 + 1).cast("int")), F.lit(".json"))
    return c.select("doc_id", S.split_of_file(name).alias("split"), S.sequential_id("web", "train", F.col("doc_id")).alias("id"))


def claims_with_text(spark, d):
    """Documents whose text isn't blank."""
    return E.claims_with_text(B.claims(spark, d).withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.lit(" ")).otherwise(F.col("text"))), "text").groupBy("lang").agg(F.count("*").alias("n"))


def seed_pool(spark, d):
    """Parts as seeds with a supporting and, for some, a refuting text: a row a text."""
    refuting = F.when(F.col("p_size") % 4 != 0, F.concat(F.lit("It is no "), "p_type"))
    pool = B.table(spark, d, "part").select(F.col("p_name").alias("claim"), F.col("p_brand").alias("evidence_type"), F.lit("d").alias("domain"), F.concat(F.lit("It is a "), "p_type").alias("supporting_evidence"), refuting.alias("refuting_evidence"))
    return R.seed_pool(pool).groupBy("evidence_type", "stance").agg(F.count("*").alias("n"), F.min("text").alias("first"))


def probe_items(spark, d):
    """Orders as probes with their lines as evidence."""
    li = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("stance"))).alias("evidence"))
    raw = li.select(F.col("l_orderkey").cast("string").alias("id"), F.lit("c").alias("claim"), F.when(F.col("l_orderkey") % 2 == 0, "supported").otherwise("refuted").alias("expected_verdict"), "evidence")
    return R.probes(raw).select("claim_id", "expected_verdict", F.col("n").cast("long").alias("n"), "stance")


def _in(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _ending(suffixes: tuple[str, ...]) -> str:
    return "regexp_matches(domain, '(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$')"


_SOCIAL = f"([{_in(D.SOCIAL_DOMAINS)}])[page_id % {len(D.SOCIAL_DOMAINS)} + 1]"
_PARENT = "CASE WHEN length(domain) - length(replace(domain, '.', '')) > 1 THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE domain END"
_KEY = "translate(regexp_replace({x}, '\\.[^.]*$', ''), '.-', '__') || '_' || modality"
_STEPS = f"""{B.WEB}, sp AS (SELECT page_id, modality, CASE page_id % 8 WHEN 1 THEN domain || '.gov' WHEN 2 THEN domain || '.edu' WHEN 3 THEN {_SOCIAL} WHEN 4 THEN 'm.' || {_SOCIAL} WHEN 5 THEN '{D.ARCHIVE_HOST}' WHEN 6 THEN NULL ELSE domain END AS domain FROM host),
pa AS (SELECT *, {_PARENT} AS parent FROM sp), st AS (SELECT pa.*, a.source_id AS ex, CASE WHEN parent <> domain THEN b.source_id END AS pr,
  CASE WHEN {_ending(D.GOVERNMENT_SUFFIXES)} THEN CASE pa.modality WHEN 'pdf' THEN 'government_pdf' ELSE 'government_web_text' END WHEN {_ending(D.EDUCATION_SUFFIXES)} THEN CASE pa.modality WHEN 'pdf' THEN 'academic_pdf' ELSE 'general_web_text' END END AS sx
  FROM pa LEFT JOIN wreg a ON a.source_id = {_KEY.format(x="domain").replace('modality', 'pa.modality')} LEFT JOIN wreg b ON b.source_id = {_KEY.format(x="parent").replace('modality', 'pa.modality')})"""
_MISSING = f"{B.WEB}, mi AS (SELECT DISTINCT domain, modality, CASE WHEN length(domain) % 2 = 0 THEN 'government' ELSE 'news_media' END AS source_type FROM resolved WHERE coalesce(domain, '') <> '' AND source_id IN ('unknown_web', 'general_web_table', 'academic_pdf'))"
_ENC = "replace(replace({x}, ' ', '%20'), '|', '%7C')"

QUERIES = {
    "json_arrays": (json_arrays, "SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier"),
    "line_index": (line_index, "SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_idx, CAST(conv_id AS VARCHAR) || ' ' || CAST(turn AS VARCHAR) || ' ' || role AS value FROM conversations"),
    "scene_policy": (scene_policy, "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'dirtyable,isDirty,mass' ELSE 'dirtyable,mass' END AS kept, CAST(p_size AS VARCHAR) AS mass, CAST(p_size AS DOUBLE) AS x, 0.0::DOUBLE AS y FROM part"),
    "scene_graph": (
        scene_graph,
        f"""WITH o AS (SELECT *, '{KG}/entities/Line%7C' || CAST(l_orderkey AS VARCHAR) || '%7C' || CAST(l_linenumber AS VARCHAR) AS e FROM lineitem)
SELECT '{KG}/contexts/order%20' || CAST(l_orderkey AS VARCHAR) AS s, '{KG}/relations/hasObject' AS p, e AS o FROM o UNION SELECT e, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{KG}/types/Line' FROM o
UNION SELECT e, '{KG}/attributes/flag', l_returnflag FROM o UNION SELECT e, '{KG}/relations/isDirty', 'true' FROM o WHERE l_linestatus = 'F' UNION SELECT e, '{KG}/relations/partOf', '{KG}/entities/Part%7C' || CAST(l_partkey AS VARCHAR) FROM o""",
    ),
    "missing_domains": (missing_domains, f"WITH {_MISSING} SELECT domain, modality FROM mi"),
    "enriched_registry": (
        enriched_registry,
        f"WITH {_MISSING}, al AS (SELECT * FROM mi UNION ALL SELECT domain, 'pdf', source_type FROM mi WHERE source_type = 'government' AND modality <> 'pdf'), ky AS (SELECT DISTINCT {_KEY.format(x='domain')} AS source_id, source_type, modality FROM al) SELECT source_id, source_type, modality FROM wreg UNION ALL SELECT * FROM ky WHERE source_id NOT IN (SELECT source_id FROM wreg)",
    ),
    "resolve_steps": (
        resolve_steps,
        f"WITH {_STEPS} SELECT page_id, CASE WHEN coalesce(domain, '') = '' THEN 'unknown_web' WHEN ex IS NOT NULL THEN ex WHEN pr IS NOT NULL THEN pr WHEN domain = '{D.ARCHIVE_HOST}' THEN 'webarchive_web_text' WHEN sx IN (SELECT source_id FROM wreg) THEN sx WHEN domain IN ({_in(D.SOCIAL_DOMAINS)}) OR parent IN ({_in(D.SOCIAL_DOMAINS)}) THEN 'social_media_web_text' WHEN modality = 'web_table' THEN 'general_web_table' WHEN modality = 'pdf' THEN 'academic_pdf' ELSE 'unknown_web' END AS source_id FROM st",
    ),
    "text_rules": (
        text_rules,
        f"SELECT p_partkey, '{KG}/entities/' || {_ENC.format(x="'Part|' || p_name")} AS uri, CASE WHEN p_size % 2 = 0 THEN p_brand || ', ' || p_type || ' and last' ELSE p_brand || ' and ' || p_type END AS listed, CASE WHEN regexp_matches(p_name, '(?i)^[aeiou]') THEN 'an ' ELSE 'a ' END || p_name AS noun, "
        "list_aggregate([upper(substr(w, 1, 1)) || lower(substr(w, 2)) FOR w IN string_split('part ' || lower(p_type), ' ')], 'string_agg', ' ') AS title, lower(substr(p_type, 1, 1)) || substr(p_type, 2) AS after, CASE WHEN p_size % 3 = 0 THEN 'pdf' ELSE 'web_text' END AS modality FROM part",
    ),
    "split_names": (split_names, "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' WHEN 2 THEN 'dev' WHEN 3 THEN 'test' END AS split, 'web-train-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS id FROM documents"),
    "claims_with_text": (claims_with_text, "SELECT lang, count(*) AS n FROM documents WHERE doc_id % 11 <> 0 AND trim(coalesce(text, ''), ' ') <> '' GROUP BY 1"),
    "seed_pool": (seed_pool, "SELECT p_brand AS evidence_type, 'supports' AS stance, count(*) AS n, min('It is a ' || p_type) AS first FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'refutes', count(*), min('It is no ' || p_type) FROM part WHERE p_size % 4 <> 0 GROUP BY 1"),
    "probe_items": (probe_items, "SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, CASE WHEN l_orderkey % 2 = 0 THEN 'supported' ELSE 'refuted' END AS expected_verdict, CAST(l_linenumber AS BIGINT) AS n, l_returnflag AS stance FROM lineitem"),
}
