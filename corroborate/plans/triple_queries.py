"""Queries over triples, sentences and generated claims, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import realize as Z
from corroborate.functions import uris as U
from corroborate.operators import generate as G
from corroborate.operators import graph as N
from corroborate.operators import profile as P
from corroborate.operators import triples as T
from corroborate.plans import bindings as B

REL, ENT = f"{B.BASE}/relations", f"{B.BASE}/entities"


def triples_match(spark, d):
    return T.match(B.triples(spark, d), p=f"{REL}/inNation", o=f"{ENT}/nation_7").select("s", "p", "o")


def triples_objects(spark, d):
    return T.objects_of(B.triples(spark, d), f"{ENT}/customer_4", [f"{REL}/inNation", f"{REL}/segment"])


def triples_subjects(spark, d):
    return T.subjects_of(B.triples(spark, d), f"{ENT}/nation_3", [f"{REL}/inNation", f"{REL}/hasObject"])


def triples_nodes(spark, d):
    return T.nodes_of(B.triples(spark, d), [f"{REL}/inNation", f"{REL}/inRegion"])


def triples_exists(spark, d):
    found = T.exists(B.triples(spark, d), p=f"{REL}/inRegion", o=f"{ENT}/region_2")
    return spark.range(1).select(F.lit(found).alias("found"))


def triples_boolean_pred(spark, d):
    t = T.boolean_predicates(B.triples(spark, d).where(F.col("p").isin(f"{REL}/isUrgent", f"{REL}/segment", f"{REL}/mass")))
    return t.groupBy("p", "is_boolean").agg(F.count("*").alias("n"))


def triples_by_predicate(spark, d):
    return T.group_sizes(B.triples(spark, d).withColumn("key", F.col("p")))


def triples_by_subject(spark, d):
    t = T.group_by(B.triples(spark, d), "subject")
    return t.select("key", F.size("triples").cast("long").alias("n"), F.array_join(F.transform("triples", lambda x: x["o"]), ",").alias("objects"))


def triples_by_context(spark, d):
    return T.group_sizes(T.by_context(B.triples(spark, d), "contexts"))


def triples_by_pattern(spark, d):
    return T.group_sizes(T.by_pattern(B.triples(spark, d), "/nation_1", [f"{REL}/inNation"], match_on="object"))


def triples_by_entity(spark, d):
    return T.group_sizes(T.by_entity(B.triples(spark, d), "nation_[0-9]+", "hasObject", "inNation"))


def triples_dedupe(spark, d):
    li = B.table(spark, d, "lineitem")
    t = li.select(F.col("l_suppkey").cast("string").alias("s"), F.lit("supplied").alias("p"), (F.col("l_partkey") % 50).cast("string").alias("o"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return T.dedupe(t.groupBy("s", "p", "o", "ord").agg(F.count("*").alias("c")).drop("c"), "ord")


def build_stats(spark, d):
    return G.build_stats(B.triples(spark, d))


def uri_local_name(spark, d):
    return B.triples(spark, d).select("ord", U.short_uri(F.col("s")).alias("s"), U.relation_name(F.col("p")).alias("p"), U.short_uri(F.col("o")).alias("o"))


def entity_types(spark, d):
    return B.triples(spark, d).groupBy(U.entity_type(F.col("s")).alias("type")).agg(F.count("*").alias("n"), F.count_if(U.is_iri(F.col("o"))).alias("n_iri"))


def degenerate_triples(spark, d):
    t = B.triples(spark, d)
    return t.groupBy(U.is_degenerate(F.col("p"), F.col("o")).alias("degenerate"), U.is_temperature(F.col("o")).alias("temperature")).agg(F.count("*").alias("n"))


def flipped_booleans(spark, d):
    t = B.triples(spark, d).where(F.col("p") == f"{REL}/isUrgent")
    return t.select("ord", U.flip_boolean(F.col("o")).alias("o"))


RULES = [("order", "customer"), ("customer", "nation"), ("supplier", "region")]


def _rules(spark):
    return spark.createDataFrame(RULES, "object_type string, receptacle string")


def corrupt_candidates(spark, d):
    return G.corruption_candidates(B.triples(spark, d), _rules(spark)).groupBy("how", U.relation_name(F.col("p")).alias("rel")).agg(F.count("*").alias("n"))


def generated_claims(spark, d):
    return G.one_hop_claims(B.triples(spark, d), _rules(spark), 200)


def conjunction_claims(spark, d):
    return G.conjunction_claims(B.triples(spark, d), _rules(spark))


def _made(spark, d):
    return G.attempts(B.triples(spark, d), _rules(spark))


def generation_counts(spark, d):
    return G.generation_counts(_made(spark, d))


def generation_rates(spark, d):
    return G.generation_rates(_made(spark, d), B.triples(spark, d).count())


def context_claims(spark, d):
    keyed = T.by_context(B.triples(spark, d), "contexts")
    return G.context_claims(G.first_contexts(keyed.withColumnRenamed("key", "context"), 3).withColumnRenamed("context", "key"), _rules(spark), 20)


def structured_claims(spark, d):
    claims = G.negation_claims(B.triples(spark, d)).select("s", "label", F.lit("negation").alias("structural"))
    claims = claims.unionByName(G.conjunction_claims(B.triples(spark, d), _rules(spark)).select("s", "label", F.lit("conjunction").alias("structural")))
    asked = G.with_structure(claims, "negation", ("refuted",)).unionByName(G.with_structure(claims, "conjunction", ("supported", "refuted")))
    return asked.groupBy("structural", "label").agg(F.count("*").alias("n"))


def negation_claims(spark, d):
    t = B.triples(spark, d).where(F.col("p") == f"{REL}/isUrgent")
    return G.negation_claims(t).select("s", "claimed_o", "label")


def _present(spark, d):
    """What each order (a context) holds: names of parts, and true or none where a flag leaked in."""
    li = B.table(spark, d, "lineitem").join(B.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(F.col("l_orderkey").cast("string").alias("context"), F.col("p_name").alias("object_type")).distinct()


def _types(spark, d):
    leaked = spark.createDataFrame([("True",), (" none ",)], "object_type string")
    return B.table(spark, d, "part").select(F.col("p_name").alias("object_type")).union(leaked)


def absent_types(spark, d):
    return G.absent_types(_types(spark, d), _present(spark, d))


def absent_counts(spark, d):
    return G.absent_counts(_types(spark, d), _present(spark, d))


def absent_pairs(spark, d):
    """Of the parts that come next to an order's own by number: those that it doesn't hold under any number."""
    parts = B.table(spark, d, "part").select((F.col("p_partkey") - 1).alias("l_partkey"), F.col("p_name").alias("object_type"))
    asked = B.table(spark, d, "lineitem").join(parts, "l_partkey").select(F.col("l_orderkey").cast("string").alias("context"), "object_type")
    return G.absent_among(asked, _types(spark, d), _present(spark, d))


def absence_claims(spark, d):
    return G.absence_claims(_types(spark, d), _present(spark, d), 3)


def semantic_map(spark, d):
    c = B.table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("object_id"), F.col("c_mktsegment").alias("object_type"), F.col("c_nationkey").cast("long").alias("parent_id"))
    n = B.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("object_id"), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias("object_type"), F.lit(None).cast("long").alias("parent_id"))
    return G.semantic_map(c.unionByName(n)).select("object_type", F.array_join("parent_types", ",").alias("parents"))


def _lexed(spark, d):
    """Triples whose predicate the lexicon knows, with its form and label, and the subject's label."""
    predicates = spark.createDataFrame([("temperature", "temperature", "prop_value"), ("mass", "weighs", "prop_verb"), ("isUrgent", "urgent", "adj")], "predicate string, label string, form string")
    entities = spark.createDataFrame([("Part|1", "first part"), ("order_1", "first order")], "entity string, label string")
    # the full URIs first: tables without these predicates aren't read
    known = B.triples(spark, d).where(F.col("p").isin(*(f"{REL}/{p}" for p in ("temperature", "mass", "isUrgent"))))
    t = T.with_labels(known, predicates, entities)
    return t.select("ord", F.translate("s_label", "|_", "  ").alias("s"), F.col("p_label").alias("p"), "o", "form")


LEX = f"""{B.TR}, lx AS (SELECT ord, CASE {B.LOCAL.format(x='s')} WHEN 'Part|1' THEN 'first part' WHEN 'order_1' THEN 'first order' ELSE lower(translate({B.LOCAL.format(x='s')}, '|_', '  ')) END AS s, regexp_extract(p, '([^/]*)$', 1) AS rel, o FROM tr
  WHERE p IN ('{REL}/temperature', '{REL}/mass', '{REL}/isUrgent')), st AS (SELECT ord, s, rel, CASE rel
  WHEN 'temperature' THEN 'The ' || s || ' is ' || CASE o WHEN 'Hot' THEN 'hot' WHEN 'Cold' THEN 'cold' ELSE 'at room temperature' END || '.'
  WHEN 'mass' THEN 'The ' || s || ' weighs ' || o || ' kg.' ELSE 'The ' || s || CASE WHEN o = 'false' THEN ' is not urgent.' ELSE ' is urgent.' END END AS sentence FROM lx)"""


def realize_triples(spark, d):
    return _lexed(spark, d).select("ord", Z.triple_text(F.col("s"), F.col("p"), F.col("o"), F.col("form")).alias("sentence"))


def realize_conjunction(spark, d):
    t = _lexed(spark, d).withColumn("sentence", Z.triple_text(F.col("s"), F.col("p"), F.col("o"), F.col("form"))).where("form <> 'adj'")
    heat, mass = t.where("form = 'prop_value'"), t.where("form = 'prop_verb'")
    part = lambda c: F.regexp_extract(c, r"(\d+)$", 1).try_cast("long")
    # a part's weight and its heat, and a part's weight and the heat of the next one
    pairs = mass.select(F.col("s").alias("a"), F.col("sentence").alias("one"), F.explode(F.array(part(F.col("s")), part(F.col("s")) + 1)).alias("n"))
    both = pairs.join(heat.select(F.col("s").alias("b"), F.col("sentence").alias("two"), part(F.col("s")).alias("n")), "n")
    return both.select("a", "b", Z.joined_text(F.col("one"), F.col("two"), F.col("a") == F.col("b"), F.col("a")).alias("sentence"))


def realize_absence(spark, d):
    return absent_types(spark, d).select("context", Z.absence_text(Z.type_label(F.col("object_type"))).alias("sentence"))


def realize_drawn_absence(spark, d):
    return G.absence_draws(_types(spark, d), _present(spark, d), 3).select("context", Z.absence_text(Z.type_label(F.col("object_type"))).alias("sentence"))


def sentence_normalise(spark, d):
    return B.table(spark, d, "benchmark").select("item_id", Z.sentence(F.col("text")).alias("sentence"), Z.shortened(F.col("text"), 80).alias("short"), Z.text_hash(F.col("text")).alias("hash"))


def _turn_parts(spark, d):
    items = N.indexed_evidence(B.turns(spark, d))
    claim = items.where("ord = 0").select("claim_id", F.lit(0).cast("long").alias("ord"), F.lower("text").alias("text"))
    texts = F.array(F.lower("role"), F.lower("text"))  # two triples per item: who speaks, and what
    ev = items.select("claim_id", "i", F.posexplode(texts).alias("ord", "text")).withColumn("ord", F.col("ord").cast("long"))
    return items, claim, ev


def coevidence_edges(spark, d):
    return N.co_evidence(N.indexed_evidence(B.turns(spark, d)))


def triple_index(spark, d):
    _, claim, ev = _turn_parts(spark, d)
    return N.triple_index(claim, ev)


def graph_edges(spark, d):
    return N.edges(*_turn_parts(spark, d))


def graph_size(spark, d):
    return N.graph_sizes(N.edges(*_turn_parts(spark, d)))


def attention(spark, d):
    items = N.indexed_evidence(B.turns(spark, d)).select("claim_id", F.col("i").cast("long").alias("i"), (F.length("text") / 100).alias("a"), (F.col("i") / 4).alias("b"), F.sqrt(F.length("text")).alias("v"))
    return N.attend(items, N.co_evidence(N.indexed_evidence(B.turns(spark, d))), "a", "b", "v").select("claim_id", "dst", F.round("message", 4).alias("message"))


def features(spark, d):
    """Sizes and mass of the evidence features (rows only: hashes differ between engines)."""
    items = B.turns(spark, d)
    f = N.evidence_features(N.hashed_embedding(F.col("text"), 64), F.lit("web_text"), F.array(F.lit("testimony")), F.lit("news_media"))
    return items.select("claim_id", "ord", F.size(f).alias("size"), F.round(F.aggregate(f, F.lit(0.0), lambda a, x: a + x * x), 3).alias("mass"))


def pair_shares(spark, d):
    sizes = T.group_sizes(B.triples(spark, d).withColumn("key", U.relation_name(F.col("p"))))
    return P.with_share(sizes.withColumn("all", F.lit("all")).select("all", "key", "n"), ["all"])


_CTX = f"""{B.TR}, mp AS (SELECT node, arg_max(value, ord) AS value FROM (
  SELECT o AS node, regexp_extract(s, 'contexts[/#]([^/#]+)', 1) AS value, ord FROM tr WHERE p = '{REL}/hasObject' UNION ALL
  SELECT s, regexp_extract(o, 'contexts[/#]([^/#]+)', 1), ord FROM tr WHERE p = '{REL}/inScene') WHERE value <> '' GROUP BY 1),
ky AS (SELECT tr.*, coalesce(nullif(regexp_extract(tr.s, 'contexts[/#]([^/#]+)', 1), ''), nullif(regexp_extract(tr.o, 'contexts[/#]([^/#]+)', 1), ''), a.value, b.value) AS key FROM tr LEFT JOIN mp a ON a.node = tr.s LEFT JOIN mp b ON b.node = tr.o)"""
_ENT = f"""{B.TR}, mp AS (SELECT node, arg_max(value, ord) AS value FROM (
  SELECT o AS node, regexp_extract(s, 'nation_[0-9]+', 0) AS value, ord FROM tr WHERE p = '{REL}/hasObject' UNION ALL
  SELECT s, regexp_extract(o, 'nation_[0-9]+', 0), ord FROM tr WHERE p = '{REL}/inNation') WHERE value <> '' GROUP BY 1),
ky AS (SELECT tr.*, coalesce(nullif(regexp_extract(tr.s, 'nation_[0-9]+', 0), ''), nullif(regexp_extract(tr.o, 'nation_[0-9]+', 0), ''), a.value, b.value, 'UNKNOWN') AS key FROM tr LEFT JOIN mp a ON a.node = tr.s LEFT JOIN mp b ON b.node = tr.o)"""
_SIZES = "SELECT key, count(*) AS n, count(DISTINCT s) AS n_subjects, count(DISTINCT o) AS n_objects FROM {t} GROUP BY 1"
_TYPE = "regexp_extract(" + B.LOCAL.format(x="{x}") + ", '^([^|_]*)', 1)"
_BAD = f"""rules AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in RULES)}) t(object_type, receptacle)),
places AS (SELECT receptacle, arg_min(o, md5('42-' || o)) AS bad_o FROM (SELECT DISTINCT o, {_TYPE.format(x="o")} AS receptacle FROM rw) GROUP BY 1),
wrong AS (SELECT s, p, o, 0 AS rank, 'boolean_flip' AS how, CASE WHEN lower(trim(o)) IN ('true','1','yes','y','t') THEN 'False' ELSE 'True' END AS bad_o FROM rw WHERE lower(trim(o)) IN ('true','1','yes','y','t','false','0','no','n','f')
  UNION ALL SELECT s, p, o, 1, 'temperature_change', CASE o WHEN 'Hot' THEN 'Cold' WHEN 'Cold' THEN 'RoomTemp' ELSE 'Hot' END FROM rw WHERE o IN ('Hot', 'Cold', 'RoomTemp')
  UNION ALL SELECT s, p, o, 2, 'receptacle_substitution', bad_o FROM rw JOIN rules ON lower({_TYPE.format(x="s")}) = rules.object_type JOIN places USING (receptacle) WHERE bad_o <> o),
bad AS (SELECT s, p, o, arg_min(bad_o, (rank, bad_o)) AS bad_o, arg_min(how, (rank, bad_o)) AS how FROM wrong w WHERE NOT EXISTS (SELECT 1 FROM rw x WHERE x.s = w.s AND x.p = w.p AND x.o = w.bad_o) GROUP BY 1, 2, 3)"""
_MADE = f"{B.TR}, rw AS (SELECT DISTINCT s, p, o FROM tr WHERE NOT (p = '{REL}/mass' AND o IN ('0', '0.0', '0.00'))), {_BAD}"
_PRESENT = """present AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS context, p_name AS object_type FROM lineitem JOIN part ON l_partkey = p_partkey)"""
_ABSENT = f"{_PRESENT}, absent AS (SELECT c.context, u.object_type FROM (SELECT DISTINCT context FROM present) c, (SELECT DISTINCT p_name AS object_type FROM part) u WHERE NOT EXISTS (SELECT 1 FROM present x WHERE x.context = c.context AND x.object_type = u.object_type))"
_DRAWN = f"""{_PRESENT}, ring AS (SELECT object_type, row_number() OVER (ORDER BY md5('42-' || object_type), object_type) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT p_name AS object_type FROM part)),
steps AS (SELECT context, object_type, (place - CAST('0x' || substr(md5('42-ring-' || context), 1, 8) AS BIGINT) % n + n) % n AS step FROM (SELECT DISTINCT context FROM present), ring),
drawn AS (SELECT context, object_type FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY step) AS k FROM steps ANTI JOIN present USING (context, object_type)) WHERE k <= 3)"""
_CO = f"{B.TURN}, co AS (SELECT a.claim_id, a.i AS src, b.i AS dst, row_number() OVER (PARTITION BY a.claim_id, a.i ORDER BY abs(b.i - a.i), b.i) AS k FROM tn a JOIN tn b ON a.claim_id = b.claim_id AND a.i <> b.i)"
_IX = f"{_CO}, ct AS (SELECT claim_id, lower(text) AS text FROM tn WHERE ord = 0), et AS (SELECT claim_id, i, 0 AS o, lower(role) AS text FROM tn UNION ALL SELECT claim_id, i, 1, lower(text) FROM tn), ix AS (SELECT claim_id, text, dense_rank() OVER (PARTITION BY claim_id ORDER BY pos) - 1 AS t FROM (SELECT claim_id, text, min(pos) AS pos FROM (SELECT claim_id, text, -1 AS pos FROM ct UNION ALL SELECT claim_id, text, 2 * i + o FROM et) GROUP BY 1, 2))"
_ED = f"{_IX}, ed AS (SELECT claim_id, 'has_evidence' AS kind, 0 AS src, i AS dst FROM tn UNION ALL SELECT claim_id, 'connected_to', i, 0 FROM tn UNION ALL SELECT claim_id, 'co_evidence', src, dst FROM co WHERE k <= 5 UNION ALL SELECT claim_id, 'has_triple', 0, t FROM ct JOIN ix USING (claim_id, text) UNION ALL SELECT claim_id, 'from_triple', i, t FROM et JOIN ix USING (claim_id, text))"

QUERIES = {
    "triples_match": (triples_match, f"WITH {B.TR} SELECT s, p, o FROM tr WHERE p = '{REL}/inNation' AND o = '{ENT}/nation_7'"),
    "triples_objects": (triples_objects, f"WITH {B.TR} SELECT o FROM tr WHERE s = '{ENT}/customer_4' AND p IN ('{REL}/inNation', '{REL}/segment')"),
    "triples_subjects": (triples_subjects, f"WITH {B.TR} SELECT s FROM tr WHERE o = '{ENT}/nation_3' AND p IN ('{REL}/inNation', '{REL}/hasObject')"),
    "triples_nodes": (triples_nodes, f"WITH {B.TR} SELECT s AS node FROM tr WHERE p IN ('{REL}/inNation', '{REL}/inRegion') UNION SELECT o FROM tr WHERE p IN ('{REL}/inNation', '{REL}/inRegion')"),
    "triples_exists": (triples_exists, f"WITH {B.TR} SELECT count(*) > 0 AS found FROM tr WHERE p = '{REL}/inRegion' AND o = '{ENT}/region_2'"),
    "triples_boolean_pred": (triples_boolean_pred, f"WITH {B.TR}, x AS (SELECT s, p, bool_or(lower(trim(o)) IN ('true','1','yes','y','t','false','0','no','n','f')) AS is_boolean FROM tr WHERE p IN ('{REL}/isUrgent', '{REL}/segment', '{REL}/mass') GROUP BY 1, 2) SELECT p, is_boolean, count(*) AS n FROM x GROUP BY 1, 2"),
    "triples_by_predicate": (triples_by_predicate, f"WITH {B.TR} " + _SIZES.format(t="(SELECT *, p AS key FROM tr)")),
    "triples_by_subject": (triples_by_subject, f"WITH {B.TR} SELECT s AS key, count(*) AS n, string_agg(o, ',' ORDER BY p, o) AS objects FROM tr GROUP BY 1"),
    "triples_by_context": (triples_by_context, f"WITH {_CTX} " + _SIZES.format(t="(SELECT * FROM ky WHERE key IS NOT NULL)")),
    "triples_by_pattern": (triples_by_pattern, f"WITH {B.TR} " + _SIZES.format(t=f"(SELECT *, o AS key FROM tr WHERE p = '{REL}/inNation' AND contains(o, '/nation_1'))")),
    "triples_by_entity": (triples_by_entity, f"WITH {_ENT} " + _SIZES.format(t="ky")),
    "triples_dedupe": (triples_dedupe, "SELECT CAST(l_suppkey AS VARCHAR) AS s, 'supplied' AS p, CAST(l_partkey % 50 AS VARCHAR) AS o, min(l_orderkey * 10 + l_linenumber) AS ord FROM lineitem GROUP BY 1, 2, 3"),
    "build_stats": (build_stats, f"WITH {B.TR} SELECT count(*) AS n, count(DISTINCT s) AS n_subjects, count(DISTINCT p) AS n_predicates, count(DISTINCT o) FILTER (p = '{REL}/hasObject') AS n_objects, count(DISTINCT s) FILTER (p = '{REL}/hasObject') AS n_contexts FROM tr"),
    "uri_local_name": (uri_local_name, f"WITH {B.TR} SELECT ord, {B.LOCAL.format(x='s')} AS s, regexp_extract(p, '([^/]*)$', 1) AS p, {B.LOCAL.format(x='o')} AS o FROM tr"),
    "entity_types": (entity_types, f"WITH {B.TR} SELECT regexp_extract({B.LOCAL.format(x='s')}, '^([^|_]*)', 1) AS type, count(*) AS n, count(*) FILTER (o LIKE 'http://%') AS n_iri FROM tr GROUP BY 1"),
    "degenerate_triples": (degenerate_triples, f"WITH {B.TR} SELECT (p = '{REL}/mass' AND o IN ('0', '0.0', '0.00')) AS degenerate, o IN ('Hot', 'Cold', 'RoomTemp') AS temperature, count(*) AS n FROM tr GROUP BY 1, 2"),
    "flipped_booleans": (flipped_booleans, f"WITH {B.TR} SELECT ord, CASE WHEN o = 'true' THEN 'False' ELSE 'True' END AS o FROM tr WHERE p = '{REL}/isUrgent'"),
    "corrupt_candidates": (corrupt_candidates, f"WITH {B.TR}, rw AS (SELECT DISTINCT s, p, o FROM tr), {_BAD} SELECT how, regexp_extract(p, '([^/]*)$', 1) AS rel, count(*) AS n FROM bad GROUP BY 1, 2"),
    "generated_claims": (generated_claims, f"WITH {B.TR}, rw AS (SELECT DISTINCT s, p, o FROM tr WHERE NOT (p = '{REL}/mass' AND o IN ('0', '0.0', '0.00'))), {_BAD} (SELECT s, p, o, o AS claimed_o, 'supported' AS label FROM rw ORDER BY md5('42-' || s || '|' || p || '|' || o), s, p, o LIMIT 100) UNION ALL (SELECT s, p, o, bad_o, 'refuted' FROM bad ORDER BY md5('43-' || s || '|' || p || '|' || o), s, p, o LIMIT 100)"),
    "conjunction_claims": (conjunction_claims, f"""WITH {B.TR}, rw AS (SELECT DISTINCT s, p, o FROM tr WHERE NOT (p = '{REL}/mass' AND o IN ('0', '0.0', '0.00'))), {_BAD},
lk AS (SELECT s, p, o, bad_o, lead(p) OVER w AS p2, lead(o) OVER w AS n_o, lead(bad_o) OVER w AS n_bad, (instr('0123456789abcdef', substr(md5('42-' || s || '|' || p || '|' || o), 1, 1)) - 1) % 4 AS mode FROM rw LEFT JOIN bad USING (s, p, o) WINDOW w AS (PARTITION BY s ORDER BY p, o)),
md AS (SELECT s, p, CASE WHEN mode IN (1, 3) THEN coalesce(bad_o, o) ELSE o END AS o, p2, CASE WHEN mode IN (2, 3) THEN coalesce(n_bad, n_o) ELSE n_o END AS o2, CAST(mode AS INTEGER) AS mode, o AS true_o, n_o AS true_o2 FROM lk WHERE p2 IS NOT NULL)
SELECT *, CASE WHEN mode = 0 THEN 'supported' ELSE 'refuted' END AS label FROM md WHERE mode = 0 OR o <> true_o OR o2 <> true_o2"""),
    "generation_counts": (generation_counts, f"""WITH {_MADE}, mk AS (SELECT s, 'supported' AS label, NULL AS how FROM rw UNION ALL SELECT s, 'refuted', how FROM rw LEFT JOIN bad USING (s, p, o))
SELECT 'label' AS dim, label AS key, count(*) AS n FROM mk GROUP BY 2 UNION ALL SELECT 'how', how, count(*) FROM mk WHERE how IS NOT NULL GROUP BY 2 UNION ALL SELECT 'type', {_TYPE.format(x="s")}, count(*) FROM mk GROUP BY 2"""),
    "generation_rates": (generation_rates, f"""WITH {_MADE}, c AS (SELECT (SELECT count(*) FROM rw) AS s, (SELECT count(*) FROM bad) AS r) SELECT s AS n_supported, r AS n_refuted, s - r AS n_failed, round(100.0::DOUBLE * r / s, 4) AS corruption_success, round(100.0::DOUBLE * (s + r) / (SELECT count(*) FROM tr), 4) AS claim_rate, round(s::DOUBLE / r, 4) AS supported_to_refuted FROM c"""),
    "context_claims": (context_claims, f"""WITH {_CTX}, kx AS (SELECT DISTINCT key, s, p, o FROM ky WHERE key IN (SELECT DISTINCT key FROM ky WHERE key IS NOT NULL ORDER BY 1 LIMIT 3) AND NOT (p = '{REL}/mass' AND o IN ('0', '0.0', '0.00'))), rw AS (SELECT DISTINCT s, p, o FROM kx), {_BAD},
al AS (SELECT key, s, p, o, o AS claimed_o, 'supported' AS label FROM kx UNION ALL SELECT key, s, p, o, bad_o, 'refuted' FROM kx JOIN bad USING (s, p, o)),
rk AS (SELECT *, row_number() OVER (PARTITION BY key, label ORDER BY md5('42-' || s || '|' || p || '|' || o || '|' || claimed_o), s || '|' || p || '|' || o || '|' || claimed_o) AS k FROM al) SELECT key, s, p, o, claimed_o, label FROM rk WHERE k <= 10"""),
    "structured_claims": (structured_claims, f"WITH {B.TR} SELECT 'negation' AS structural, 'refuted' AS label, count(*) AS n FROM (SELECT DISTINCT s, p, o FROM tr) WHERE lower(trim(o)) IN ('true','1','yes','y','t')"),
    "negation_claims": (negation_claims, f"WITH {B.TR} SELECT DISTINCT s, 'False' AS claimed_o, CASE WHEN o = 'true' THEN 'refuted' ELSE 'supported' END AS label FROM tr WHERE p = '{REL}/isUrgent'"),
    "absent_types": (absent_types, f"WITH {_ABSENT} SELECT * FROM absent"),
    "absent_counts": (absent_counts, f"WITH {_PRESENT}, u AS (SELECT count(DISTINCT p_name) AS n FROM part) SELECT context, count(*) AS n_present, n - count(*) AS n_absent FROM present, u GROUP BY context, n"),
    "absent_pairs": (absent_pairs, f"WITH {_PRESENT}, asked AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS context, p_name AS object_type FROM lineitem JOIN part ON p_partkey = l_partkey + 1) SELECT * FROM asked ANTI JOIN present USING (context, object_type)"),
    "absence_claims": (absence_claims, f"WITH {_DRAWN}, had AS (SELECT *, row_number() OVER (PARTITION BY context ORDER BY md5('42-' || context || '|' || object_type), object_type) AS k FROM present) SELECT context, object_type, 'supported' AS label FROM drawn UNION ALL SELECT context, object_type, 'refuted' FROM had WHERE k <= 3"),
    "semantic_map": (semantic_map, "SELECT c_mktsegment AS object_type, string_agg(DISTINCT 'region_' || CAST(n_regionkey AS VARCHAR), ',' ORDER BY 'region_' || CAST(n_regionkey AS VARCHAR)) AS parents FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "realize_triples": (realize_triples, f"WITH {LEX} SELECT ord, sentence FROM st"),
    "realize_conjunction": (realize_conjunction, f"WITH {LEX}, pt AS (SELECT *, TRY_CAST(regexp_extract(s, '([0-9]+)$', 1) AS BIGINT) AS n FROM st WHERE rel <> 'isUrgent') SELECT a.s AS a, b.s AS b, rtrim(a.sentence, '.') || ' and ' || CASE WHEN a.s = b.s THEN regexp_replace(lower(b.sentence), '^the .* is ', '') ELSE lower(b.sentence) END AS sentence FROM pt a JOIN pt b ON a.rel = 'mass' AND b.rel = 'temperature' AND b.n IN (a.n, a.n + 1)"),
    "realize_absence": (realize_absence, f"WITH {_ABSENT} SELECT context, 'There is no ' || lower(object_type) || ' in this scene.' AS sentence FROM absent"),
    "realize_drawn_absence": (realize_drawn_absence, f"WITH {_DRAWN} SELECT context, 'There is no ' || lower(object_type) || ' in this scene.' AS sentence FROM drawn"),
    "sentence_normalise": (sentence_normalise, "WITH x AS (SELECT item_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM benchmark) SELECT item_id, upper(substr(t, 1, 1)) || substr(t, 2) || CASE WHEN regexp_matches(t, '[.!?]$') THEN '' ELSE '.' END AS sentence, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '…' ELSE text END AS short, substr(sha256(text), 1, 16) AS hash FROM x"),
    "coevidence_edges": (coevidence_edges, f"WITH {_CO} SELECT claim_id, src, dst FROM co WHERE k <= 5"),
    "triple_index": (triple_index, f"WITH {_IX} SELECT * FROM ix"),
    "graph_edges": (graph_edges, f"WITH {_ED} SELECT * FROM ed"),
    "graph_size": (graph_size, f"WITH {_ED} SELECT claim_id, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("has_evidence", "connected_to", "co_evidence", "has_triple", "from_triple")) + ", count(*) AS n_edges FROM ed GROUP BY 1"),
    "attention": (attention, f"WITH {_CO}, e AS (SELECT co.claim_id, co.src, co.dst, length(s.text) / 100 + t.i / 4 AS raw, sqrt(length(s.text)) AS v FROM co JOIN tn s ON s.claim_id = co.claim_id AND s.i = co.src JOIN tn t ON t.claim_id = co.claim_id AND t.i = co.dst WHERE k <= 5), w AS (SELECT *, exp(raw) AS w FROM e) SELECT claim_id, dst, round(sum(w * v) / sum(w), 4) AS message FROM w GROUP BY 1, 2"),
    "features": (features, None),
    "relation_shares": (pair_shares, f"WITH {B.TR}, c AS (SELECT regexp_extract(p, '([^/]*)$', 1) AS key, count(*) AS n FROM tr GROUP BY 1) SELECT 'all' AS \"all\", key, n, round(n / sum(n) OVER (), 4) AS share FROM c"),
}
_STRUCTURED = QUERIES["structured_claims"][1] + f" UNION ALL SELECT 'conjunction', label, count(*) FROM ({QUERIES['conjunction_claims'][1]}) GROUP BY label"
QUERIES["structured_claims"] = (structured_claims, _STRUCTURED)
