"""Queries over scorers, thresholds, ablations and training histories, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import vocab as V
from corroborate.operators import generate as G
from corroborate.operators import models as O
from corroborate.plans import bindings as B
from corroborate.plans.evidence_queries import _items, _scores
from corroborate.sources import records as R


def _labelled(spark, d):
    return O.by_thresholds(_scores(spark, d)).withColumnRenamed("pred", "label")


def theta_search(spark, d):
    return O.theta_search(_labelled(spark, d))


def type_counterfactuals(spark, d):
    return O.type_counterfactuals(_items(spark, d))


def leave_one_out(spark, d):
    return O.without_each(_items(spark, d))


def probe_pass_rates(spark, d):
    """Users as hypotheses: does the decision path agree with the formula?"""
    s = O.by_decision(_labelled(spark, d).withColumnRenamed("label", "expected"))
    return O.pass_rates(s.withColumn("hypothesis", F.concat(F.lit("h"), (F.substring_index("claim_id", "-", 1).cast("long") % 5).cast("string"))), "hypothesis")


def stance_ordinals(spark, d):
    return O.stance_ordinals(B.evidence(spark, d)).select("event_id", "nth")


def best_epochs(spark, d):
    """Days as epochs, event types as models, mean values as losses."""
    h = B.table(spark, d, "events").groupBy(F.col("event_type").alias("model"), F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("val_loss"))
    return O.best_epochs(h).select("model", "epoch", "best", "waited", "stopped")


def graph_positions(spark, d):
    c = B.claims(spark, d).where("length(text) > 20").select("doc_id", F.col("lang").alias("split"), F.col("doc_id").alias("line_idx"))
    return O.positions(c).select("doc_id", F.col("graph").cast("long").alias("graph"))


def skipped_claims(spark, d):
    c = B.claims(spark, d)
    ids = c.where("length(text) <= 20").select(F.col("doc_id").alias("id"))
    return O.skipped(ids, c.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "label"))


def distinct_claims(spark, d):
    c = B.claims(spark, d).select(F.col("doc_id").alias("id"), F.col("text").alias("claim"), F.lit(None).cast("array<array<string>>").alias("claim_triples"), "label")
    return O.distinct_claims(c).select("id", "label")


def model_pairs(spark, d):
    return O.model_pairs(B.table(spark, d, "orders").select(F.col("o_orderpriority").alias("model")).distinct())


def parent_relations(spark, d):
    n = B.table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("object_id"), F.lit("nation").alias("object_type"), F.array(F.concat(F.lit("r"), "n_regionkey")).alias("parents"))
    r = B.table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("object_id"), F.when(F.col("r_regionkey") % 2 == 0, "shelf").otherwise("drawer").alias("object_type"), F.array().cast("array<string>").alias("parents"))
    return O.parent_relations(n.unionByName(r), surfaces=("shelf",))


def extracted_json(spark, d):
    e = B.table(spark, d, "events").select("event_id", F.concat(F.lit("Answer: "), "props", F.lit(" as asked")).alias("text"))
    return e.select("event_id", O.extracted_json(F.col("text"), "k long")["k"].alias("k"))


def prompts(spark, d):
    t = B.turns(spark, d).groupBy("claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("text").alias("t")))), lambda x: x["t"]).alias("ev"))
    return t.select("claim_id", F.sha2(O.prompt(F.lit("it holds"), F.col("ev")), 256).alias("hash"))


def latest_runs(spark, d):
    runs = B.table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished"))
    return R.latest_run(runs)


def prediction_payload(spark, d):
    p = O.payload(_items(spark, d), _scores(spark, d))
    return p.select("claim_id", "final", "reason", F.size("evidence").cast("long").alias("n"), F.array_max(F.transform("evidence", lambda e: e["confidence"])).alias("top"))


def verdict_head(spark, d):
    """Share of the formula's verdicts that the fitted head repeats (rows only: it is trained here)."""
    s = _labelled(spark, d).withColumnRenamed("label", "verdict").where(F.col("verdict") != "conflicting_evidence")
    out = O.apply_verdict_head(O.fit_verdict_head(s, epochs=30), s)
    return out.agg(F.round(F.avg((F.col("pred") == F.col("verdict")).cast("double")), 4).alias("accuracy"))


def jittered_strength(spark, d):
    return B.evidence(spark, d).select("event_id", G.jittered(F.col("inference_strength"), F.col("event_id")).alias("strength"))


def valid_timestamps(spark, d):
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("yesterday")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return B.table(spark, d, "events").groupBy(F.try_to_timestamp(raw).isNotNull().alias("valid")).agg(F.count("*").alias("n"))


def _flip(t: str) -> str:
    w = V.EVIDENCE_WEIGHTS[t]
    c = f"CASE WHEN {w}::DOUBLE * inference_strength = 0 THEN 0.0 ELSE round(1 - pow(1 - source_trust, {w}::DOUBLE * inference_strength), 4) END"
    side = lambda s: f"round(1 - coalesce(product(1 - {c}) FILTER (stance = '{s}'), 1.0), 4)"
    return f"SELECT '{t}' AS type, claim_id, {side('supports')} AS support, {side('refutes')} AS refute FROM items GROUP BY claim_id"


_UNIT = "(CAST(('0x' || substr(md5('{salt}-' || CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT)::DOUBLE + 1) / 4294967296.0::DOUBLE"
_LABELLED = f"{B.SCORES}, lb AS (SELECT *, {B.VERDICT} AS label FROM scores)"
_AT = "CASE WHEN support > {t} AND refute > {t} THEN 'not_enough_evidence' WHEN support > {t} THEN 'supported' WHEN refute > {t} THEN 'refuted' ELSE 'not_enough_evidence' END"

QUERIES = {
    "theta_search": (theta_search, f"WITH {_LABELLED} " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS theta, round(avg(CAST({_AT.format(t=f'{t}::DOUBLE')} = label AS DOUBLE)), 4) AS accuracy FROM lb" for t in (0.20, 0.25, 0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60))),
    "type_counterfactuals": (type_counterfactuals, f"WITH {B.SCORES}, cf AS (" + " UNION ALL ".join(_flip(t) for t in V.EVIDENCE_TYPES) + f"), a AS (SELECT type, claim_id, {B.VERDICT} AS v FROM cf), b AS (SELECT claim_id, {B.VERDICT} AS v FROM scores) SELECT type, count(*) AS n, count(*) FILTER (a.v <> b.v) AS n_changed FROM a JOIN b USING (claim_id) GROUP BY 1"),
    "leave_one_out": (leave_one_out, f"WITH {B.SCORES}, w AS (SELECT claim_id, event_id, "
        + ", ".join(f"round(1 - coalesce(product(CASE WHEN stance = '{s}' THEN 1 - confidence END) OVER (PARTITION BY claim_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 1.0) + 1e-10, 4) AS {n}" for s, n in (("supports", "support"), ("refutes", "refute")))
        + f" FROM items), v AS (SELECT *, {B.VERDICT} AS verdict FROM w), n AS (SELECT claim_id, {B.VERDICT} AS whole FROM scores) SELECT claim_id, event_id, support, refute, verdict, verdict <> whole AS changed FROM v JOIN n USING (claim_id)"),
    "probe_pass_rates": (probe_pass_rates, f"WITH {_LABELLED} SELECT 'h' || CAST(CAST(split_part(claim_id, '-', 1) AS BIGINT) % 5 AS VARCHAR) AS hypothesis, count(*) AS n, round(avg(CAST({_AT.format(t='0.35::DOUBLE')} = label AS DOUBLE)), 4) AS pass_rate FROM lb GROUP BY 1"),
    "stance_ordinals": (stance_ordinals, f"WITH {B.EV} SELECT event_id, CAST(row_number() OVER (PARTITION BY claim_id, stance ORDER BY event_id) AS INTEGER) AS nth FROM ev"),
    "best_epochs": (best_epochs, "WITH h AS (SELECT event_type AS model, CAST(day(ts) AS INTEGER) AS epoch, round(avg(value), 6) AS val_loss FROM events GROUP BY 1, 2), b AS (SELECT *, min(val_loss) OVER (PARTITION BY model ORDER BY epoch) AS best FROM h), w AS (SELECT *, epoch - max(CASE WHEN val_loss <= best THEN epoch END) OVER (PARTITION BY model ORDER BY epoch) AS waited FROM b) SELECT model, epoch, best, waited, max(waited) OVER (PARTITION BY model ORDER BY epoch) >= 5 AS stopped FROM w"),
    "graph_positions": (graph_positions, f"WITH {B.CL} SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS graph FROM cl WHERE length(text) > 20"),
    "skipped_claims": (skipped_claims, f"WITH {B.CL} SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN label END AS label FROM cl WHERE length(text) <= 20"),
    "distinct_claims": (distinct_claims, f"WITH {B.CL} SELECT min(doc_id) AS id, label FROM cl GROUP BY text, label"),
    "model_pairs": (model_pairs, "WITH m AS (SELECT DISTINCT o_orderpriority AS x FROM orders) SELECT a.x AS a, b.x AS b FROM m a JOIN m b ON a.x < b.x"),
    "parent_relations": (parent_relations, "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS s, CASE WHEN n_regionkey % 2 = 0 THEN 'onTopOf' ELSE 'inside' END AS p, 'r' || CAST(n_regionkey AS VARCHAR) AS o FROM nation"),
    "extracted_json": (extracted_json, "SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "prompts": (prompts, f"WITH {B.TURN} SELECT claim_id, sha256('Claim: it holds' || chr(10) || 'Evidence:' || chr(10) || string_agg(CAST(i + 1 AS VARCHAR) || '. ' || text, chr(10) ORDER BY ord)) AS hash FROM tn GROUP BY 1"),
    "latest_runs": (latest_runs, "SELECT event_type AS model, arg_max(event_id, ts) AS run_id FROM events GROUP BY 1"),
    "prediction_payload": (prediction_payload, f"WITH {_LABELLED}, k AS (SELECT claim_id, count(*) AS n, max(CAST(round(CAST(confidence AS DECIMAL(10,4)), 3) AS DOUBLE)) AS top FROM items GROUP BY 1) SELECT claim_id, {_AT.format(t='0.35::DOUBLE')} AS final, printf('support %.4f, refute %.4f: %s', support, refute, {B.PATH}) AS reason, n, top FROM lb JOIN k USING (claim_id)"),
    "verdict_head": (verdict_head, None),
    "jittered_strength": (jittered_strength, f"WITH {B.EV}, u AS (SELECT event_id, inference_strength AS x, {_UNIT.format(salt='a')} AS a, {_UNIT.format(salt='b')} AS b FROM ev) SELECT event_id, round(greatest(0.1::DOUBLE, least(1.0::DOUBLE, x + 0.05::DOUBLE * (sqrt(-2 * ln(a)) * cos(2 * pi() * b)))), 4) AS strength FROM u"),
    "valid_timestamps": (valid_timestamps, "SELECT event_id % 9 <> 0 AS valid, count(*) AS n FROM events GROUP BY 1"),
}
