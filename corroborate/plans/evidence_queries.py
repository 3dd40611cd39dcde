"""Queries over evidence, sources and claims' scores, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import formula
from corroborate.functions import vocab as V
from corroborate.operators import evidence as E
from corroborate.operators import metrics as M
from corroborate.operators import profile as P
from corroborate.operators import resolve as R
from corroborate.plans import bindings as B


def _items(spark, d):
    return E.score_items(B.evidence(spark, d), B.registry(spark))


def _scores(spark, d):
    return E.claim_scores(_items(spark, d))


def evidence_weight(spark, d):
    return B.evidence(spark, d).select("event_id", formula.evidence_weight(F.col("evidence_types")).alias("weight"))


def evidence_confidence(spark, d):
    return _items(spark, d).select("event_id", "source_trust", "weight", "confidence")


def claim_scores(spark, d):
    return _scores(spark, d)


def claim_verdict(spark, d):
    return E.claim_verdicts(B.evidence(spark, d), B.registry(spark))


def raw_scores(spark, d):
    return E.claim_scores(_items(spark, d), digits=None).select("claim_id", F.round("support", 6).alias("support"), F.round("refute", 6).alias("refute"), F.round(1 - F.greatest("support", "refute"), 6).alias("nei"))


def soft_scores(spark, d):
    p = F.when(F.col("stance") == "supports", 0.8).when(F.col("stance") == "refutes", 0.1).otherwise(0.2)
    r = F.when(F.col("stance") == "supports", 0.1).when(F.col("stance") == "refutes", 0.8).otherwise(0.2)
    return E.soft_scores(_items(spark, d), p, r).select("claim_id", *(F.round(c, 6).alias(c) for c in ("support", "refute", "nei")))


def decision_path(spark, d):
    return E.with_decision_path(_scores(spark, d)).select("claim_id", "path", "final")


def _judged(spark, d):
    """Claims with verdict as label, decision as prediction, sources by user, and three flags: made to
    break shortcuts, placeholder texts, question-answer texts."""
    s = E.with_decision_path(_scores(spark, d).withColumn("label", formula.verdict(F.col("support"), F.col("refute"))))
    user = F.substring_index("claim_id", "-", 1).cast("long")
    flags = {"is_shortcut_breaking": user % 4 == 0, "placeholder": user % 7 == 0, "qa_format": user % 5 == 0}
    return s.withColumn("source", F.concat(F.lit("s"), (user % 3).cast("string"))).withColumns(flags).withColumnRenamed("final", "pred")


JUDGED = f"""{B.SCORES}, judged AS (SELECT claim_id, support, refute, {B.VERDICT} AS label, {B.PATH} AS path,
  CASE {B.PATH} WHEN 'symbolic_supported' THEN 'supported' WHEN 'symbolic_refuted' THEN 'refuted' ELSE 'not_enough_evidence' END AS pred,
  's' || CAST(u % 3 AS VARCHAR) AS source, u % 4 = 0 AS is_shortcut_breaking, u % 7 = 0 AS placeholder, u % 5 = 0 AS qa_format FROM (SELECT *, CAST(split_part(claim_id, '-', 1) AS BIGINT) AS u FROM scores))"""
_LABELS = ("supported", "refuted", "not_enough_evidence", "conflicting_evidence")


def _macro_f1(of: str, by: str) -> str:
    """SQL: (by, macro_f1) of the rows of a table with pred and label, over all verdicts."""
    each = " UNION ALL ".join(
        f"SELECT {by} AS k, CASE WHEN count(*) FILTER (pred = '{v}' OR label = '{v}') = 0 OR count(*) FILTER (pred = '{v}' AND label = '{v}') = 0 THEN 0.0 "
        f"ELSE 2.0 * count(*) FILTER (pred = '{v}' AND label = '{v}') / (count(*) FILTER (pred = '{v}') + count(*) FILTER (label = '{v}')) END AS f FROM {of} GROUP BY 1"
        for v in _LABELS
    )
    return f"SELECT k, round(avg(f), 4) AS macro_f1 FROM ({each}) GROUP BY 1"


def path_stats(spark, d):
    return M.path_stats(_judged(spark, d))


def path_summary(spark, d):
    return M.path_summary(_judged(spark, d))


def conflict_cases(spark, d):
    return M.conflict_cases(_judged(spark, d), "claim_id")


def layer_metrics(spark, d):
    return M.layer_metrics(_judged(spark, d), V.VERDICTS)


def failure_patterns(spark, d):
    kind = M.failure_pattern(F.col("support"), F.col("refute"), F.col("pred"), F.col("label"), F.col("placeholder"), F.col("qa_format"))
    return _judged(spark, d).groupBy(kind.alias("pattern")).agg(F.count("*").alias("n"))


def shortcut_subset(spark, d):
    return M.subset_metrics(_judged(spark, d).where("is_shortcut_breaking"), V.VERDICTS)


def model_deltas(spark, d):
    j = _judged(spark, d)
    hit = lambda k: j.where(F.col("source") == k).groupBy(F.col("path").alias("metric")).agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("value"))
    return M.model_deltas(hit("s0"), hit("s1")).select("metric", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "delta")


def probe_pairs(spark, d):
    s = _scores(spark, d).withColumn("user", F.substring_index("claim_id", "-", 1)).withColumn("day", F.expr("substr(claim_id, instr(claim_id, '-') + 1)"))
    a, b = s.select(F.col("user"), F.col("day").alias("day_a"), F.col("support").alias("a")), s.select(F.col("user"), F.col("day").alias("day_b"), F.col("support").alias("b"))
    pairs = a.join(b, (a["user"] == b["user"]) & (F.date_add(F.to_date("day_a"), 1) == F.to_date("day_b")))
    return pairs.select(a["user"].alias("user"), "day_a", F.round(F.col("b") - F.col("a"), 4).alias("delta"))


def claim_types(spark, d):
    return E.types_of_claims(B.evidence(spark, d)).select("claim_id", F.array_join("evidence_types_all", ",").alias("types"))


def _training(spark, d):
    return E.training_claims(claim_verdict(spark, d).join(E.types_of_claims(B.evidence(spark, d)), "claim_id"))


def training_filter(spark, d):
    return _training(spark, d).where("excluded is null").select("claim_id", "verdict")


def filter_exclusions(spark, d):
    return _training(spark, d).groupBy(F.coalesce("excluded", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def type_multihot(spark, d):
    hot = V.multi_hot(F.col("evidence_types"), V.TRAINING_TYPES)
    kind = V.one_hot(F.col("modality"), V.ENCODED_MODALITIES, "unknown")
    return B.evidence(spark, d).select("event_id", *(hot[i].cast("int").alias(f"t{i}") for i in range(5)), kind[0].cast("int").alias("m_sensor"), kind[5].cast("int").alias("m_pdf"), V.stance_code(F.col("stance")).alias("stance_code"))


def distributions(spark, d):
    e = B.evidence(spark, d)
    return P.distributions(e, {"stance": F.col("stance"), "modality": F.col("modality"), "type": F.col("evidence_types"), "source": F.col("source_id")})


def imbalance(spark, d):
    return P.imbalanced(distributions(spark, d), ["dim"], 0.30)


def readiness(spark, d):
    each = B.evidence(spark, d).groupBy("claim_id").agg(F.count("*").alias("n"), F.count_if(F.size("evidence_types") > 1).alias("t"))
    return P.readiness(each, F.col("n"), F.col("t"))


def type_targets(spark, d):
    counts = distributions(spark, d).where("dim = 'type'").select("key", "n")
    targets = spark.createDataFrame([("perception", 20.0), ("testimony", 25.0), ("inference", 15.0), ("comparison_analogy", 20.0), ("missing_type", 5.0)], "key string, target double")
    return P.against_targets(counts, targets)


def dominance(spark, d):
    e = B.evidence(spark, d)
    return P.dominance(e.groupBy("claim_id", "stance").agg(F.count("*").alias("n")), "claim_id", "stance", 0.6)


def stance_verdict_majority(spark, d):
    joined = B.evidence(spark, d).select("claim_id", "stance").join(claim_verdict(spark, d).select("claim_id", "verdict"), "claim_id")
    return M.majority(joined, "stance", "verdict")


def source_verdict_crosstab(spark, d):
    return P.crosstab(_judged(spark, d), "source", "label", V.VERDICTS)


def describe_strength(spark, d):
    return P.describe(B.evidence(spark, d), "inference_strength", ["stance"])


def strength_histogram(spark, d):
    h = P.histogram(B.evidence(spark, d), "inference_strength", 0.1)
    return h.select(F.round("edge", 1).alias("edge"), "n")


def average_strength(spark, d):
    return B.evidence(spark, d).groupBy("claim_id").agg(F.round(F.avg("inference_strength"), 6).alias("avg_strength"))


def registry_gaps(spark, d):
    return R.registry_gaps(B.registry(spark))


def registry_search(spark, d):
    found = P.search(B.registry(spark), any_contains=(("source_id", "source_name", "source_type"), "S"), one_of={"modality": ("web_text", "pdf")}, between={"source_trust": (0.4, 0.8)})
    return found.orderBy(F.desc("source_trust"), "source_id").limit(20).select("source_id", "source_trust", "source_type", "modality")


def trust_ranges(spark, d):
    return R.trust_ranges(B.registry(spark))


def trust_averages(spark, d):
    return R.trust_averages(B.registry(spark))


def trust_update(spark, d):
    e = B.evidence(spark, d).groupBy("source_id").agg(F.count_if(F.col("stance") == "supports").alias("c"), F.count("*").alias("n"))
    return e.select("source_id", F.round(formula.updated_trust(F.lit(2.0), F.lit(2.0), F.col("c"), F.col("n")), 4).alias("trust"))


def source_category_counts(spark, d):
    return R.source_categories(B.evidence(spark, d), B.registry(spark)).groupBy("category").agg(F.count("*").alias("n"))


def resolve_source(spark, d):
    return R.resolve_urls(B.web_items(spark, d), B.web_registry(spark)).select("page_id", "domain", "modality", "source_id")


def uncovered_domains(spark, d):
    seen = R.resolve_urls(B.web_items(spark, d), B.web_registry(spark)).select("domain")
    curated = spark.createDataFrame([("blog.tionsh.example.net",), ("thther.example.org",)], "domain string")
    return R.uncovered_domains(seen, curated)


def order_noisy_or(spark, d):
    li = B.table(spark, d, "lineitem")
    p = F.least(F.sqrt(F.abs(F.col("l_discount")) * 2 + F.abs(F.col("l_tax")) + F.col("l_quantity") / 1000), F.lit(0.95))
    score = li.groupBy("l_orderkey").agg(formula.rounded(formula.noisy_or(F.when(F.col("l_returnflag") != "R", p)), 4).alias("support"), formula.rounded(formula.noisy_or(F.when(F.col("l_returnflag") == "R", p)), 4).alias("refute"))
    return score.withColumn("verdict", formula.verdict(F.col("support"), F.col("refute")))


def day_scores(spark, d):
    """Scores in windows of event time, as the stream makes them, on the finished table."""
    items = _items(spark, d).groupBy(F.window("ts", "1 day").alias("w"), "source_id").agg(formula.rounded(formula.stance_score(F.col("stance"), F.col("confidence"), "supports"), 4).alias("support"), F.count("*").alias("n"))
    return items.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "source_id", "support", "n")


_TYPES = "tp AS (SELECT claim_id, string_agg(DISTINCT t, ',' ORDER BY t) AS types, bool_or(t <> 'postulation_derivation') AS training FROM (SELECT claim_id, t1 AS t FROM ev UNION ALL SELECT claim_id, 'postulation_derivation' FROM ev WHERE has_post) GROUP BY claim_id)"
_DIST = f"{B.EV}, dist AS (SELECT dim, key, count(*) AS n FROM (SELECT 'stance' AS dim, stance AS key FROM ev UNION ALL SELECT 'modality', modality FROM ev UNION ALL SELECT 'source', source_id FROM ev UNION ALL SELECT 'type', t1 FROM ev UNION ALL SELECT 'type', 'postulation_derivation' FROM ev WHERE has_post) GROUP BY dim, key)"

QUERIES = {
    "evidence_weight": (evidence_weight, f"WITH {B.ITEMS} SELECT event_id, weight FROM items"),
    "evidence_confidence": (evidence_confidence, f"WITH {B.ITEMS} SELECT event_id, source_trust, weight, confidence FROM items"),
    "claim_scores": (claim_scores, f"WITH {B.SCORES} SELECT * FROM scores"),
    "claim_verdict": (claim_verdict, f"WITH {B.SCORES} SELECT *, {B.VERDICT} AS verdict FROM scores"),
    "raw_scores": (raw_scores, f"WITH {B.ITEMS}, x AS (SELECT claim_id, 1 - coalesce(product(1 - confidence) FILTER (stance = 'supports'), 1.0) AS s, 1 - coalesce(product(1 - confidence) FILTER (stance = 'refutes'), 1.0) AS r FROM items GROUP BY 1) SELECT claim_id, round(s, 6) AS support, round(r, 6) AS refute, round(1 - greatest(s, r), 6) AS nei FROM x"),
    "soft_scores": (soft_scores, f"WITH {B.ITEMS}, x AS (SELECT claim_id, 1 - product(1 - confidence * CASE stance WHEN 'supports' THEN 0.8::DOUBLE WHEN 'refutes' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END) AS s, 1 - product(1 - confidence * CASE stance WHEN 'supports' THEN 0.1::DOUBLE WHEN 'refutes' THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END) AS r FROM items GROUP BY 1) SELECT claim_id, round(s, 6) AS support, round(r, 6) AS refute, round(1 - greatest(s, r), 6) AS nei FROM x"),
    "decision_path": (decision_path, f"WITH {JUDGED} SELECT claim_id, path, pred AS final FROM judged"),
    "path_stats": (path_stats, f"WITH {JUDGED}, ks AS (SELECT unnest(['symbolic_supported', 'symbolic_refuted', 'vh_conflict', 'vh_fallback']) AS path), sr AS (SELECT DISTINCT source FROM judged UNION ALL SELECT NULL), c AS (SELECT path, source, count(*) AS n, avg(CAST(pred = label AS DOUBLE)) AS a FROM judged GROUP BY GROUPING SETS ((path), (source, path))) SELECT sr.source, ks.path, coalesce(c.n, 0) AS n, round(a, 4) AS accuracy FROM ks CROSS JOIN sr LEFT JOIN c ON c.path = ks.path AND c.source IS NOT DISTINCT FROM sr.source"),
    "path_summary": (path_summary, f"WITH {JUDGED} SELECT count(*) FILTER (path LIKE 'symbolic%') AS n_symbolic, count(*) FILTER (path LIKE 'vh%') AS n_learned, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (path LIKE 'symbolic%') / count(*), 1) AS symbolic_pct FROM judged"),
    "conflict_cases": (conflict_cases, f"WITH {JUDGED} SELECT claim_id, source, label, pred, support, refute, pred = label AS correct FROM judged WHERE path = 'vh_conflict'"),
    "layer_metrics": (layer_metrics, f"WITH {JUDGED}, ly AS (SELECT *, CASE WHEN path LIKE 'symbolic%' THEN 'ec_symbolic' ELSE 'verdicthead' END AS layer FROM judged), f AS ({_macro_f1('ly', 'layer')}) SELECT layer, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM judged), 4) AS coverage, round(avg(CAST(pred = label AS DOUBLE)), 4) AS accuracy, max(macro_f1) AS macro_f1 FROM ly JOIN f ON f.k = layer GROUP BY 1"),
    "failure_patterns": (failure_patterns, f"WITH {JUDGED} SELECT CASE WHEN pred = label THEN 'correct' WHEN (refute > 0.35 AND pred <> 'refuted') OR (support > 0.35 AND pred <> 'supported') THEN 'ec_override_fix' WHEN greatest(support, refute) < 0.20 THEN 'all_neutral_ec' WHEN placeholder THEN 'placeholder_ev' WHEN qa_format THEN 'qa_format_ev' ELSE 'genuine_error' END AS pattern, count(*) AS n FROM judged GROUP BY 1"),
    "shortcut_subset": (shortcut_subset, f"WITH {JUDGED}, sb AS (SELECT * FROM judged WHERE is_shortcut_breaking), f AS ({_macro_f1('sb', 'true')}) SELECT count(*) AS n, round(avg(CAST(pred = label AS DOUBLE)), 4) AS accuracy, (SELECT macro_f1 FROM f) AS macro_f1 FROM sb"),
    "model_deltas": (model_deltas, f"WITH {JUDGED}, a AS (SELECT path, avg(CAST(pred = label AS DOUBLE)) AS v FROM judged WHERE source = 's0' GROUP BY 1), b AS (SELECT path, avg(CAST(pred = label AS DOUBLE)) AS v FROM judged WHERE source = 's1' GROUP BY 1) SELECT coalesce(a.path, b.path) AS metric, round(a.v, 4) AS a, round(b.v, 4) AS b, round(b.v - a.v, 4) AS delta FROM a FULL JOIN b ON a.path = b.path"),
    "probe_pairs": (probe_pairs, f"WITH {B.SCORES}, x AS (SELECT split_part(claim_id, '-', 1) AS user, substr(claim_id, instr(claim_id, '-') + 1) AS day, support FROM scores) SELECT a.user, a.day AS day_a, round(b.support - a.support, 4) AS delta FROM x a JOIN x b ON a.user = b.user AND CAST(a.day AS DATE) + 1 = CAST(b.day AS DATE)"),
    "claim_types": (claim_types, f"WITH {B.EV}, {_TYPES} SELECT claim_id, types FROM tp"),
    "training_filter": (training_filter, f"WITH {B.SCORES}, {_TYPES} SELECT claim_id, {B.VERDICT} AS verdict FROM scores JOIN tp USING (claim_id) WHERE training AND {B.VERDICT} <> 'conflicting_evidence'"),
    "filter_exclusions": (filter_exclusions, f"WITH {B.SCORES}, {_TYPES} SELECT CASE WHEN {B.VERDICT} = 'conflicting_evidence' THEN 'conflicting_evidence' WHEN NOT training THEN 'no_training_type' ELSE 'kept' END AS reason, count(*) AS n FROM scores JOIN tp USING (claim_id) GROUP BY 1"),
    "type_multihot": (type_multihot, f"WITH {B.EV} SELECT event_id, CAST(t1 = 'perception' AS INT) AS t0, CAST(t1 = 'testimony' AS INT) AS t1, CAST(ev.t1 = 'non_apprehension' AS INT) AS t2, CAST(ev.t1 = 'comparison_analogy' AS INT) AS t3, CAST(ev.t1 = 'inference' AS INT) AS t4, CAST(modality = 'sensor' AS INT) AS m_sensor, CAST(modality = 'pdf' AS INT) AS m_pdf, CASE stance WHEN 'supports' THEN 0 WHEN 'refutes' THEN 1 ELSE 2 END AS stance_code FROM ev".replace("t1 = 'perception'", "ev.t1 = 'perception'").replace("t1 = 'testimony'", "ev.t1 = 'testimony'").replace("ev.ev.", "ev.")),
    "distributions": (distributions, f"WITH {_DIST} SELECT * FROM dist"),
    "imbalance": (imbalance, f"WITH {_DIST}, s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY dim), 4) AS share FROM dist) SELECT * FROM s WHERE share > 0.30"),
    "readiness": (readiness, f"WITH {B.EV}, c AS (SELECT claim_id, count(*) AS k, count(*) FILTER (has_post) AS t FROM ev GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (k = 0) AS n_zero_evidence, count(*) FILTER (t = 0) AS n_zero_triples, round(sum(k)::DOUBLE / count(*), 2) AS avg_evidence, round(sum(t)::DOUBLE / count(*), 2) AS avg_triples FROM c"),
    "type_targets": (type_targets, f"WITH {_DIST}, g AS (SELECT * FROM (VALUES ('perception', 20.0::DOUBLE), ('testimony', 25.0), ('inference', 15.0), ('comparison_analogy', 20.0), ('missing_type', 5.0)) t(key, target)), x AS (SELECT g.key, coalesce(n, 0) AS n, target, round(100.0 * coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM dist WHERE dim = 'type'), 2) AS pct FROM g LEFT JOIN (SELECT * FROM dist WHERE dim = 'type') dd ON dd.key = g.key) SELECT key, n, target, pct, round(pct - target, 2) AS delta, abs(round(pct - target, 2)) <= 5.0 AS ok FROM x"),
    "dominance": (dominance, f"WITH {B.EV}, c AS (SELECT claim_id, stance, count(*) AS n FROM ev GROUP BY 1, 2), x AS (SELECT claim_id, arg_max(stance, (n, stance)) AS stance, max(n) AS top, sum(n) AS total, count(*) AS k FROM c GROUP BY 1) SELECT claim_id, stance, round(top / total, 4) AS share FROM x WHERE k > 1 AND top / total >= 0.6"),
    "stance_verdict_majority": (stance_verdict_majority, f"WITH {B.SCORES}, j AS (SELECT ev.stance, {B.VERDICT} AS v FROM ev JOIN scores USING (claim_id)), c AS (SELECT stance, v, count(*) AS n FROM j GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY stance ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY stance) AS total FROM c) SELECT stance, v AS majority, round(n / total, 4) AS share, CAST(total AS BIGINT) AS n FROM r WHERE k = 1"),
    "source_verdict_crosstab": (source_verdict_crosstab, f"WITH {JUDGED} SELECT source, " + ", ".join(f"count(*) FILTER (label = '{v}') AS n_{v}" for v in V.VERDICTS) + " FROM judged GROUP BY 1"),
    "describe_strength": (describe_strength, f"WITH {B.EV} SELECT stance, count(*) AS n, round(avg(inference_strength), 4) AS mean, round(stddev_samp(inference_strength), 4) AS std, min(inference_strength) AS least, round(quantile_cont(inference_strength, 0.25), 4) AS q1, round(quantile_cont(inference_strength, 0.5), 4) AS median, round(quantile_cont(inference_strength, 0.75), 4) AS q3, max(inference_strength) AS most FROM ev GROUP BY 1"),
    "strength_histogram": (strength_histogram, f"WITH {B.EV} SELECT round(floor(inference_strength / 0.1::DOUBLE) * 0.1::DOUBLE, 1) AS edge, count(*) AS n FROM ev GROUP BY 1"),
    "average_strength": (average_strength, f"WITH {B.EV} SELECT claim_id, round(avg(inference_strength), 6) AS avg_strength FROM ev GROUP BY 1"),
    "registry_gaps": (registry_gaps, f"WITH {B.REG} SELECT DISTINCT source_type || '_' || modality AS source_id FROM reg r WHERE NOT EXISTS (SELECT 1 FROM reg x WHERE x.source_id = r.source_type || '_' || r.modality)"),
    "registry_search": (registry_search, f"WITH {B.REG} SELECT source_id, source_trust, source_type, modality FROM reg WHERE (lower(source_id) LIKE '%s%' OR lower(source_name) LIKE '%s%' OR lower(source_type) LIKE '%s%') AND modality IN ('web_text', 'pdf') AND source_trust BETWEEN 0.4 AND 0.8 ORDER BY source_trust DESC, source_id LIMIT 20"),
    "trust_ranges": (trust_ranges, f"WITH {B.REG} SELECT source_type, min(source_trust) AS min_trust, max(source_trust) AS max_trust FROM reg GROUP BY 1"),
    "trust_averages": (trust_averages, f"WITH {B.REG} SELECT round(avg(source_trust), 4) AS mean_trust, round(median(source_trust), 4) AS median_trust, count(*) AS n FROM reg"),
    "trust_update": (trust_update, f"WITH {B.EV} SELECT source_id, round((2.0::DOUBLE + count(*) FILTER (stance = 'supports')) / (4.0::DOUBLE + count(*)), 4) AS trust FROM ev GROUP BY 1"),
    "source_category_counts": (source_category_counts, f"WITH {B.EV}, {B.REG} SELECT CASE source_type WHEN 'news_media' THEN 'news_media' WHEN 'government' THEN 'government' WHEN 'scientific_paper' THEN 'academic' WHEN 'social_media' THEN 'social_media' WHEN 'sensor' THEN 'sensor' ELSE 'unknown' END AS category, count(*) AS n FROM ev LEFT JOIN reg USING (source_id) GROUP BY 1"),
    "resolve_source": (resolve_source, f"WITH {B.WEB} SELECT page_id, domain, modality, source_id FROM resolved"),
    "uncovered_domains": (uncovered_domains, f"WITH {B.WEB} SELECT domain, count(*) AS n FROM host WHERE domain NOT IN ('blog.tionsh.example.net', 'thther.example.org') GROUP BY 1"),
    "order_noisy_or": (order_noisy_or, f"WITH x AS (SELECT l_orderkey, l_returnflag, least(sqrt(abs(l_discount) * 2 + abs(l_tax) + l_quantity / 1000), 0.95::DOUBLE) AS p FROM lineitem), scores AS (SELECT l_orderkey, round(1 - coalesce(product(1 - p) FILTER (l_returnflag <> 'R'), 1.0), 4) AS support, round(1 - coalesce(product(1 - p) FILTER (l_returnflag = 'R'), 1.0), 4) AS refute FROM x GROUP BY 1) SELECT *, {B.VERDICT} AS verdict FROM scores"),
    "day_scores": (day_scores, f"WITH {B.ITEMS} SELECT strftime(ts, '%Y-%m-%d') AS day, source_id, round(1 - coalesce(product(1 - confidence) FILTER (stance = 'supports'), 1.0), 4) AS support, count(*) AS n FROM items GROUP BY 1, 2"),
}
