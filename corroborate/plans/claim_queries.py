"""Queries over claims, predictions and records, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corroborate.functions import realize as Z
from corroborate.functions import vocab as V
from corroborate.functions import webqa as W
from corroborate.operators import convert as C
from corroborate.operators import evidence as E
from corroborate.operators import generate as G
from corroborate.operators import metrics as M
from corroborate.operators import profile as P
from corroborate.operators import splits as S
from corroborate.operators import validate as X
from corroborate.plans import bindings as B
from corroborate.sources import records as R


def _pred(spark, d):
    p = B.predictions(spark, d)
    return p.withColumn("probs", M.softmax(F.col("logits"))).withColumn("pred", M.argmax(F.col("logits")))


def softmax_argmax(spark, d):
    return _pred(spark, d).select("vec_id", "pred", F.round(F.array_max("probs"), 6).alias("confidence"))


def accuracy(spark, d):
    return M.accuracy(_pred(spark, d))


def per_class_metrics(spark, d):
    return M.per_class(_pred(spark, d), 10).drop("_f1")


def f1_scores(spark, d):
    return M.f1_scores(_pred(spark, d), 10)


def confusion(spark, d):
    return M.confusion(_pred(spark, d), 10)


def ece(spark, d):
    return M.calibration_error(_pred(spark, d), "probs")


def per_group_accuracy(spark, d):
    return M.per_group_accuracy(_pred(spark, d), "source")


def rmse(spark, d):
    return M.rmse(E.score_items(B.evidence(spark, d), B.registry(spark)), "confidence", "inference_strength")


def pearson_r(spark, d):
    return M.pearson(E.score_items(B.evidence(spark, d), B.registry(spark)), "confidence", "inference_strength")


def class_weights(spark, d):
    c = B.claims(spark, d).withColumn("k", V.verdict_code(F.col("label"))).where("k is not null")
    return M.class_weights(c, 3, "k")


def majority_baseline(spark, d):
    """What the majority verdict of each source would get right."""
    c = B.claims(spark, d)
    best = M.majority(c, "source", "label").select("source", F.col("majority").alias("pred"))
    return M.per_group_accuracy(c.join(best, "source"), "lang")


def claim_issues(spark, d):
    checked = B.claims(spark, d).select("doc_id", X.text_issues(F.col("text")).alias("issues"))
    return checked.select("doc_id", F.array_join(F.array_sort(F.transform("issues", lambda i: i["rule"])), ",").alias("rules"))


def quality_score(spark, d):
    c = B.claims(spark, d)
    score = X.quality_score(F.col("text"), X.text_issues(F.col("text")))
    return c.select("doc_id", F.round(score, 4).alias("quality"), X.quality_bucket(F.round(score, 4)).alias("bucket"))


def issue_summary(spark, d):
    return X.issue_counts(B.claims(spark, d).select(X.text_issues(F.col("text")).alias("issues")))


def quality_buckets(spark, d):
    return quality_score(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("avg_quality"))


def evidence_first_seen(spark, d):
    return E.first_seen(E.clean(B.claims(spark, d)), ["lang"], ["doc_id"]).select("doc_id", "lang")


def text_outliers(spark, d):
    return B.claims(spark, d).groupBy("lang").agg(F.count_if(F.size(X.words(F.col("text"))) > 200).alias("n_long"), F.count("*").alias("n"))


def claim_search(spark, d):
    found = P.search(B.claims(spark, d), contains={"text": "the"}, equals={"lang": "en", "label": "supported"}, prefix={"source": "src1"})
    return found.orderBy("doc_id").limit(50).select("doc_id", "source", Z.shortened(F.col("text"), 30).alias("start"))


def seeded_sample(spark, d):
    return S.sample(B.claims(spark, d), "doc_id", 100).select("doc_id", "label")


def pick_one(spark, d):
    return S.pick_one(B.claims(spark, d).select("doc_id", "source"), ["source"], "doc_id")


def group_split(spark, d):
    return S.split_groups(B.claims(spark, d).select("doc_id", "source"), "source")


def stratified_split(spark, d):
    return S.stratified_split(B.claims(spark, d).select("doc_id", "label"), "doc_id", "label")


def split_distributions(spark, d):
    s = S.stratified_split(B.claims(spark, d).select("doc_id", "label", "lang"), "doc_id", "label")
    return P.distributions(s.withColumn("both", F.concat_ws("/", "split", "lang")), {"split": F.col("split"), "lang": F.col("both")})


def apportion_plan(spark, d):
    counts = B.claims(spark, d).groupBy("source").agg(F.count("*").alias("share"))
    return S.apportion(counts, 997, order="source").select("source", "n")


def frequent_sources(spark, d):
    return P.most_frequent(B.table(spark, d, "lineitem"), "l_partkey", 20)


def event_sessions_gate(spark, d):
    """S2, P18, P22 on JSON text: rows whose props parse and hold a whole number k."""
    e = B.table(spark, d, "events")
    k = F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999"))
    return e.select("event_id", k.cast("long").alias("k"), (k.isNotNull() & (k >= 50)).alias("ok"))


def _web_raw(spark, d):
    """Question-answer records from pages: two answers per record."""
    p = B.web_items(spark, d)
    answer = lambda text, kind, url, medium: F.struct(text.alias("answer"), kind.alias("answer_type"), url.alias("source_url"), medium.alias("source_medium"), F.lit(None).cast("string").alias("boolean_explanation"))
    i = F.col("page_id")
    one = answer(F.concat(F.lit("It grew by "), (i % 90).cast("string"), F.lit(" percent")), F.when(i % 4 == 0, "Abstractive").otherwise("Extractive"), F.col("url"), F.when(i % 3 == 0, "Web text").when(i % 3 == 1, "PDF").otherwise("Web table"))
    two = answer(F.lit("Nobody knows for sure"), F.when(i % 5 == 0, "Unanswerable").otherwise("Boolean"), F.when(i % 2 == 0, F.lit("Metadata")).otherwise(F.lit("")), F.when(i % 6 == 0, F.lit("")).otherwise(F.lit("Other")))
    label = F.when(i % 4 == 0, "Supported").when(i % 4 == 1, "Refuted").when(i % 4 == 2, "Conflicting Evidence/Cherrypicking").otherwise("unclear")
    plans = F.when(i % 3 == 0, F.array(F.lit("Numerical Comparison"), F.lit("Written Evidence"))).when(i % 3 == 1, F.array(F.lit("Consultation"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        F.format_string("averitec-train-%06d", i).alias("id"), F.concat(F.lit("Page "), i.cast("string"), F.lit(" says so.")).alias("claim"), label.alias("label"), F.lit(None).cast("string").alias("justification"),
        plans.alias("fact_checking_strategies"), F.array(F.struct(F.lit("How much?").alias("question"), F.array(one, two).alias("answers"))).alias("questions"),
    )


def converted_claims(spark, d):
    c = C.web_claims(_web_raw(spark, d), B.web_registry(spark))
    return c.select("id", F.col("verdict.label").alias("label"), F.col("reasoning.strategy").alias("strategy"), F.array_join("epistemic.evidence_types_all", ",").alias("types"), F.size("evidence").cast("long").alias("n"))


def converted_evidence(spark, d):
    c = C.web_claims(_web_raw(spark, d), B.web_registry(spark)).select(F.explode("evidence").alias("e")).select("e.*")
    return c.select("evidence_id", "modality", "stance", "source_id", "inference_strength", F.array_join("evidence_types", ",").alias("types"), "text")


def schema_gate(spark, d):
    kept, dropped = X.schema_gate(C.web_claims(_web_raw(spark, d), B.web_registry(spark)))
    return kept.select(F.lit("kept").alias("what"), "id").unionByName(dropped.select(F.lit("dropped").alias("what"), "id")).groupBy("what").agg(F.count("*").alias("n"))


def answer_text(spark, d):
    e = converted_evidence(spark, d)
    return e.select("evidence_id", W.answer_only(F.col("text")).alias("answer"))


def ntriples(spark, d):
    t = B.table(spark, d, "nation").select(F.concat(F.lit(f"{B.BASE}/entities/nation_"), F.col("n_nationkey").cast("string")).alias("s"), F.lit(f"{B.BASE}/relations/name").alias("p"), F.col("n_name").alias("o"))
    return t.select(R.ntriples_line(F.col("s"), F.col("p"), F.col("o")).alias("line"))


def embedding_cache(spark, d):
    docs = B.claims(spark, d).select("doc_id", "text")
    cache = docs.where("doc_id % 3 = 0").select(F.substring(F.sha2("text", 256), 1, 16).alias("hash"), F.lit(1).alias("v")).dropDuplicates(["hash"])
    hits, misses = R.cached_embeddings(docs, cache)
    return hits.agg(F.count("*").alias("n")).select(F.lit("hits").alias("what"), "n").unionByName(misses.agg(F.count("*").alias("n")).select(F.lit("misses").alias("what"), "n"))


_WORDS = "list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"
_COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)
_RULES = f"""tx AS (SELECT doc_id, text, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM cl),
iss AS (SELECT doc_id, text, CASE WHEN t = '' THEN ['V8'] ELSE list_filter([
  CASE WHEN length(t) < 10 THEN 'V9' END, CASE WHEN length(t) > 250 THEN 'V10' END, CASE WHEN NOT regexp_matches(t, '[.!?]$') THEN 'V11' END,
  CASE WHEN NOT regexp_matches(substr(t, 1, 1), '^\\p{{Lu}}$') THEN 'V12' END, CASE WHEN len({_WORDS.format(x="lower(t)")}) < 3 THEN 'V13' END,
  CASE WHEN len(list_filter({_WORDS.format(x="lower(t)")}, lambda w: length(w) > 2 AND w NOT IN ({_COMMON}))) < 2 THEN 'V14' END,
  CASE WHEN contains(t, 'http://') OR contains(t, 'https://') THEN 'V15' END, CASE WHEN contains(t, '|') AND contains(t, '%') THEN 'V16' END,
  CASE WHEN contains(lower(t), 'is temperature') THEN 'V17' END, CASE WHEN contains(lower(t), ' is true.') THEN 'V17' END, CASE WHEN contains(lower(t), ' is false.') THEN 'V17' END], lambda r: r IS NOT NULL) END AS rules FROM tx),
qs AS (SELECT doc_id, round(greatest(0.0, least(1.0, 1 - list_sum([CASE WHEN r IN ('V8', 'V15') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END FOR r IN rules]) + CASE WHEN length(text) BETWEEN 10 AND 150 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(text, '[.!?]\\n?$') THEN 0.02::DOUBLE ELSE 0 END + CASE WHEN len({_WORDS.format(x="text")}) >= 5 THEN 0.03::DOUBLE ELSE 0 END)), 4) AS quality FROM (SELECT doc_id, text, CASE WHEN len(rules) = 0 THEN ['none'] ELSE rules END AS rules0, rules FROM iss)),
bk AS (SELECT doc_id, quality, CASE WHEN quality >= 0.9 THEN 'excellent' WHEN quality >= 0.7 THEN 'good' WHEN quality >= 0.5 THEN 'fair' ELSE 'poor' END AS bucket FROM qs)""".replace("list_sum([CASE", "coalesce(list_sum([CASE").replace("FOR r IN rules])", "FOR r IN rules]), 0)")
#: SQL: tables of text rules by doc_id (tx, iss, qs, bk) over a table cl (doc_id, text).
SHARED_TEXT_RULES = _RULES
_TXT = f"{B.CL}, {_RULES}"
_CLASS = f"{B.PRED}, sp AS (SELECT CAST(k AS INTEGER) AS class FROM range(10) t(k)), cc AS (SELECT class, (SELECT count(*) FROM pr WHERE label = class) AS support, (SELECT count(*) FROM pr WHERE pred = class) AS predicted, (SELECT count(*) FROM pr WHERE pred = class AND label = class) AS tp FROM sp), pc AS (SELECT class, support, CASE WHEN predicted = 0 THEN 0.0 ELSE tp::DOUBLE / predicted END AS p, CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS r FROM cc), pf AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pc)"
_MD5 = "md5('42-' || CAST({k} AS VARCHAR))"
_STRAT = f"{B.CL}, rk AS (SELECT doc_id, label, lang, row_number() OVER (PARTITION BY label ORDER BY {_MD5.format(k='doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM cl), ss AS (SELECT doc_id, label, lang, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM rk)"
_CONV = f"""{B.WEB}, base AS (SELECT web.page_id AS i, url, resolved.source_id AS sid, CASE web.page_id % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'refuted' WHEN 2 THEN 'conflicting_evidence' ELSE 'not_enough_evidence' END AS label FROM web JOIN resolved USING (page_id)),
one AS (SELECT i, label, 1 AS a, CASE WHEN i % 4 = 0 THEN 'abstractive' ELSE 'extractive' END AS kind, CASE i % 3 WHEN 0 THEN 'web_text' WHEN 1 THEN 'pdf' ELSE 'web_table' END AS modality, sid AS source_id, 'It grew by ' || CAST(i % 90 AS VARCHAR) || ' percent' AS answer, url AS source_url FROM base),
two AS (SELECT i, label, 2 AS a, CASE WHEN i % 5 = 0 THEN 'unanswerable' ELSE 'boolean' END AS kind, CASE WHEN i % 6 = 0 THEN CASE WHEN i % 5 = 0 THEN 'unanswerable' ELSE 'other' END WHEN i % 2 = 0 THEN 'web_text' ELSE 'other' END AS modality, CASE WHEN i % 2 = 0 THEN 'annotator_knowledge' ELSE 'unknown_web' END AS source_id, 'Nobody knows for sure' AS answer, CASE WHEN i % 2 = 0 THEN 'Metadata' ELSE '' END AS source_url FROM base),
its AS (SELECT x.*, coalesce(source_trust, 0.4)::DOUBLE AS st FROM (SELECT * FROM one UNION ALL SELECT * FROM two) x LEFT JOIN wreg USING (source_id)),
fin AS (SELECT i, label, a, 'averitec-train-' || lpad(CAST(i AS VARCHAR), 6, '0') AS id, modality, source_id,
  CASE WHEN modality = 'unanswerable' THEN 'not_enough_evidence' WHEN label = 'supported' THEN 'supports' WHEN label = 'refuted' THEN 'refutes' ELSE 'not_enough_evidence' END AS stance,
  CASE WHEN st >= 0.45 THEN raw ELSE greatest(0.10::DOUBLE, least(raw, st)) END AS inference_strength, 'Question: How much? Answer: ' || answer AS text,
  CASE WHEN kind = 'unanswerable' THEN '' WHEN modality = 'web_table' THEN 'comparison_analogy,testimony' WHEN contains(answer, 'percent') THEN 'testimony,comparison_analogy' ELSE 'testimony' END
   || CASE WHEN kind = 'abstractive' AND i % 2 = 0 THEN ',inference' ELSE '' END AS types0, kind FROM (SELECT *, CASE kind WHEN 'unanswerable' THEN 0.0::DOUBLE WHEN 'abstractive' THEN 0.6::DOUBLE ELSE 0.8::DOUBLE END AS raw FROM its)),
fi2 AS (SELECT *, types0 || CASE WHEN types0 = '' THEN '' WHEN i % 3 = 0 AND NOT contains(types0, 'comparison') THEN ',comparison_analogy' WHEN i % 3 = 1 AND NOT contains(types0, 'inference') THEN ',inference' ELSE '' END AS types FROM fin)"""

QUERIES = {
    "softmax_argmax": (softmax_argmax, f"WITH {B.PRED} SELECT vec_id, pred, round(conf, 6) AS confidence FROM pr"),
    "accuracy": (accuracy, f"WITH {B.PRED} SELECT round(avg(CAST(pred = label AS DOUBLE)), 4) AS accuracy, count(*) AS n FROM pr"),
    "per_class_metrics": (per_class_metrics, f"WITH {_CLASS} SELECT class, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1, support FROM pf"),
    "f1_scores": (f1_scores, f"WITH {_CLASS} SELECT round(avg(f), 4) AS macro_f1, round(sum(f * support) / sum(support), 4) AS weighted_f1 FROM pf"),
    "confusion": (confusion, f"WITH {B.PRED} SELECT CAST(k AS INTEGER) AS label, " + ", ".join(f"(SELECT count(*) FROM pr WHERE label = k AND pred = {j}) AS pred_{j}" for j in range(10)) + " FROM range(10) t(k)"),
    "ece": (ece, f"WITH {B.PRED}, b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, avg(conf) AS c, avg(CAST(pred = label AS DOUBLE)) AS a FROM pr GROUP BY 1) SELECT round(sum(abs(c - a) * n) / sum(n), 4) AS ece FROM b"),
    "per_group_accuracy": (per_group_accuracy, f"WITH {B.PRED} SELECT source, round(avg(CAST(pred = label AS DOUBLE)), 4) AS accuracy, count(*) AS support FROM pr GROUP BY 1"),
    "rmse": (rmse, f"WITH {B.ITEMS} SELECT round(sqrt(avg(pow(confidence - inference_strength, 2))), 4) AS rmse FROM items"),
    "pearson_r": (pearson_r, f"WITH {B.ITEMS} SELECT round(corr(confidence, inference_strength), 4) AS pearson_r FROM items"),
    "class_weights": (class_weights, f"WITH {B.CL}, c AS (SELECT CASE label WHEN 'supported' THEN 0 WHEN 'refuted' THEN 1 WHEN 'not_enough_evidence' THEN 2 END AS k FROM cl) SELECT CAST(s.k AS INTEGER) AS class, count(c.k) AS n, round((SELECT count(k) FROM c)::DOUBLE / (3 * greatest(count(c.k), 1)), 6) AS weight FROM range(3) s(k) LEFT JOIN c ON c.k = s.k GROUP BY 1"),
    "majority_baseline": (majority_baseline, f"WITH {B.CL}, c AS (SELECT source, label, count(*) AS n FROM cl GROUP BY 1, 2), m AS (SELECT source, label AS pred, row_number() OVER (PARTITION BY source ORDER BY n DESC, label) AS k FROM c) SELECT lang, round(avg(CAST(label = pred AS DOUBLE)), 4) AS accuracy, count(*) AS support FROM cl JOIN m USING (source) WHERE k = 1 GROUP BY 1"),
    "claim_issues": (claim_issues, f"WITH {_TXT} SELECT doc_id, coalesce(array_to_string(list_sort(rules), ','), '') AS rules FROM iss"),
    "quality_score": (quality_score, f"WITH {_TXT} SELECT doc_id, quality, bucket FROM bk"),
    "issue_summary": (issue_summary, f"WITH {_TXT} SELECT rule, 'quality' AS category, CASE WHEN rule IN ('V8', 'V15') THEN 'error' ELSE 'warning' END AS severity, count(*) AS n FROM (SELECT unnest(rules) AS rule FROM iss) GROUP BY 1"),
    "quality_buckets": (quality_buckets, f"WITH {_TXT} SELECT bucket, count(*) AS n, round(avg(quality), 4) AS avg_quality FROM bk GROUP BY 1"),
    "evidence_first_seen": (evidence_first_seen, f"WITH {B.CL} SELECT min(doc_id) AS doc_id, lang FROM cl WHERE trim(coalesce(text, '')) <> '' AND NOT regexp_matches(text, '(?i)\\bthe described (element|substance|compound|entity|object|material|item)\\b') AND lower(trim(text)) <> 'no sensor evidence found for this object type.' GROUP BY lang, lower(trim(text))"),
    "text_outliers": (text_outliers, f"WITH {B.CL} SELECT lang, count(*) FILTER (len({_WORDS.format(x='text')}) > 200) AS n_long, count(*) AS n FROM cl GROUP BY 1"),
    "claim_search": (claim_search, f"WITH {B.CL} SELECT doc_id, source, CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '…' ELSE text END AS start FROM cl WHERE contains(lower(text), 'the') AND lang = 'en' AND label = 'supported' AND source LIKE 'src1%' ORDER BY doc_id LIMIT 50"),
    "seeded_sample": (seeded_sample, f"WITH {B.CL} SELECT doc_id, label FROM cl ORDER BY {_MD5.format(k='doc_id')}, doc_id LIMIT 100"),
    "pick_one": (pick_one, f"WITH {B.CL} SELECT arg_min(doc_id, {_MD5.format(k='doc_id')}) AS doc_id, source FROM cl GROUP BY source"),
    "group_split": (group_split, f"WITH {B.CL}, g AS (SELECT source, row_number() OVER (ORDER BY {_MD5.format(k='source')}, source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM cl)) SELECT doc_id, source, CASE WHEN r <= greatest(1, floor(n * 0.8::DOUBLE)) THEN 'train' WHEN r <= greatest(1, floor(n * 0.8::DOUBLE)) + greatest(1, floor(n * 0.1::DOUBLE)) THEN 'dev' ELSE 'test' END AS split FROM cl JOIN g USING (source)"),
    "stratified_split": (stratified_split, f"WITH {_STRAT} SELECT doc_id, label, split FROM ss"),
    "split_distributions": (split_distributions, f"WITH {_STRAT} SELECT 'split' AS dim, split AS key, count(*) AS n FROM ss GROUP BY 2 UNION ALL SELECT 'lang', split || '/' || lang, count(*) FROM ss GROUP BY 2"),
    "apportion_plan": (apportion_plan, f"WITH {B.CL}, c AS (SELECT source, count(*) AS share FROM cl GROUP BY 1), e AS (SELECT source, share::DOUBLE / (SELECT sum(share) FROM c) * 997 AS e FROM c), r AS (SELECT source, floor(e) AS f, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, source) AS k, 997 - (SELECT sum(floor(e)) FROM e) AS rest FROM e) SELECT source, CAST(f + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS n FROM r"),
    "frequent_parts": (frequent_sources, "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20"),
    "json_gate": (event_sessions_gate, "WITH x AS (SELECT event_id, TRY_CAST(props->>'$.k' AS BIGINT) AS k FROM events) SELECT event_id, k, k IS NOT NULL AND k >= 50 AS ok FROM x"),
    "converted_claims": (converted_claims, f"WITH {_CONV} SELECT id, label, CASE i % 3 WHEN 0 THEN 'spatial_comparison' WHEN 1 THEN 'multi_hop_inference' ELSE 'testimonial_lookup' END AS strategy, array_to_string(list_sort(list_distinct(flatten(list(list_filter(string_split(types, ','), lambda w: w <> ''))))), ',') AS types, count(*) AS n FROM fi2 GROUP BY i, id, label"),
    "converted_evidence": (converted_evidence, f"WITH {_CONV} SELECT id || '-q1-a' || CAST(a AS VARCHAR) AS evidence_id, modality, stance, source_id, inference_strength, types, text FROM fi2"),
    "schema_gate": (schema_gate, f"WITH {_CONV} SELECT 'kept' AS what, count(DISTINCT id) AS n FROM fi2"),
    "answer_text": (answer_text, f"WITH {_CONV} SELECT id || '-q1-a' || CAST(a AS VARCHAR) AS evidence_id, substr(text, 29) AS answer FROM fi2"),
    "ntriples": (ntriples, f"SELECT '<{B.BASE}/entities/nation_' || CAST(n_nationkey AS VARCHAR) || '> <{B.BASE}/relations/name> \"' || n_name || '\" .' AS line FROM nation"),
    "embedding_cache": (embedding_cache, f"WITH {B.CL}, h AS (SELECT DISTINCT text FROM cl WHERE doc_id % 3 = 0) SELECT 'hits' AS what, count(*) AS n FROM cl WHERE text IN (SELECT text FROM h) UNION ALL SELECT 'misses', count(DISTINCT text) FROM cl WHERE text NOT IN (SELECT text FROM h)"),
}
