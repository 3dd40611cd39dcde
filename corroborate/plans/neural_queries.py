"""Queries over encoders, heads, searches and pair scorers, with SQL where SQL can say them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corroborate.functions import vocab as V
from corroborate.operators import encoder as C
from corroborate.operators import graph as N
from corroborate.operators import heads as H
from corroborate.operators import models as O
from corroborate.operators import pairs as P
from corroborate.plans import bindings as B
from corroborate.plans import triple_queries as TQ
from corroborate.plans.evidence_queries import _items

#: The queries' encoder: features by kind of node, hidden size, heads.
SIZES, HIDDEN, HEADS = {"claim": 2, "evidence": 3, "triple": 2}, 4, 2


def _nodes(spark, d):
    """Claims, turns and triple texts with a few numbers as features."""
    items, claim, ev = TQ._turn_parts(spark, d)
    x = lambda *c: F.array(*(v.cast("double") for v in c)).alias("x")
    claims = items.groupBy("claim_id").agg(F.count("*").alias("n")).select("claim_id", F.lit("claim").alias("type"), F.lit(0).cast("long").alias("i"), x(F.col("n") / 8, F.lit(1)))
    turns = items.select("claim_id", F.lit("evidence").alias("type"), F.col("i").cast("long").alias("i"), x(F.length("text") / 500, F.col("i") / 4, F.col("role") == "user"))
    texts = N.triple_index(claim, ev).select("claim_id", F.lit("triple").alias("type"), F.col("t").alias("i"), x(F.length("text") / 500, F.col("t") / 8))
    return claims.unionByName(turns).unionByName(texts)


def graph_encoder(spark, d):
    """Two layers over the five kinds of edges; the hidden numbers of every node."""
    made = C.encode(_nodes(spark, d), TQ.graph_edges(spark, d), C.seeded_encoder(SIZES, HIDDEN, HEADS))
    return made.select("claim_id", "type", "i", *(F.round(F.col("x")[j], 5).alias(f"x{j}") for j in range(HIDDEN)))


def _table(name: str, columns: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in row) + ")" for row in rows)
    return f"{name} AS (SELECT * FROM (VALUES {values}) t({columns}))"


def _encoder_sql() -> str:
    """The encoder in long form: a row per node and number, products as joins with weight tables."""
    made = C.seeded_encoder(SIZES, HIDDEN, HEADS)
    square = lambda m: [(i, j, float(m[i, j])) for i, j in np.ndindex(m.shape)]
    parts = [
        TQ._ED,
        "feat AS (SELECT claim_id, 'claim' AS type, 0 AS i, [count(*) / 8, 1.0] AS x FROM tn GROUP BY 1 UNION ALL SELECT claim_id, 'evidence', i, [length(text) / 500, i / 4, CAST(role = 'user' AS INTEGER)] FROM tn UNION ALL SELECT claim_id, 'triple', t, [length(text) / 500, t / 8] FROM ix)",
        "f0 AS (SELECT claim_id, type, i, unnest(range(len(x))) AS k, CAST(unnest(x) AS DOUBLE) AS v FROM feat)",
        _table("wi", "type, k, j, w", [(kind, *row) for kind, (w, _) in made.inputs.items() for row in square(w)]),
        "x0 AS (SELECT claim_id, type, i, j, CASE WHEN s > 0 THEN s ELSE exp(s) - 1 END AS v FROM (SELECT claim_id, type, i, j, sum(v * w) AS s FROM f0 JOIN wi USING (type, k) GROUP BY ALL))",
        _table("ek", "kind, st, tt", [(k, s, t) for k, (s, t) in C.EDGE_KINDS.items()]),
        "has AS (SELECT DISTINCT claim_id, tt AS type FROM ed JOIN ek USING (kind))",
    ]
    for n, layer in enumerate(made.layers):
        dim = HIDDEN // HEADS
        parts += [
            _table(f"ws{n}", "kind, k, j, w", [(kind, *row) for kind, w in layer.items() for row in square(w.source)]),
            _table(f"wt{n}", "kind, k, j, w", [(kind, *row) for kind, w in layer.items() for row in square(w.target)]),
            _table(f"aa{n}", "kind, j, s, t", [(kind, j, float(w.att_source[j]), float(w.att_target[j])) for kind, w in layer.items() for j in range(HIDDEN)]),
            f"z{n} AS (SELECT claim_id, kind, i AS src, j, sum(v * w) AS z FROM (SELECT claim_id, type, i, j AS k, v FROM x{n}) JOIN ek ON st = type JOIN ws{n} USING (kind, k) GROUP BY ALL)",
            f"y{n} AS (SELECT claim_id, kind, i AS dst, j, sum(v * w) AS y FROM (SELECT claim_id, type, i, j AS k, v FROM x{n}) JOIN ek ON tt = type JOIN wt{n} USING (kind, k) GROUP BY ALL)",
            f"a{n} AS (SELECT claim_id, kind, src, j // {dim} AS h, sum(z * s) AS a FROM z{n} JOIN aa{n} USING (kind, j) GROUP BY ALL)",
            f"b{n} AS (SELECT claim_id, kind, dst, j // {dim} AS h, sum(y * t) AS b FROM y{n} JOIN aa{n} USING (kind, j) GROUP BY ALL)",
            f"e{n} AS (SELECT claim_id, kind, src, dst, h, exp(CASE WHEN a + b > 0 THEN a + b ELSE 0.2::DOUBLE * (a + b) END) AS e FROM ed JOIN a{n} USING (claim_id, kind, src) JOIN b{n} USING (claim_id, kind, dst, h))",
            f"m{n} AS (SELECT claim_id, kind, dst, j, sum(e * z) / sum(e) AS m FROM e{n} JOIN z{n} USING (claim_id, kind, src) WHERE j // {dim} = h GROUP BY ALL)",
            f"u{n} AS (SELECT claim_id, tt AS type, dst AS i, j, sum(m) AS m FROM m{n} JOIN ek USING (kind) GROUP BY ALL)",
            f"x{n + 1} AS (SELECT x.claim_id, x.type, x.i, x.j, x.v + CASE WHEN has.type IS NULL THEN 0.0 WHEN coalesce(m, 0) > 0 THEN m ELSE exp(coalesce(m, 0)) - 1 END AS v FROM x{n} x LEFT JOIN u{n} u USING (claim_id, type, i, j) LEFT JOIN has USING (claim_id, type))",
        ]
    columns = ", ".join(f"round(sum(v) FILTER (j = {j}), 5) AS x{j}" for j in range(HIDDEN))
    return f"WITH {', '.join(parts)} SELECT claim_id, type, CAST(i AS BIGINT) AS i, {columns} FROM x{len(made.layers)} GROUP BY ALL"


def _training_rows(spark, d):
    """Evidence items with their modality, types, trust and value; a tenth of the claims is held out."""
    items = _items(spark, d).join(B.table(spark, d, "events").select("event_id", "value"), "event_id")
    numbers = F.array(F.col("source_trust"), F.least(F.col("value") / 100, F.lit(1.0)), F.col("weight"))
    x = F.concat(V.one_hot(F.col("modality"), V.ENCODED_MODALITIES, "unknown"), V.multi_hot(F.col("evidence_types"), V.TRAINING_TYPES), numbers)
    stance = F.when(F.col("stance") == "supports", 0).when(F.col("stance") == "refutes", 1).otherwise(2)
    return H.training_rows(items, "claim_id", x, stance, "inference_strength", F.pmod(F.xxhash64("claim_id"), F.lit(10)) == 0)


def head_training(spark, d):
    """Both heads fitted together; each epoch with what the early stop makes of it."""
    run = H.fit_heads(_training_rows(spark, d), H.Settings(epochs=12, lr=0.05))
    return O.best_epochs(H.history_table(spark, {"heads": run}))


def head_predictions(spark, d):
    """What the fitted heads say of every item, and what is true, counted."""
    rows = _training_rows(spark, d)
    out = H.apply_heads(rows, H.fit_heads(rows, H.Settings(epochs=12, lr=0.05)))
    return out.groupBy("stance", "stance_pred").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("strength") - F.col("strength_pred"))), 4).alias("strength_error"))


def hparam_trials(spark, d):
    """A search of nine trials in three waves, with those that were pruned."""
    return H.trial_table(spark, H.search(_training_rows(spark, d), 9, 3, base=H.Settings(epochs=6), rungs=(2, 4)))


def _text_pairs(spark, d):
    """The first turn of a conversation as a claim, the others as evidence of it; some as question and answer."""
    t = B.turns(spark, d)
    first = t.where("ord = 0").select("claim_id", F.col("text").alias("claim"))
    asked = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("Question: is it so? Answer: "), "text")).otherwise(F.col("text"))
    return t.where("ord > 0").join(first, "claim_id").select("claim_id", "ord", "claim", asked.alias("evidence"), F.round(F.least(F.length("text") / 400, F.lit(1.0)) * 0.8, 4).alias("confidence"))


def pair_scores(spark, d):
    scored = P.by_weights()(_text_pairs(spark, d))
    x = P.alignment(F.col("claim"), F.col("evidence"))
    return scored.withColumn("x", x).select("claim_id", "ord", *(F.round(F.col("x")[i], 6).alias(n) for i, n in enumerate(P.FEATURES)), *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(P.LABELS)))


def paired_soft_scores(spark, d):
    s = P.paired_scores(_text_pairs(spark, d), P.by_weights())
    return s.select("claim_id", *(F.round(c, 6).alias(c) for c in ("support", "refute", "nei")))


def pair_training(spark, d):
    """A model that tells turns of the same conversation from those of the next one, by epoch."""
    t = _text_pairs(spark, d)
    n = F.regexp_extract(F.col("claim_id").cast("string"), r"(\d+)$", 1).cast("long")
    claims = B.turns(spark, d).where("ord = 0").select((F.regexp_extract(F.col("claim_id").cast("string"), r"(\d+)$", 1).cast("long") + 1).alias("n"), F.col("text").alias("other"))
    both = t.withColumn("label", F.lit("entailment")).unionByName(t.withColumn("n", n).join(claims, "n").drop("n", "claim").withColumnRenamed("other", "claim").withColumn("label", F.lit("neutral")))
    run = P.fit_pairs(both, "label", "claim_id", F.pmod(F.xxhash64("claim_id"), F.lit(5)) == 0, settings=H.Settings(hidden=0, lr=0.1, epochs=10, strength_weight=0.0))
    return H.history_table(spark, {"pairs": run})


def _pairs_sql() -> str:
    weights = [" + ".join([f"{w}::DOUBLE * x[{i + 1}]" for i, w in enumerate(row[:-1])] + [f"{row[-1]}::DOUBLE"]) for row in P.WEIGHTS]
    odd = lambda w: f"len([x FOR x IN {w} IF x IN ({', '.join(repr(n) for n in P.NEGATIONS)})]) % 2"
    words = "[w FOR w IN string_split_regex(lower({t}), '[^\\p{{L}}\\p{{N}}]+') IF w <> '']"
    following = lambda w: f"list_distinct([{w}[i] || ' ' || {w}[i + 1] FOR i IN range(1, len({w}))])"
    share = lambda some, of: f"CASE WHEN len({of}) = 0 THEN 0.0 ELSE len(list_intersect({of}, {some})) / len({of}) END"
    return f"""{B.TURN}, said AS (SELECT claim_id, ord, text, CASE WHEN ord % 3 = 0 THEN 'Question: is it so? Answer: ' || text ELSE text END AS ev FROM tn WHERE ord > 0),
tp AS (SELECT s.*, f.text AS claim, trim(regexp_extract(ev, '(?is)answer\\s*:\\s*(.*)$', 1)) AS answer FROM said s JOIN tn f ON f.claim_id = s.claim_id AND f.ord = 0),
wd AS (SELECT claim_id, ord, text, {words.format(t="claim")} AS cw, {words.format(t="CASE WHEN length(answer) >= 15 THEN answer ELSE ev END")} AS ew FROM tp),
st AS (SELECT *, list_distinct(cw) AS c, list_distinct(ew) AS e, {following("cw")} AS cp, {following("ew")} AS ep FROM wd),
nu AS (SELECT *, [w FOR w IN c IF regexp_full_match(w, '[0-9]+')] AS cn, [w FOR w IN e IF regexp_full_match(w, '[0-9]+')] AS en FROM st),
ft AS (SELECT claim_id, ord, text, [CASE WHEN len(list_distinct(c || e)) = 0 THEN 0.0 ELSE len(list_intersect(c, e)) / len(list_distinct(c || e)) END, {share("e", "c")}, {share("c", "e")}, {share("ep", "cp")},
  CAST({odd("cw")} <> {odd("ew")} AS INTEGER), CASE WHEN len(cn) = 0 THEN 1.0 ELSE {share("en", "cn")} END, CAST(len(cn) > 0 AND len(en) > 0 AND NOT list_has_any(cn, en) AS INTEGER),
  CASE WHEN greatest(len(cw), len(ew)) = 0 THEN 0.0 ELSE least(len(cw), len(ew)) / greatest(len(cw), len(ew)) END]::DOUBLE[] AS x FROM nu),
lg AS (SELECT *, exp({weights[0]}) AS z0, exp({weights[1]}) AS z1, exp({weights[2]}) AS z2 FROM ft),
pb AS (SELECT claim_id, ord, text, x, z0 / (z0 + z1 + z2) AS contradiction, z1 / (z0 + z1 + z2) AS entailment, z2 / (z0 + z1 + z2) AS neutral FROM lg)"""


_PAIRS = _pairs_sql()

QUERIES = {
    "pair_scores": (pair_scores, f"WITH {_PAIRS} SELECT claim_id, ord, {', '.join(f'round(x[{i + 1}], 6) AS {n}' for i, n in enumerate(P.FEATURES))}, {', '.join(f'round({n}, 6) AS {n}' for n in P.LABELS)} FROM pb"),
    "paired_soft_scores": (paired_soft_scores, f"WITH {_PAIRS}, cf AS (SELECT *, round(least(length(text) / 400, 1.0) * 0.8::DOUBLE, 4) AS confidence FROM pb), sc AS (SELECT claim_id, 1 - product(1 - confidence * entailment) AS s, 1 - product(1 - confidence * contradiction) AS r FROM cf GROUP BY 1) SELECT claim_id, round(s, 6) AS support, round(r, 6) AS refute, round(1 - greatest(s, r), 6) AS nei FROM sc"),
    "pair_training": (pair_training, None),
    "head_training": (head_training, None),
    "head_predictions": (head_predictions, None),
    "hparam_trials": (hparam_trials, None),
    "graph_encoder": (graph_encoder, _encoder_sql()),
}
