"""Encoders, heads, searches and pair scorers against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.operators import encoder as C
from corroborate.operators import heads as H
from corroborate.operators import models as O
from corroborate.operators import pairs as P


def loop(nodes, edges, encoder):
    """One claim's nodes {(type, i): features} and edges [(kind, src, dst)], node by node."""
    elu = lambda v: np.where(v > 0, v, np.exp(np.minimum(v, 0)) - 1)
    x = {n: elu(np.array(f) @ encoder.inputs[n[0]][0] + encoder.inputs[n[0]][1]) for n, f in nodes.items()}
    width = encoder.hidden // encoder.heads
    for weights in encoder.layers:
        after = {}
        for (kind, i), v in x.items():
            total, reached = np.zeros(encoder.hidden), False
            for name in {e[0] for e in edges}:
                source, target = C.EDGE_KINDS[name]
                if target != kind:
                    continue
                w, reached = weights[name], True
                total = total + w.bias
                mine = [src for k, src, dst in edges if k == name and dst == i and (source, src) in x]
                if not mine:
                    continue
                for h in range(encoder.heads):
                    own = slice(h * width, (h + 1) * width)
                    z = [(x[source, s] @ w.source)[own] for s in mine]
                    raw = np.array([zs @ w.att_source[own] + (v @ w.target)[own] @ w.att_target[own] for zs in z])
                    logit = np.where(raw > 0, raw, 0.2 * raw)
                    share = np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum()
                    total[own] += sum(a * zs for a, zs in zip(share, z, strict=True))
            after[kind, i] = v + (elu(total) if reached else 0)
        x = after
    return x


def with_biases(encoder, rng):
    layers = tuple({k: w._replace(bias=rng.normal(size=encoder.hidden), source=w.source * 4) for k, w in layer.items()} for layer in encoder.layers)
    return encoder._replace(layers=layers, inputs={k: (w, rng.normal(size=encoder.hidden)) for k, (w, _) in encoder.inputs.items()})


def test_encoder_matches_a_loop(spark):
    rng = np.random.default_rng(6)
    encoder = with_biases(C.seeded_encoder({"claim": 2, "evidence": 3, "triple": 1}, 8, heads=4, layers=2, seed=1), rng)
    claims = {}
    for c, (n_evidence, n_triples) in enumerate([(3, 2), (1, 0), (0, 0), (6, 3), (40, 0)]):
        nodes = {("claim", 0): rng.normal(size=2)} | {("evidence", i): rng.normal(size=3) for i in range(n_evidence)} | {("triple", t): rng.normal(size=1) for t in range(n_triples)}
        edges = [e for i in range(n_evidence) for e in (("has_evidence", 0, i), ("connected_to", i, 0))]
        edges += [("co_evidence", i, j) for i in range(n_evidence) for j in range(max(0, i - 2), min(n_evidence, i + 3)) if i != j]
        edges += [("has_triple", 0, t) for t in range(n_triples)] + [("from_triple", int(rng.integers(n_evidence)), 0) for _ in range(n_triples)] * 2  # twice: counts twice
        claims[f"c{c}"] = nodes, edges + [("has_evidence", 0, 99)] * bool(n_evidence)  # to a node that isn't there
    rows = [(c, kind, i, [float(v) for v in f]) for c, (nodes, _) in claims.items() for (kind, i), f in nodes.items()]
    node_table = spark.createDataFrame([*rows, ("c0", "source", 0, [1.0])], "claim_id string, type string, i long, x array<double>")
    edge_table = spark.createDataFrame([(c, *e) for c, (_, edges) in claims.items() for e in edges], "claim_id string, kind string, src long, dst long")
    found = {(r.claim_id, r.type, r.i): r.x for r in C.encode(node_table, edge_table, encoder).collect()}
    assert len(found) == len(rows)
    for c, (nodes, edges) in claims.items():
        for (kind, i), want in loop(nodes, [e for e in edges if e[2] != 99], encoder).items():
            assert np.allclose(found[c, kind, i], want, atol=1e-9), (c, kind, i)
    assert C.encode(node_table.limit(0), edge_table, encoder).collect() == []
    alone = {(r.claim_id, r.type, r.i): r.x for r in C.encode(node_table, edge_table.limit(0), encoder).collect()}
    assert np.allclose(alone["c2", "claim", 0], found["c2", "claim", 0])


def test_large_logits_and_weights_as_a_table(spark):
    made = C.seeded_encoder({"claim": 1, "evidence": 1}, 4, heads=2, seed=3)
    big = made._replace(layers=tuple({k: w._replace(att_source=w.att_source * 1e4) for k, w in layer.items()} for layer in made.layers))
    table = C.weight_table(spark, big)
    again = C.encoder_from(table)
    assert again.heads == 2 and again.hidden == 4 and all(np.array_equal(x, y) for a, b in zip(big.layers, again.layers, strict=True) for k in a for x, y in zip(a[k], b[k], strict=True))
    nodes = {("claim", 0): [1.0], ("evidence", 0): [2.0], ("evidence", 1): [-3.0]}
    edges = [("connected_to", 0, 0), ("connected_to", 1, 0)]
    rows = spark.createDataFrame([("c", k, i, f) for (k, i), f in nodes.items()], "claim_id string, type string, i long, x array<double>")
    found = {(r.type, r.i): r.x for r in C.encode(rows, spark.createDataFrame([("c", *e) for e in edges], "claim_id string, kind string, src long, dst long"), again).collect()}
    for n, want in loop(nodes, edges, big).items():
        assert np.all(np.isfinite(found[n])) and np.allclose(found[n], want)
    with pytest.raises(ValueError, match="heads"):
        C.seeded_encoder({"claim": 1}, 6, heads=4)


# heads (N7, N10) and search


def made_rows(spark, n=400, size=5, parts=3, seed=0):
    """Items whose stance and strength follow from their features, mostly."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    stance = np.argmax(x[:, :3] + 0.3 * rng.normal(size=(n, 3)), axis=1)
    strength = 1 / (1 + np.exp(-x[:, 3]))
    rows = [(f"k{i}", [float(v) for v in x[i]], int(stance[i]), float(strength[i]), bool(i % 5 == 0)) for i in range(n)]
    items = spark.createDataFrame(rows, "key string, x array<double>, s int, y double, out boolean")
    return H.training_rows(items, "key", "x", "s", "y", F.col("out"), parts), rows


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(1)
    x, stance, strength, weights = rng.normal(size=(30, 4)), rng.integers(0, 3, 30), rng.uniform(size=30), np.array([0.5, 2.0, 1.0])
    none = np.zeros(30, bool)
    for hidden in (0, 6):
        flat = H.initial(4, H.Settings(hidden=hidden, seed=5)) + 0.01
        half = sum(int(np.prod(s)) for s in H._shapes(4, hidden)[: len(H._shapes(4, hidden)) // 2])
        got = H.sums(x, stance, strength, none, weights, flat, hidden)[H.LOSSES :]
        for k in range(len(flat)):
            up, down = (H.sums(x, stance, strength, none, weights, flat + e * np.eye(len(flat))[k], hidden) for e in (1e-6, -1e-6))
            at = 2 if k < half else 3  # cross entropy or squared error
            assert abs(got[k] - (up[at] - down[at]) / 2e-6) < 1e-4


def plain_training(rows, settings, weights):
    """Both heads of one layer, in one array, with Adam, plateau and early stop written out."""
    x, s, y, out = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
    flat = H.initial(x.shape[1], settings)
    size = x.shape[1]
    m = v = np.zeros_like(flat)
    rate, best, bad, waited, history = settings.lr, np.inf, 0, 0, []

    def loss(flat, side):
        w1, b1, w2, b2 = flat[: 3 * size].reshape(size, 3), flat[3 * size : 3 * size + 3], flat[3 * size + 3 : 4 * size + 3], flat[4 * size + 3]
        z = x[side] @ w1 + b1
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        t = 1 / (1 + np.exp(-(x[side] @ w2 + b2)))
        w = weights[s[side]]
        ce, se = (w * -np.log(p[np.arange(len(p)), s[side]])).sum() / w.sum(), ((t - y[side]) ** 2).mean()
        d = w[:, None] * (p - np.eye(3)[s[side]]) / w.sum()
        e = settings.strength_weight * 2 * (t - y[side]) * t * (1 - t) / len(t)
        return ce + settings.strength_weight * se, np.concatenate([(x[side].T @ d).ravel(), d.sum(0), x[side].T @ e, [e.sum()]])

    for step in range(1, settings.epochs + 1):
        g = loss(flat, ~out)[1] + settings.weight_decay * flat
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        val = loss(flat, out)[0]
        history.append((step, rate, loss(flat, ~out)[0], val))
        bad, waited, best = (0, 0, val) if val < best else (bad + 1, waited + 1, best)
        if bad > settings.plateau:
            rate, bad = rate * settings.factor, 0
        if waited >= settings.patience:
            break
    return flat, history


def test_training_equals_a_plain_loop(spark):
    rows, plain = made_rows(spark)
    settings = H.Settings(hidden=0, lr=0.3, epochs=40, patience=4, plateau=1)
    weights = H.class_weights(rows)
    counts = np.bincount([r[2] for r in plain if not r[4]], minlength=3)
    assert np.allclose(weights, counts.sum() / (3 * counts))
    run = H.fit_heads(rows, settings)
    flat, history = plain_training(plain, settings, weights)
    assert [e.epoch for e in run.history] == [h[0] for h in history] and np.allclose(run.flat, flat, atol=1e-8)
    assert np.allclose([(e.lr, e.train_loss, e.val_loss) for e in run.history], [h[1:] for h in history], atol=1e-8)
    again = H.fit_heads(rows, settings)
    assert np.array_equal(run.flat, again.flat) and run.history == again.history  # reruns agree to the last bit
    many, _ = made_rows(spark, parts=9)
    assert np.allclose(H.fit_heads(many, settings).flat, run.flat, atol=1e-7)


def test_heads_learn_and_apply(spark):
    rows, plain = made_rows(spark)
    run = H.fit_heads(rows, H.Settings(hidden=8, lr=0.05, epochs=40, patience=40, strength_weight=4.0))
    assert run.best_accuracy > 0.75 and run.history[-1].val_strength < 0.03 and run.history[-1].train_loss < run.history[0].train_loss
    table = O.best_epochs(H.history_table(spark, {"m": run}))
    assert table.count() == len(run.history) and table.where("best > val_loss").isEmpty()
    run.best = None  # the last model, not the most accurate one
    odd = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 0.0], 1), ("b", None, 2), ("c", [0.0, 3.0, 0.0, 5.0, 0.0], 3)], "key string, x array<double>, extra int")
    found = {r.key: r for r in H.apply_heads(odd, run).collect()}
    assert found["b"].p is None and found["b"].stance_pred is None and abs(sum(found["a"].p) - 1) < 1e-9
    assert found["c"].stance_pred == 1 and found["c"].strength_pred > 0.7 and found["c"].extra == 3
    bad = spark.createDataFrame([("a", None, 1, 0.5), ("b", [1.0], 7, 0.5), ("c", [1.0], 1, None)], "key string, x array<double>, s int, y double")
    none = H.training_rows(bad, "key", "x", "s", "y", F.lit(None).cast("boolean"))
    assert none.isEmpty()
    with pytest.raises(ValueError, match="no rows"):
        H.fit_heads(none)


def test_search_prunes_and_repeats(spark):
    rows, _ = made_rows(spark, n=200)
    options = {"n_trials": 7, "waves": 2, "base": H.Settings(epochs=8), "rungs": (2, 4)}
    trials = H.search(rows, **options)
    assert len(trials) == 7 and [t.wave for t in trials] == [0] * 3 + [1] * 4
    table = H.trial_table(spark, trials)
    states = {r.state: r["count"] for r in table.groupBy("state").count().collect()}
    assert states.get("pruned", 0) >= 2 and sum(n for s, n in states.items() if s != "pruned") >= 1
    pruned = [t for t in trials if t.run.state == "pruned"]
    assert all(len(t.run.history) in (2, 4) for t in pruned)
    first = [min(e.val_stance for e in t.run.history[:2]) for t in trials[:3]]
    assert all((x > np.median(first)) == (len(t.run.history) == 2) for x, t in zip(first, trials[:3], strict=True))
    assert table.where("is_best and state <> 'pruned'").count() == 1
    again = H.trial_table(spark, H.search(rows, **options))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.collect()))
    other = H.search(rows, **options, seed=7)
    assert [t.run.settings for t in other] != [t.run.settings for t in trials]


# pairs (N5)


def test_pair_features_and_scorers(spark):
    rows = [
        ("a", "The cup weighs 5 kg.", "The cup weighs 5 kg.", "entailment"), ("b", "The cup is red", "Question: colour? Answer: the cup is not red at all", "contradiction"),
        ("c", "It has 7 doors", "It has 9 doors", "contradiction"), ("d", "", None, "neutral"), ("e", None, "words only here", "neutral"), ("f", "Ärger überall", "ärger ÜBERALL!", "entailment"),
    ]
    items = spark.createDataFrame([(*r, 0.5) for r in rows], "claim_id string, claim string, evidence string, label string, confidence double")
    x = {r.claim_id: r.x for r in items.select("claim_id", P.alignment(F.col("claim"), F.col("evidence")).alias("x")).collect()}
    assert x["a"] == [1, 1, 1, 1, 0, 1, 0, 1] and x["f"][:4] == [1, 1, 1, 1] and x["d"] == [0, 0, 0, 0, 0, 1, 0, 0]
    assert x["b"] == [4 / 7, 1, 4 / 7, 2 / 3, 1, 1, 0, 4 / 7] and x["c"][5:7] == [0, 1] and x["c"][3] == 1 / 3
    scored = {r.claim_id: r.p for r in P.by_weights()(items).collect()}
    assert all(abs(sum(p) - 1) < 1e-12 for p in scored.values())
    assert [P.LABELS[int(np.argmax(scored[r[0]]))] for r in rows] == [r[3] for r in rows]
    scores = {r.claim_id: r for r in P.paired_scores(items, P.by_weights()).collect()}
    assert scores["a"].support > 0.4 > scores["a"].refute and abs(scores["a"].support - 0.5 * scored["a"][1]) < 1e-12 and scores["c"].refute > scores["c"].support


def test_fitted_pairs_plug_in(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(240):
        claim = rng.choice(words, 8, replace=False)
        kind = P.LABELS[i % 3]
        evidence = rng.choice(words, 8, replace=False) if kind == "neutral" else claim if kind == "entailment" else ["not", *claim]
        rows.append((f"c{i}", " ".join(claim), " ".join(evidence), kind if i else None, 0.5))
    items = spark.createDataFrame(rows, "claim_id string, claim string, evidence string, label string, confidence double")
    run = P.fit_pairs(items, "label", "claim_id", F.pmod(F.xxhash64("claim_id"), F.lit(4)) == 0)
    assert run.best_accuracy > 0.9
    scored = P.by_model(run)(items)
    assert scored.columns == [*items.columns, "p"] and P.paired_scores(items, P.by_model(run)).count() == 240
