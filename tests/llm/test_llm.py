"""The operators of corroborate.llm against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corroborate.llm import (
    bpe, components, exact_dedup, html_text, license_scan, quality_classifier, quality_rules, secret_scan, simhash, source_mix, text_stats, toxicity,
)

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


# 7: exact dedup


@pytest.mark.parametrize("hash128", [F.md5, lambda c: F.lit("the same for all")])
def test_exact_dedup(docs_of, hash128):
    texts = ["a b", "a  b", "a\tb", "b", None, "", " ", "c d", "c d", "B"]
    found = by_id(exact_dedup.exact_dedup(docs_of(texts), hash128=hash128))
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        r = found[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (same[0], len(same), i == same[0], hashlib.sha256(t.encode()).hexdigest())


def test_drop_copies(docs_of, spark):
    docs = docs_of(["x y", "x  y", "z"])
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs).collect()) == [0, 2]
    nulls = spark.createDataFrame([(None, "q"), (3, "q"), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in exact_dedup.drop_copies(nulls).collect()) == [(-1, "alone"), (3, "q")]


# 4: SimHash


def brute_fingerprint(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, radius=3):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("hot", [4096, 4])
def test_simhash(docs_of, monkeypatch, hot):
    """Also where shards are hot and are cut by finer keys."""
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(1)
    words = [f"Wörd{i}" for i in range(50)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(8)]
    for t in list(texts):
        w = t.split()
        for _ in range(4):
            w[rng.randrange(120)] = "changed"
            texts.append(" ".join(w))
    texts += [None, "", "two words", "TWO  words", "one"]
    found = by_id(simhash.near_duplicates(docs_of(texts)))
    fps = [brute_fingerprint(t) for t in texts]
    assert [found[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [found[i].component_id for i in range(len(texts))] == brute_components(fps)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs_of(texts)).collect()}
    assert kept == set(brute_components(fps))


def brute_jaccard(texts):
    """Jaccard similarity of the sets of 5-word shingles of each pair."""
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    return {(i, j): len(a & b) / len(a | b) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])}


@pytest.mark.parametrize("hot", [4096, 6])
def test_similar_documents(docs_of, monkeypatch, hot):
    """Pairs of 0.8 and more are in one component, pairs under 0.8 only by way of others; also with hot shards."""
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(21)
    texts = []
    for _ in range(25):
        w = rng.choices([f"word{i}" for i in range(5000)], k=rng.randint(60, 400))
        for edits in (0, 1, 2, 3, len(w) // 10, len(w) // 4):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = f"other{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    shared = " ".join(f"boiler{i}" for i in range(55))  # a passage that many texts share is no reason to link them
    texts += [shared + " " + " ".join(f"own{k}x{i}" for i in range(120)) for k in range(20)]
    texts += [None, "", "  ", "One two", "one  TWO", "one"]
    docs = docs_of(texts)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    near = brute_jaccard(texts)
    linked = [got[i] == got[j] for (i, j), x in near.items() if x >= 0.8]
    assert len(linked) > 100 and np.mean(linked) > 0.99
    label = list(range(len(texts)))
    for (i, j), x in sorted(near.items()):
        if x >= 0.8 and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if y == b else y for y in label]
    assert all(label[i] == label[got[i]] for i in range(len(texts)))
    assert {r.doc_id for r in simhash.drop_similar(docs).collect()} == set(got.values())


def test_similarity_of_hashes():
    """Exact at any size, but for shingles with equal 32-bit hashes."""
    rng = random.Random(8)
    for n, near in ((300, 1e-12), (20_000, 1e-4)):
        w = rng.choices([f"word{i}" for i in range(50_000)], k=n)
        v = list(w)
        for at in rng.sample(range(n), n // 45):
            v[at] = "other"
        want = brute_jaccard([" ".join(w), " ".join(v)])[0, 1]
        a, b = (simhash.hash_set(" ".join(x).encode()) for x in (w, v))
        assert 0.7 < want < 0.9 and abs(simhash.similarity(a, b) - want) < near and simhash.similarity(a, a) == 1
    assert simhash.similarity(a, simhash.hash_set(b"one two")) == simhash.similarity(simhash.hash_set(b""), a) == 0


def test_shingles_decide_every_pair():
    """Links inside a shard are those of brute force, whatever a pair's fingerprints say."""
    rng = np.random.default_rng(9)
    shard, fp = np.sort(rng.integers(0, 3, 60)), np.zeros((60, 8), np.uint64)
    yes = rng.random((60, 60)) < 0.03
    yes |= yes.T
    label = list(range(60))
    for i, j in zip(*np.nonzero(yes & (shard[:, None] == shard)), strict=True):
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    assert simhash.local_roots(fp, shard, simhash.SIMILAR_RADIUS, lambda a, b: yes[a, b]).tolist() == label


def test_wide_trees_find_all_neighbours():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, (12, 2), dtype=np.uint64).repeat(12, axis=0)
    fp ^= np.uint64(1) << rng.integers(0, 64, fp.shape, dtype=np.uint64)
    shard = np.sort(rng.integers(0, 2, len(fp)))
    roots, key, child = simhash.build_forest(fp, shard)
    got = {p for q, m in simhash.search(fp, np.arange(len(fp)), roots[shard], key, child, 5) for p in zip(q.tolist(), m.tolist(), strict=True)}
    bits = lambda i, j: sum(bin(int(a ^ b)).count("1") for a, b in zip(fp[i], fp[j], strict=True))
    assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if shard[i] == shard[j] and bits(i, j) <= 5}


def test_finer_keys_keep_every_link(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        rows += [(i, v - (1 << 64) if v >> 63 else v) for v in (x, y)]
    df = spark.createDataFrame(rows, "pair int, fp long").select("pair", "fp", F.explode(F.array(*simhash.shard_keys(1))).alias("s")).select("pair", "fp", "s.t")
    df = df.select("pair", F.explode(simhash.finer_keys(1)).alias("s"))
    assert df.groupBy("pair", "s.t", "s.k").count().where("count > 1").select("pair").distinct().count() == 300


@pytest.mark.parametrize("n", [1, 1 << 26, 1 << 36, 1 << 45])
def test_shard_keys_keep_every_link(spark, n):
    """Any two fingerprints within the radius share a key, whatever the number of fingerprints."""
    rng = random.Random(n)
    rows = []
    for i in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        rows += [(i, x - (1 << 64) if x >> 63 else x), (i, y - (1 << 64) if y >> 63 else y)]
    df = spark.createDataFrame(rows, "pair int, fp long").select("pair", F.explode(F.array(*simhash.shard_keys(n))).alias("s"))
    assert df.groupBy("pair", "s.t", "s.k").count().where("count > 1").select("pair").distinct().count() == 300


def test_trees_find_all_neighbours():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fp = np.unique(np.concatenate([centres ^ (np.uint64(1) << rng.integers(0, 64, 20, dtype=np.uint64)) for _ in range(30)]))
    shard = np.sort(rng.integers(0, 3, len(fp)))
    roots, key, child = simhash.build_forest(fp, shard)
    got = set()
    for q, m in simhash.search(fp, np.arange(len(fp)), roots[shard], key, child):
        got |= set(zip(q.tolist(), m.tolist(), strict=True))
    assert got == {(i, j) for i in range(len(fp)) for j in range(len(fp)) if shard[i] == shard[j] and bin(int(fp[i] ^ fp[j])).count("1") <= 3}


def test_components(spark):
    chain = [(i + 1, i) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 201)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# 9: byte-level BPE


def expected_ids(text):
    encoding, *_ = bpe._encoding(Path(bpe.public_tokenizers.path(bpe.RANKS)).read_bytes(), bpe.public_tokenizers.PATTERN)
    return np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()


TEXTS = ["", None, "a b", "don't  'll x\n\n y " * 100, "z" * 3000 + " end", " " * 1500 + "x", "äöü 123 日本語テキスト🙂 " * 120, "\r\n\t " * 400, "no-space" * 500, "ab " * 1000 + "q" * 900 + " cd" * 1000]


@pytest.mark.parametrize("chunk, overlap", [(256, 32), (1000, 100), (32_768, 512)])
def test_bpe(docs_of, chunk, overlap):
    encoded = bpe.encode(docs_of(TEXTS), chunk=chunk, overlap=overlap)
    found = by_id(bpe.decode(encoded))
    for i, t in enumerate(TEXTS):
        assert bytes(found[i].ids) == expected_ids(t), i
        assert bytes(found[i].decoded) == (t or "").encode(), i


def test_bpe_long_space(docs_of):
    text = "a" + " " * 50_000 + "b"
    r = by_id(bpe.decode(bpe.encode(docs_of([text]))))[0]
    assert bytes(r.decoded) == text.encode()


# 10: secrets


def brute_secrets(text):
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            found.append((m.start(), 0, m.end()))
    for k, p, n in ((1, r"AKIA[A-Z0-9]+", 16), (2, r"[0-9a-f]+", 32)):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m.group()) >= n]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_secrets(docs_of):
    rng = random.Random(4)
    parts = ["password = hunter2hunter2", "ToKeN:\"abc\"", "api_key='ABCDEFGH12'", "apikey=a.b-c_d/e+f=", "AKIA" + "A1" * 8, "AKIASHORT", "0af" * 11, "deadbeef", "secret: short", "é", "token=token=longenough1", "\n", "the words", "passwd=Kelvin12"]
    texts = [" ".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(80)] + [None, "", "x" * 100_000 + " token = 0123456789abcdef"]
    found = by_id(secret_scan.scan_secrets(docs_of(texts)))
    for i, t in enumerate(texts):
        base = [s for s in found[i].spans if s.kind != "guess"]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in base) == brute_secrets(t or "")
        assert found[i].spans == sorted(found[i].spans, key=lambda s: (s.start, secret_scan.KINDS.index(s.kind)))


def test_guess_cost():
    cost = secret_scan.guess_cost
    assert cost("password") < 1 and cost("P@ssw0rd") < 4 and cost("qwertyuiop") < 4 and cost("20240131") < 6 and cost("aaaaaaaaaa") < 3 and cost("abcdefgh") < 4
    assert cost("kR7#mQ2p!z") > 9 and cost("") == 0
    assert cost("password2024") < cost("password") + cost("2024") + 1
    spans = lambda t: secret_scan.guess_spans(t, secret_scan.base_spans(t))
    assert [(s, e) for s, _, e in spans("the passphrase is kR7#mQ2p!z ok")] == [(18, 28)]
    assert spans("the token is important and the secret: friendship") == [] and spans("password = kR7mQ2pz9x") == []


def test_long_values_are_scored():
    rng = random.Random(12)
    token = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", k=598))
    token = token[:40] + "." + token[40:500] + "." + token[500:]
    spans = lambda t: secret_scan.guess_spans(t, secret_scan.base_spans(t))
    for before in ("Authorization: Bearer ", "passphrase: ", "pwd=", "private_key="):
        assert spans(f"x {before}{token} y") == [(2 + len(before), 3, 2 + len(before) + 600)]
        for cheap in ("a" * 100_000, "qw" * 50_000, "xk7" * 10_000, "ab" * 400):
            assert spans(f"x {before}{cheap} y") == [], (before, cheap[:9])
        assert len(spans(f"x {before}{token * 100} y")) == 1


# 1: quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_counts():
    rng = random.Random(5)
    parts = ["a", "b", "é#", "c d", " ", "\n", "\t", "a b a", "<x>|", " "]
    for _ in range(150):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert text_stats.counts(text)[:5] == brute_counts(text)


def test_rules_are_learned_and_applied():
    rng = np.random.default_rng(6)
    x = {n: rng.random(900) for n in ("symbol_share", "capital_share", "repeat_share")}
    bad = (x["symbol_share"] > 0.7) | ((x["capital_share"] > 0.8) & (x["repeat_share"] < 0.5))
    rules = quality_rules.learn_rules(x, bad)
    said = np.logical_or.reduce([quality_rules._covered(r, x, 900) for r in rules])
    assert 2 <= len(rules) and (said == bad).mean() > 0.97
    assert quality_rules.learn_rules(x, np.zeros(900, bool)) == [] and quality_rules.learn_rules({k: v[:0] for k, v in x.items()}, np.zeros(0, bool)) == []


@needs_data
def test_rules_on_labels(tables):
    docs, labels = tables
    rules = quality_rules.learn_from(docs, labels)
    r = quality_rules.quality_rules(docs, rules).join(labels, "doc_id").where("not base_failed").agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("double")).alias("a")).first()
    assert r.a > 0.9


# 5: quality classifier


def test_machine_learns_interactions():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        rows.append((np.array([3, 5, 7]), np.array([a * 2.0 - 1, b * 2.0 - 1, 0.1])))
        y.append(float(a == b))
    machine = quality_classifier.fit(rows * 2, np.array(y * 2))
    right = [(machine.logit(*r) > 0) == (t > 0.5) for r, t in zip(rows, y, strict=True)]
    assert np.mean(right) > 0.95


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    m = quality_classifier.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    i, v = np.array([1, 4, 9, 12]), rng.normal(size=4)
    slow = 0.3 + m.weights[i] @ v + sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(4) for b in range(a))
    assert m.logit(i, v) == pytest.approx(slow)


@needs_data
def test_classifier(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    machine = quality_classifier.learn_from(docs, labels)
    rows = quality_classifier.score(docs, machine).join(labels, "doc_id").withColumn("held_out", quality_classifier.held_out()).where("held_out").collect()
    good, junk = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > j for g in good for j in junk]) > 0.9 and np.mean([g >= 0.7 for g in good]) > 0.9
    again = quality_classifier.learn_from(docs, labels)
    assert np.array_equal(machine.weights, again.weights)
    kept = quality_classifier.accepted(docs, machine)
    assert kept.columns == docs.columns and kept.count() == quality_classifier.score(docs, machine).where("score >= 0.7").count()


# 2: source mix


def test_targets():
    assert source_mix.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    got = source_mix.targets([10, 1000, 1000, 0])
    assert got[0] == 30 and got[3] == 0 and sum(got) == pytest.approx(2010) and got[1] / got[2] == pytest.approx(2)
    assert source_mix.targets([]) == [] and source_mix.targets([0, 0]) == [0, 0] and source_mix.targets([7]) == [7]


def test_permutations_and_draws():
    for n in (1, 2, 3, 10, 1000):
        for k in (0, -7, 123456789):
            assert sorted(source_mix.permuted(np.arange(n), np.full(n, n), np.full(n, k))) == list(range(n))
    counts = source_mix.draw_counts([1000, 10, 0, 333], shards=16)
    assert counts.sum(axis=0).tolist() == [1000, 10, 0, 333] and set(counts.sum(axis=1)) <= {83, 84} and len(set(counts[:, 0])) > 3


def test_source_mix(docs_of):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{j}" for j in range(rng.randint(0, 300))), rng.choice(["a", "b", "b", "b", None])) for i in range(400)] + [(9000, None, "a")]
    docs = docs_of(rows)
    got = by_id(source_mix.mix_sources(docs, block=16))
    assert len(got) == 401 and got[9000].size == 0 and got[9000].taken == 0
    size = {s: sum(len((t or "").split()) for _, t, x in rows if x == s) for s in ("a", "b", None)}
    want = dict(zip(("a", "b", None), source_mix.targets([size["a"], size["b"], size[None]]), strict=True))
    for s in size:
        mine = [got[i] for i, _, x in rows if x == s]
        assert {(r.source_size, r.target) for r in mine} == {(size[s], want[s])}
        assert sum(r.taken for r in mine) == pytest.approx(want[s], rel=0.02)
    assert all(r.taken <= 3 * r.size for r in got.values())
    assert {k: r.taken for k, r in by_id(source_mix.mix_sources(docs.repartition(5), block=16)).items()} == {k: r.taken for k, r in got.items()}
    mixed = source_mix.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {k: r.taken for k, r in got.items() if r.taken}


@pytest.mark.parametrize("limit", [10_000, 7])
def test_source_mix_reaches_every_target(docs_of, monkeypatch, limit):
    """Small sources, and more of them than the driver draws for, land within a word of their targets."""
    monkeypatch.setattr(source_mix, "MAX_SOURCES", limit)
    rows = [(i, " ".join(["w"] * (100 + i % 5)), f"s{i:03}") for i in range(30)] + [(99, "a b c", "s100"), (100, " ".join(["w"] * 1000), "s101"), (101, "", "s102")]
    got = source_mix.mix_sources(docs_of(rows)).collect()
    want = dict(zip([r[0] for r in rows], source_mix.targets([len(r[1].split()) for r in rows]), strict=True))
    assert len(got) == len(rows) and all(abs(r.taken - want[r.doc_id]) <= 1 and r.target == pytest.approx(want[r.doc_id]) for r in got)
    n, key = np.array([1, 2, 9, 100]), np.array([5, -6, 7, 8])
    assert source_mix.permuted(source_mix.place_of(n - 1, n, key), n, key).tolist() == (n - 1).tolist()


# 6: HTML


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<br>", ""), ("plain &amp; simple", "plain & simple"),
        ("<nav>menu</nav><article><h1>T&eacute;</h1><p><b>one<br>two<p>three \n\t four</article><footer>f</footer>", "Té\none two\nthree four"),
        ("<script>var a='</p><article>';</script><article><p>x<style>p{}</style>y</p></article>", "xy"),
        ("<article><p>body</p><div class='comments'><p>first!</p></div><aside>side</aside><form><label>mail</label></form></article>", "body"),
        ("<div class='cookie-notice'>We use cookies on this page</div><div id='content'><p>The article has a long text here.</p><p>And a second paragraph &#8212; fine.</p></div><ul><li><a href=a>x</a><li><a href=b>y</a></ul>", "The article has a long text here.\nAnd a second paragraph — fine."),
        ("<body><div id=side class=sidebar><p>Latest posts and other things to read now</p></div><section><h2>H</h2><div>Text of the first block.</div><div>Text of the second block.</div></section>", "H\nText of the first block.\nText of the second block."),
        ("<article class=post><header class='entry-header'><h1>T</h1></header><p>b</p><div class='article-notice'>n</div><article class='comment'><p>c</p></article></article>", "T\nb"),
        ("<main><p>Some text of the page.</p><section id='reader-comments'><h3>3 comments</h3><p>I disagree with all of this and more.</p></section></main>", "Some text of the page."),
        ("<article><p>a < b, x &lt;y&gt; &amp &copy</p></article", "a < b, x <y> & ©"),
        ("<p class=it's>Hello world</p><p>more", "Hello world\nmore"), ("<div><p title='a > b' data-class=\"ad\">one</p><p alt=\"class='ad'\">two</p></div>", "one\ntwo"),
        ("<article><h1 class=header>Title</h1><p class=legal>All of it is so.</p><p>body</p><p class=ad>Buy!</p></article>", "Title\nAll of it is so.\nbody"),
    ],
)
def test_html(html, text):
    assert html_text.main_text(html) == text


def slow_densities(root):
    """Composite text density and its sum over children by recursion, straight from the definition."""
    plain = lambda t: len("".join(t.split()))

    def counts(n):
        kids = [c for c in n.children if isinstance(c, html_text.Node) and not c.around]
        c = sum(plain(x) for x in n.children if isinstance(x, str)) + sum(counts(k)[0] for k in kids)
        t = sum(counts(k)[1] + 1 for k in kids)
        if n.tag == "a":
            return c, t, c, 1 + sum(counts(k)[3] for k in kids)
        return c, t, sum(counts(k)[2] for k in kids), sum(counts(k)[3] for k in kids)

    whole = counts(root)
    body = whole[2] / max(whole[0], 1)

    def factor(c, t, lc, lt):
        return np.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / np.log(np.log(c / max(c - lc, 1) * lc + body * c + np.e)) if np.log(c / max(c - lc, 1) * lc + body * c + np.e) > 1 else np.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))

    def density(n):
        c, t, lc, lt = counts(n)
        return c / max(t, 1) * factor(c, max(t, 1), lc, lt) if c else 0.0

    def total(n):
        own = sum(plain(x) for x in n.children if isinstance(x, str))
        kids = sum(density(k) for k in n.children if isinstance(k, html_text.Node) and not k.around)
        return kids + (own if n.tag == "a" else own * factor(own, 1, 0, 1))

    return density, total


def test_html_densities_by_definition():
    rng = random.Random(31)

    def page(depth):
        parts = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "p", "a", "span", "ul", "section", "nav", "b"])
            inner = page(depth - 1) if depth and tag not in ("p", "a", "b") else ""
            parts.append(f"<{tag}>{' '.join(rng.choices(['some', 'longer words', 'x', ''], k=rng.randint(0, 9)))}{inner}</{tag}>")
        return rng.choice(["", "text before "]) + "".join(parts)

    for _ in range(40):
        root = html_text.parse(page(3))
        nodes = html_text.measure(root)
        density, total = slow_densities(root)
        assert all(n.density == pytest.approx(density(n)) and n.density_sum == pytest.approx(total(n)) for n in nodes)


LONG = ["This is paragraph number %d of the real text, with a good many words in every one of its lines." % i for i in range(12)]
PARAGRAPHS = ["<p>" + x + "</p>" for x in LONG]


def test_html_teaser_beside_the_text():
    """A small <article> doesn't hide the text in a <div>, in paragraphs or plain."""
    teaser = "<article><h2>Next</h2><p>Read our other story.</p></article>"
    for page in (f"{teaser}<div>{''.join(PARAGRAPHS)}</div>", f"<div class=page><div>{''.join(PARAGRAPHS)}</div>{teaser}</div>"):
        assert html_text.main_text(f"<body>{page}</body>") == "\n".join(LONG)
    assert html_text.main_text(f"<body>{teaser}<div>{' '.join(LONG)}</div></body>") == " ".join(LONG)
    assert html_text.main_text(f"<body>{teaser}<div><p>{' '.join(LONG)}</p></div></body>") == " ".join(LONG)


@pytest.mark.parametrize("kind", ["has-sidebar", "content-sidebar-wrap", "with-sidebar", "no-comments", "post legal", "search-result", "sidebar-wrap", "page no-sidebar comments-open", "sponsored", "comments"])
def test_html_wrapper_with_a_word_in_its_class(kind):
    """A wrapper of the page isn't taken for what its class mentions, with or without an <article> inside."""
    text = "".join(PARAGRAPHS)
    side = "<div class=sidebar><p>Some latest posts to read.</p></div>"
    for inner in (f"<div>{text}</div>", f"<article>{text}</article>", text):
        assert html_text.main_text(f"<body><div class='{kind}'>{inner}</div></body>") == "\n".join(LONG)
        assert html_text.main_text(f"<body><div id=page class='{kind}'>{side}{inner}</div><footer>f</footer></body>") == "\n".join(LONG)
    assert html_text.main_text(f"<body><div class='{kind}'><article>{PARAGRAPHS[0]}</article></div></body>") == LONG[0]


def test_html_classes_still_cut_what_surrounds():
    text = "".join(PARAGRAPHS)
    around = "<div class='widget sidebar-wrap'><p>Some latest posts to read in this week.</p></div><div class=related><article><p>A related page of ours.</p></article></div>"
    assert html_text.main_text(f"<body><article>{text}</article>{around}</body>") == "\n".join(LONG)
    assert html_text.main_text(f"<body><div>{text}{around}</div></body>").split("\n")[:12] == LONG
    assert html_text.main_text(f"<body><article>{PARAGRAPHS[0]}</article><div id=comments>{text}</div></body>") == LONG[0]
    assert html_text.main_text(f"<body><div>{text}</div><div class=search-result>{'<p><a href=x>one more page of this site</a></p>' * 90}</div></body>") == "\n".join(LONG)


@pytest.mark.parametrize("open_, close", [("<article>", "</article>"), ("<div><article>", "</article></div>")])
def test_html_sibling_articles(open_, close):
    """A story spread over sibling <article>s is whole; lists of links and teasers beside it stay out."""
    parts = [PARAGRAPHS[:5], PARAGRAPHS[5:8], PARAGRAPHS[8:]]
    links = "<ul>" + "<li><a href=x>another page of this site</a>" * 5 + "</ul>"
    page = links + "".join(open_ + "".join(p) + close for p in parts) + "<article><h3><a href=y>Another story</a></h3><p>Short.</p></article>"
    assert html_text.main_text(f"<body>{page}</body>") == "\n".join(LONG)
    sections = "".join(f"<section><h2>S{i}</h2>{''.join(p)}</section>" for i, p in enumerate(parts))
    assert html_text.main_text(f"<article><h1>T</h1>{sections}</article>").split("\n") == ["T", "S0", *LONG[:5], "S1", *LONG[5:8], "S2", *LONG[8:]]


def test_html_pages(spark):
    pages = spark.createDataFrame([(1, "u", "<article>a<p>b</article>", "?"), (2, None, None, "?")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in html_text.extract_text(pages).collect()) == [(1, "u", "a\nb"), (2, None, "")]
    deep = "<div>" * 3000 + "<p>end"
    assert html_text.main_text(deep) == "end"


# 3: licences


def test_licenses(docs_of):
    mit = license_scan.NOTICES["MIT"][0]
    texts = ["Released under the MIT License.", "RELEASED!! UNDER!! THE!! MIT!! LICENSE!!", "words before\nLicensed under CC BY-NC 4.0.\nwords after", mit.replace("free of charge", "at no charge"), "a software license is a thing", None, "", "x " * 5000 + "This work is licensed under the GNU General Public License, version 3. " + "y " * 5000]
    found = by_id(license_scan.scan_licenses(docs_of(texts)))
    assert [[x.license for x in found[i].licenses] for i in range(len(texts))] == [["MIT"], ["MIT"], ["CC-BY-NC-4.0"], ["MIT"], [], [], [], ["GPL-3.0"]]
    span = found[2].licenses[0]
    assert texts[2][span.start : span.end] == "Licensed under CC BY-NC 4.0" and found[3].licenses[0].dice > 0.8


def test_license_pruning_loses_nothing():
    every = [g.format(n) for names in license_scan.NAMES.values() for n in names for g in license_scan.GRANTS] + [t for n in license_scan.NOTICES.values() for t in n]
    rng = random.Random(9)
    known, _ = license_scan.templates()
    for text in every:
        assert [h[3] for h in license_scan.find_licenses(f"Before that. {text} After that.")] == [1.0]
        words = text.split()
        words[rng.randrange(len(words))] = "other"
        grams = license_scan.Counter(license_scan._bigrams([w for w, *_ in license_scan.words_of(" ".join(words))]))
        best = max(license_scan.dice(grams, k[1]) for k in known)
        found = max((h[3] for h in license_scan.find_licenses(" ".join(words))), default=0)
        assert best < license_scan.DICE or found >= license_scan.DICE  # a passage that matches as a whole is found


def brute_licenses(text, least=license_scan.DICE):
    """By Dice over all windows of all templates, the best of those that overlap."""
    words = license_scan.words_of(text)
    grams = license_scan._bigrams([w for w, *_ in words])
    found = []
    for spdx, want, m in license_scan.templates()[0]:
        for a in range(len(grams)):
            mine, shared = license_scan.Counter(), 0
            for b in range(a, min(len(grams), a + 2 * m)):  # longer windows have a Dice under 2 / 3
                mine[grams[b]] += 1
                shared += mine[grams[b]] <= want[grams[b]]
                if 2 * shared / (b + 1 - a + m) >= least:
                    found.append((-2 * shared / (b + 1 - a + m), a - b - 1, a, b + 1, spdx))
    chosen = []
    for d, _, a, b, spdx in sorted(found):
        if all(words[b][2] <= s or e <= words[a][1] for s, e, *_ in chosen):
            chosen.append((words[a][1], words[b][2], spdx, round(-d, 6)))
    return sorted(chosen)


def test_whole_licences(docs_of):
    """Whole texts are one match, also with a copyright line, other white space and a few other words."""
    rng = random.Random(17)
    for spdx, text in license_scan.TEXTS.items():
        (found,) = license_scan.find_licenses("Copyright (c) 2020 A. Writer\n\n" + text.replace(". ", ".\n   "))
        assert found[2:] == (spdx, 1.0)
        words = text.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = "other"
        best = max(license_scan.find_licenses(" ".join(words)), key=lambda x: x[1] - x[0])
        assert best[2] in (spdx, "BSD", "BSD-2-Clause", "BSD-3-Clause") and best[3] > 0.8


def test_texts_without_anchors_have_no_match(docs_of):
    """Templates with any bigrams left out that a match can lack: either an anchor is left or Dice is under the least."""
    rng = random.Random(23)
    known, _ = license_scan.templates()
    anchors = set(license_scan.anchors())
    every = [t for n in license_scan.NOTICES.values() for t in n] + list(license_scan.TEXTS.values()) + [g.format(n) for ns in license_scan.NAMES.values() for n in ns for g in license_scan.GRANTS]
    for text in every:
        words = [w for w, *_ in license_scan.words_of(text)]
        without = [w if w not in anchors else f"x{i}" for i, w in enumerate(words)]
        assert license_scan.find_licenses(" ".join(without)) == []
    texts = [" ".join(rng.choice([w, w, w, "x"]) for w in rng.choice(every).split()) for _ in range(60)] + ["nothing here", None]
    found = by_id(license_scan.scan_licenses(docs_of(texts)))
    for i, t in enumerate(texts):
        assert [(x.start, x.end, x.license, x.dice) for x in found[i].licenses] == license_scan.find_licenses(t or "")


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 0.9, 1.0])
def test_every_template_is_covered_by_anchors(least):
    import time

    license_scan.anchors.cache_clear()
    began = time.perf_counter()
    anchors = set(license_scan.anchors(least))
    assert time.perf_counter() - began < 10
    for _, grams, m in license_scan.templates()[0]:
        touched = sum(n for g, n in grams.items() if anchors & set(g))
        assert touched > m - license_scan._shared_least(m, least)  # more than a match can lack
    pattern = re.compile(license_scan.anchor_pattern(least))
    for texts in (license_scan.NAMES.values(), license_scan.NOTICES.values()):
        assert all(pattern.search(license_scan.GRANTS[2].format(t).lower()) for ts in texts for t in ts)


def test_common_bigrams_are_cheap():
    import time

    began = time.perf_counter()
    assert license_scan.find_licenses("under the " * 20_000) == [] and time.perf_counter() - began < 10


def test_licenses_with_inserted_clauses():
    rng = random.Random(13)
    mit, apache = license_scan.NOTICES["MIT"][0].split(), license_scan.NOTICES["Apache-2.0"][1].split()
    middle = " ".join([*mit[:33], *[f"unknown{i}" for i in range(8)], *mit[33:]])
    (found,) = license_scan.find_licenses(middle)
    assert (found[2], found[1]) == ("MIT", len(middle) - 1) and found[3] > 0.9
    stretched = list(mit)
    for i in range(24):  # 1.4 times as long, and a sentence with bigrams of the template after it
        stretched.insert(10 + i, f"unknown{i}")
    (found,) = license_scan.find_licenses(" ".join(stretched) + ". In other words, some users of the software and copies of the thing.")
    assert found[2] == "MIT" and found[3] > 0.8
    for _ in range(12):
        words = list(rng.choice([mit, apache]))
        at = rng.randrange(len(words))
        words[at:at] = [f"unknown{i}" for i in range(rng.randint(1, 30))]
        text = "Use of the Software. " + " ".join(words) + " Licensed under the very new MIT License. All of the Software."
        assert license_scan.find_licenses(text) == brute_licenses(text)


# 8: toxicity


def test_ordinal_fit():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    z = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=1500)
    grade = (z > 0).astype(int) + (z > 2)
    w, cuts = toxicity.fit(x, grade)
    assert np.allclose(w, [2, -1, 0], atol=0.3) and cuts[0] < cuts[1] and np.allclose(cuts, [0, 2], atol=0.3)


def test_grades_look_up_the_same_terms():
    text = "Bad badly badness, trashy trash trashing! badly"
    model = toxicity.Model({"bad": 1.0, "bad-": 0.5, "trash-": 2.0, "trash": 0.25, "none": 9.0}, [3.0])
    z = sum(model.weights[t] * toxicity.weight(n) for t, (n, _) in toxicity.terms(text).items() if t in model.weights)
    assert model.grades(text) == [pytest.approx(1 / (1 + np.exp(3.0 - z)))]


@needs_data
def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    graded = toxicity.grade_toxicity(docs, toxicity.learn_from(docs, labels))
    rows = graded.join(labels.withColumnRenamed("toxic", "label"), "doc_id").where(quality_classifier.held_out()).collect()
    hit = [r.toxic for r in rows if r.label == 1]
    clean = [r.toxic for r in rows if r.label == 0]
    assert np.mean(hit) > 0.5 and np.mean(clean) < 0.05
    assert all(0 <= r.severity <= toxicity.LEVELS and r.toxic == (r.grade > 0) for r in rows)


def test_without_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_of(["some text", "more text"])
    assert toxicity.grade_toxicity(docs, toxicity.learn_from(docs, none)).where("toxic").isEmpty()
    assert quality_rules.learn_from(docs, none) == []
    assert quality_classifier.score(docs, quality_classifier.learn_from(docs, none)).count() == 2


# odd tables


MACHINE = quality_classifier.fit([], np.zeros(0))
LABELS = [(1, 1, 0), (2, 0, 1), (4, 1, 1), (5, 0, 0), (6, 1, None), (7, None, 1), (8, 1, 0), (None, 1, 1), (4, 1, 1)]
APPLIED = {
    "rules": lambda d: quality_rules.quality_rules(d, []), "mix": source_mix.mix_sources, "mixed": source_mix.mixed_documents, "licences": license_scan.scan_licenses, "simhash": simhash.near_duplicates,
    "near": simhash.drop_near_duplicates, "score": lambda d: quality_classifier.score(d, MACHINE), "accepted": lambda d: quality_classifier.accepted(d, MACHINE), "dedup": exact_dedup.exact_dedup,
    "similar": simhash.similar_documents, "no similar": simhash.drop_similar, "html": lambda d: html_text.extract_text(d, "doc_id", "text", ("source", "h")),
    "copies": exact_dedup.drop_copies, "toxicity": lambda d: toxicity.grade_toxicity(d, toxicity.Model({}, [40.0, 40.0])), "bpe": bpe.round_trip, "secrets": secret_scan.scan_secrets,
}
PER_ROW = {"rules", "mix", "licences", "simhash", "similar", "html", "score", "dedup", "toxicity", "bpe", "secrets"}


@pytest.mark.parametrize("name", APPLIED)
def test_odd_tables(odd, name):
    out = APPLIED[name](odd).collect()
    if name in PER_ROW:
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd.collect())
    assert APPLIED[name](odd.limit(0)).collect() == []


def test_odd_results(odd):
    dedup = exact_dedup.exact_dedup(odd).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in dedup if r.doc_id in (1, 2, 3, 7, 8)} == {(1, 1, True), (2, 1, False), (3, 3, True), (7, 7, True), (8, 7, False)}
    assert [r.kept for r in dedup if r.doc_id is None] == [True]
    near = {r.doc_id: r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert near[1] == near[2] == near[3] == 1 and near[8] == 7 and near[None] is None
    mix = source_mix.mix_sources(odd).collect()
    assert all(r.taken == 0 for r in mix if r.size == 0) and all(r.taken <= 3 * r.size for r in mix)


@pytest.mark.parametrize("learn", [quality_rules.learn_from, quality_classifier.learn_from, toxicity.learn_from])
def test_learning_on_odd_tables(odd, spark, learn):
    """Clashing names in both tables, null labels and ids, an id that is repeated very often, empty tables."""
    labels = spark.createDataFrame([(*r, "?", "?", "?") for r in LABELS], "doc_id long, quality int, toxic int, y string, text string, n_chars string")
    many = odd.union(odd.where("doc_id = 4").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("_"))
    first, again = learn(odd, labels), learn(many, labels)
    assert isinstance(again, type(first))
    learn(odd.limit(0), labels), learn(odd, labels.limit(0))
    text = odd.drop("n_chars").withColumn("n_chars", F.lit("not a number"))
    learn(text, labels)


def test_rows_of_an_id_are_learned_from_once(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i % 50} of some words") for i in range(5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert text_stats.one_per_id(text_stats.labelled_sample(docs, labels, "quality", 30)).count() == 30


def test_n_chars_that_is_no_number(docs_of):
    docs = docs_of(["some text here", "other"]).drop("n_chars")
    want = {r.doc_id: r.score for r in quality_classifier.score(docs, MACHINE).collect()}
    for other in (F.lit("many"), F.array(F.lit(1)), F.lit(None)):
        got = {r.doc_id: r.score for r in quality_classifier.score(docs.withColumn("n_chars", other), MACHINE).collect()}
        assert got == want and quality_classifier.accepted(docs.withColumn("n_chars", other), MACHINE).count() == 0


def test_session_settings_stay(docs_of, spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    secret_scan.scan_secrets(docs_of(["x"])).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_guess_cost_is_the_cheapest_segmentation():
    """All ways to cut values of up to 10 characters into spans and brute force, one by one."""
    rng = random.Random(101)

    def cheapest(value):
        spans = list(secret_scan._spans(value, secret_scan.COST)) + [(i, j, float(j - i)) for i in range(len(value)) for j in range(i + 1, len(value) + 1)]

        def ways(at):
            if at == len(value):
                yield 0.0, 0
                return
            for i, j, cost in spans:
                if i == at:
                    for rest, n in ways(j):
                        yield cost + rest, n + 1

        return min(cost + 0.3 * (n - 1) for cost, n in ways(0))

    pieces = ["love", "P4ss", "123", "qwe", "1999", "aa", "xq", "Z", "!", "abab", "dragon", "7"]
    for _ in range(60):
        value = "".join(rng.choice(pieces) for _ in range(3))[: rng.randint(4, 8)]
        assert abs(min(secret_scan.guess_cost(value), secret_scan.COST) - min(cheapest(value), secret_scan.COST)) < 1e-9, value
    for value in ("zebra12", "x9(fK2!m", "aaaaaaaa", "2024-12-31"):
        assert abs(min(secret_scan.guess_cost(value), 9.0) - min(cheapest(value), 9.0)) < 1e-9


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('pwd="x9(fK2!mQz{7"', "x9(fK2!mQz{7"), ("passphrase: 'correct horse battery staple'", "correct horse battery staple"), ("token = `a|b;c<d>4Gk9#,x`", "a|b;c<d>4Gk9#,x"),
        ('credentials: "just a few words of prose here"', None), ('pin: "1234"', None), ("bearer qzxkvjwpqhtrmnbz", "qzxkvjwpqhtrmnbz"), ("pass: monkeydragon", None), ('pwd="no end of 7Gk#q9xL', None), ("private_key='Zk9#(pL2w!v'", "Zk9#(pL2w!v"),
    ],
)
def test_quoted_values_are_taken_whole(text, value):
    found = secret_scan.guess_spans(text, secret_scan.base_spans(text))
    assert [text[s:e] for s, _, e in found] == ([value] if value else [])


@pytest.mark.parametrize("tag", sorted(html_text.RAW))
def test_html_raw_ends_in_either_case(tag):
    page = f"<{tag.upper()}>x < y İ</ſ{tag[1:]}></{tag.capitalize()} ><article><h1>İstanbul</h1><p>{LONG[0]}</p></article>"
    assert html_text.main_text(f"<body>{page}</body>") == f"İstanbul\n{LONG[0]}"
    if tag != "xmp":  # which is shown
        assert html_text.main_text(f"<body><article><p>{LONG[0]}</p></article><{tag}>" + "İ" * 50_000 + "</body>") == LONG[0]


def test_html_keeps_what_an_article_says():
    article = lambda x: html_text.main_text(f"<body><nav><a href=x>home</a></nav><article><p>{LONG[0]}</p>{x}<p>{LONG[1]}</p></article></body>").split("\n")[1:-1]
    assert article('<div class="search">Search for meaning is hard.</div>') == ["Search for meaning is hard."]
    assert article("<p>The area is <math><mi>π</mi><msup><mi>r</mi><mn>2</mn></msup><annotation>tex</annotation></math> here.</p>") == ["The area is πr2 here."]
    assert article("<menu><li>Soup of the day</li><li>Bread</li></menu>") == ["Soup of the day", "Bread"]
    assert article('<menu><li><a href="s">Share</a></li></menu>') == [] == article('<div class="share"><a href=x>Post it</a></div>') == article('<div class="search"><input name=q> Search</div>')
    assert article('<div class="advert">Buy one now!</div>') == [] == article('<div class="cookie notice">We use cookies.</div>')
    assert html_text.main_text(f"<body><menu><li>File</li></menu><div class=legal>All rights reserved.</div><article><p>{LONG[0]}</p></article></body>") == LONG[0]
