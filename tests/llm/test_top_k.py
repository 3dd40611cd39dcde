"""Operator 12 against scores of all pairs."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corroborate.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, is_query=lambda i: i % 50 == 0):
    """Ranked (query_id, rank, vec_id, score) from (id, vector) pairs, by Python's own integers."""
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints = [math.floor(256 * x) for x in v]
            if sum((abs(256 * x) + 1) ** 2 for x in v) < top_k.LONGEST:
                usable[i] = min(usable.get(i, (v, ints)), (v, ints))
    out = []
    for q, (_, a) in usable.items():
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, (_, b) in usable.items() if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def f32(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("kind", ["isotropic", "skewed", "few values", "copies", "opposite"])
def test_matches_all_pairs(spark, kind, monkeypatch):
    rng = random.Random(kind)
    make = {
        "isotropic": lambda: [rng.gauss(0, 0.2) for _ in range(12)],
        "skewed": lambda: [rng.paretovariate(1.1) * (0.01 if d else 1) for d in range(6)],
        "few values": lambda: [rng.choice([-1.0, 0.0, 0.5]) for _ in range(4)],
        "copies": lambda: [0.25] * 5 if rng.random() < 0.6 else [rng.random() for _ in range(5)],
        "opposite": lambda: [-rng.random() * 3 for _ in range(5)],
    }[kind]
    rows = [(i, f32(make())) for i in rng.sample(range(3000), 700)]
    monkeypatch.setattr(top_k, "LEAST_SHARD", 100)
    monkeypatch.setattr(top_k, "BLOCK", 5)
    vectors = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    assert found(top_k.top_k(vectors, vectors.where("vec_id % 50 = 0"))) == brute(rows)


def test_lists_stop_early_and_lose_nothing():
    rng = np.random.default_rng(12)
    x = np.floor(256 * rng.pareto(1.2, (4000, 5))).astype(np.int64)
    lists = top_k.SortedLists(np.arange(4000), x)
    stopped = 0
    for q in (*x[:40], *-x[40:60], np.zeros(5, np.int64)):
        got = lists.by_threshold(q, -1, 5)
        if got is not None:
            stopped += 1
            want = sorted((-int(s), i) for i, s in enumerate(x @ q))[:5]
            assert [(-s, r) for r, s in zip(got[0].tolist(), got[1].tolist())] == want
    assert stopped > 20


def test_equal_scores_at_the_bound_go_to_the_smaller_id():
    x = np.array([[5, 0]] * 50 + [[0, 5]] * 50 + [[4, 1]] * 100)
    lists = top_k.SortedLists(np.arange(200)[::-1].copy(), x)
    ((rows, scores),) = lists.search(np.array([-1]), np.array([[1, 1]]), 3)
    assert lists.ids[rows].tolist() == [0, 1, 2] and scores.tolist() == [5, 5, 5]


def test_large_values_are_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, -(2.0**-8)]), (2, [-(2.0**21), 3.0]), (3, [1e30, 0.0]), (4, [2.0**20 + 1, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(top_k.top_k(vectors, vectors.where("vec_id = 0")))
    assert got == brute(rows, is_query=lambda i: i == 0) and [g[2] for g in got] == [4, 1, 2]


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 0.0]), (200, [float("inf"), 0.0]), (None, [1.0, 1.0]), (250, []), (3, []), (300, [1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [0.5, 9.0]), (8, [-1.0, 0.0]), (350, [0.0, 0.0])]
    vectors = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id long, embedding array<float>, id string, v string, rank int")
    got = found(top_k.top_k(vectors, vectors.where("vec_id % 50 = 0")))
    assert got == brute(rows) and [g for g in got if g[0] == 0][0] == (0, 1, 7, 256 * 128 + 512 * 2304)
    assert {g[0] for g in got} == {0, 250, 350}  # the only one-component vector has no candidate
    empty = vectors.limit(0)
    assert found(top_k.top_k(empty, empty)) == [] == found(top_k.top_k(empty, vectors)) == found(top_k.top_k(vectors, empty))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_query_matches_all_pairs(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    df = top_k.op12_top_k(spark, "/root/testdata/sf0.001")
    assert found(df) == brute(rows) and dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
