"""Operator 13 against comparisons of all pairs."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import pytest

from corroborate.llm import spelling

DATA = "/root/testdata/sf0.001"


def words_of(docs, slip=97):
    """Counter of the words of (doc_id, text) pairs, occurrence by occurrence."""
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return total


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """The contract's rows from a word count, all words against all, by deletion sets of each word for speed."""
    near = {w: set() for w in counts}
    by_gap = {}
    for w in counts:
        for i in range(len(w)):
            by_gap.setdefault((i, w[:i] + w[i + 1 :]), []).append(w)
            if (shorter := w[:i] + w[i + 1 :]) in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for some in by_gap.values():
        for w in some:
            near[w] |= set(some) - {w}
    assert all(one_edit(w, x) for w in counts for x in near[w])
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_all_pairs_of_small_alphabets(spark):
    rng = random.Random(13)
    for letters, sizes in (("ab", (1, 7)), ("aeé×ÿ", (2, 6)), ("abcdefghijklmnopqrstuvwxyz", (5, 6)), ("aé日\U0001f600\U0001f601", (1, 4))):
        counts = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): rng.randint(1, 60) for _ in range(250)}
        slow = {w: {x for x in counts if one_edit(w, x)} for w in counts}
        want = brute(counts)
        assert {w: n for w, _, _, _, n, _ in want} == {w: len(x) for w, x in slow.items()}
        made = spark.createDataFrame(list(counts.items()), "word string, n long")
        assert rows_of(spelling.variant_groups(made)) == want


def test_each_pair_comes_once(spark):
    words = ["abcdef", "abcdeg", "abcde", "bcdef", "abXdef", "aabcdef", "ababab", "bababa", "aaaaaa", "aaaaaaa"]
    made = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(made).collect()]
    assert len(pairs) == len(set(pairs)) and {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_chains_and_ties(spark):
    rows = [("words", 100), ("wordz", 100), ("wordy", 50), ("wodys", 3), ("wody", 6), ("wordyy", 25), ("aaaaab", 4), ("aaaaac", 8), ("aaaaa", 8)]
    got = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got["wordy"].form == "words" and got["wody"].root == "words" and got["wordyy"].root == "words" and got["words"].form is None
    assert got["aaaaab"].form == "aaaaa" and got["aaaaab"].form_n == 8 and got["aaaaac"].form is None and got["aaaaac"].root == "aaaaac"
    assert rows_of(spelling.variant_groups(spark.createDataFrame(rows, "word string, n long"))) == brute(dict(rows))
    chain = [("a" * k, 2**k) for k in range(1, 41)]
    assert {r.root for r in spelling.variant_groups(spark.createDataFrame(chain, "word string, n long")).collect()} == {"a" * 40}


def test_words_and_slips(spark):
    docs = [(i, "Straße STRASSE naïve x× Ünder ünder a-b c1d The-Quick_brown") for i in range(120)] + [(None, "Quick Quick"), (7, None), (8, "")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: r.n for r in spelling.word_counts(made, slip=97, least_length=1).collect()}
    want = words_of(docs)
    assert got == {w: n for w, n in want.items() if w} and got["Ünder"] > 100 and got["ünder"] > 100


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_query_matches_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    counts = {w: n for w, n in words_of(docs).items() if len(w) >= 5 and n >= 3}
    df = spelling.op13_spelling_variants(spark, DATA)
    assert rows_of(df) == brute(counts)
    assert dict(df.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}


def test_odd_tables(odd, spark):
    counts = {r.word: r.n for r in spelling.word_counts(odd).collect()}
    assert counts["words"] == 30_000 and counts["x" * 200_000] == 1
    assert spelling.variant_groups(spelling.word_counts(odd)).count() == len(counts)
    assert spelling.variant_groups(spelling.word_counts(odd.limit(0))).collect() == []
    twice = spark.createDataFrame([("twice", 2, 1), ("twice", 3, 2), (None, 4, 3), ("alone", None, 4)], "word string, n long, key int")
    assert rows_of(spelling.variant_groups(twice)) == [("twice", None, "twice", 5, 0, None)]
    with pytest.raises(ValueError):
        spelling.variant_groups(twice, ratio=1)
