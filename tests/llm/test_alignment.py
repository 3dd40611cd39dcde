"""Operator 11 against a slow reading of its definition, with the libraries that own the vocabulary files."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corroborate.llm import token_alignment as ta

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path(ta.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(ta.B_FILE))


def brute(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text, token by token."""
    a, b = libraries
    letters = ta._byte_letters()
    rows = []
    for t in texts:
        ids_a = a.encode(" " + (t or ""), add_special_tokens=False).ids
        ids_b = b.encode(t or "")
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(raw_a) != (" " + t).encode() or b"".join(raw_b) != (" " + t).encode():
            rows.append(([], [], ""))
            continue
        placed = []
        for raw, ids in ((raw_a, ids_a), (raw_b, ids_b)):
            end, ends = 0, []
            for r, i in zip(raw, ids, strict=True):
                end += len(r)
                ends.append((end, i))
            placed.append(ends)
        at_b = dict(placed[1])
        links = [(i, at_b[e]) for e, i in placed[0] if e in at_b]
        cuts = [e for e, _ in placed[0] if e in at_b]
        parts = ["|".join(",".join(str(i) for e, i in p if lo < e <= hi) for p in placed) for lo, hi in zip([0, *cuts], cuts)]
        rows.append((placed, links, ";".join(parts)))
    count = Counter(x for _, links, _ in rows for x in links)
    highest = Counter()
    for (_, j), n in count.items():
        highest[j] = max(highest[j], n)
    return [
        (len(p[0]) if p else 0, len(p[1]) if p else 0, g.count(";") + bool(g), len(links), sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
        for p, links, g in rows
    ]


def summary(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.orderBy("doc_id").collect()]


def test_odd_texts_match_the_definition(docs_of, libraries):
    rng = random.Random(11)
    texts = ["plain words here", None, "", " ", "  two  spaces\n\n\tand tabs ", "a piece mark ▁ inside", "<|endoftext|> and <s></s><unk>", "naïve café \U0001f600 日本語 ﷺ", "x" * 500, "\n" * 2500 + "end", "null\0char", "ﬁ ligature Å K", "same text", "same text"]
    texts += ["".join(rng.choice("ab c\n.,'1é日\U0001f600▁<") for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    want = brute(texts, libraries)
    assert summary(ta.alignment_summary(docs_of(texts))) == want
    assert want[1] == want[2] == want[5] == (0, 0, 0, 0, 0, 0, "") and want[6][0] > 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
def test_query_matches_the_definition(spark, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    some = [d.text if len(d.text or "") < 3000 else d.text[:1000] for d in docs]
    made = spark.createDataFrame([(d.doc_id, t) for d, t in zip(docs, some, strict=True)], "doc_id long, text string")
    assert summary(ta.alignment_summary(made)) == brute(some, libraries)
    whole = {r.doc_id: r for r in ta.op11_token_alignment(spark, DATA).collect()}
    a, b = libraries
    for d in docs:
        n_a = len(a.encode(" " + d.text, add_special_tokens=False).ids) if d.text else 0
        assert (whole[d.doc_id].n_a, whole[d.doc_id].n_b) == (n_a, len(b.encode(d.text or "")) if d.text else 0)


def test_arrays_of_the_general_operator(docs_of, libraries):
    texts = ["unbelievable tokenization", "", None, "naïve"]
    rows = {r.doc_id: r for r in ta.token_alignment(docs_of(texts)).collect()}
    a, b = libraries
    for i in (0, 3):
        r = rows[i]
        assert r.a_ids == a.encode(" " + texts[i], add_special_tokens=False).ids and r.b_ids == b.encode(texts[i])
        assert all(r.a_group[x.a] == r.b_group[x.b] for x in r.links) and len(r.links) == r.a_group[-1] + 1 == r.b_group[-1] + 1
    assert rows[1].a_ids == rows[2].links == []
    counts = {(r.a_id, r.b_id): r.n for r in ta.pair_counts(docs_of(texts * 3)).collect()}
    once = Counter((r.a_ids[x.a], r.b_ids[x.b]) for r in rows.values() for x in r.links)
    assert counts == {k: 3 * n for k, n in once.items()}


def test_tokens_without_bytes_are_linked_where_they_end():
    x = ta.align(np.array([0, 2, 2, 5]), np.array([2, 4, 5, 5]))
    assert x.cuts.tolist() == [2, 5] and list(zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)) == [(1, 0), (2, 0), (3, 2), (3, 3)]
    assert x.group_a.tolist() == [0, 0, 0, 1] and x.group_b.tolist() == [0, 1, 1, 1]
    none = ta.align(np.array([], int), np.array([], int))
    assert [len(v) for v in none] == [0] * 5


def test_only_suffixes_are_linkable():
    a, b = [b"ab", b"b", b"c"], [b"b", b"xab", b"c", b"c"]
    want = sorted(i * 4 + j for i, s in enumerate(a) for j, t in enumerate(b) if s.endswith(t) or t.endswith(s))
    assert ta.linkable(a, b).tolist() == want


def test_odd_tables(odd, spark):
    rows = ta.alignment_summary(odd).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6, 7, 8}
    assert [r.groups_sha256 for r in rows if r.doc_id in (1, 2)] == ["", ""] and len({r.groups_sha256 for r in rows if r.doc_id == 4}) == 1
    empty = odd.limit(0)
    assert ta.alignment_summary(empty).collect() == [] == ta.pair_counts(empty).collect() == ta.token_alignment(empty).collect()
    assert ta.alignment_summary(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).count() == len(rows)
