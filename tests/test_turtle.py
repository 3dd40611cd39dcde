"""Turtle and N-Triples: scans with cuts anywhere against whole files, and round trips."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corroborate.sources import records as R
from corroborate.sources import turtle as TTL

DOC = '''# a comment with "quotes" and a . dot
@prefix e: <http://e/> .
PREFIX f: <http://f#>
@base <http://base/dir/file> .
e:a e:p e:b , "lit" ; a e:T .   # trailing
<http://x> e:q 0.5 , -3 , 1e5 , true, "x"@en-GB, "5"^^e:int .
e:long e:says """first line
with " quotes "" and # no comment . and
@prefix e: <http://not/> .
end \\" still""" ; e:also \'\'\'it's
three lines
\'\'\' .
e:s1 e:p [ e:q e:r ; e:t "in" , [ e:deep 1 ] ] .
[ e:alone e:x ] .
e:list e:items ( e:one "two" ( 3 ) ) , () .
<rel> <#frag> </abs/path> , <> .
f:x.y f:z e:a\\#b, <http://e/\\u00e9>, "tab\\tnew\\nline \\U0001F600 \\\\n" .
_:n1 e:p _:n2 .
@prefix e: <http://changed/> .
e:a e:p e:b .
unknown:name e:p "last"
'''


def settings(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    yield lambda size: settings(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def shape(rows):
    """Triples with the names of unlabelled blank nodes replaced by what hangs on them, as a multiset."""
    down = {}
    for s, p, o in rows:
        down.setdefault(s, []).append((p, o))

    def name(term):
        return term if not re.match(r"_:b[0-9a-f]{16}x", term) else "[" + ";".join(sorted(f"{p} {name(o)}" for p, o in down.get(term, []))) + "]"

    return Counter((name(s), p, name(o)) for s, p, o in rows)


def test_statements(spark, tmp_path):
    (tmp_path / "x.ttl").write_text(DOC + ".\n")
    rows = [tuple(r) for r in TTL.read_turtle(spark, str(tmp_path / "x.ttl")).collect()]
    e, rdf = "http://e/", TTL.RDF
    want = {
        (e + "a", e + "p", e + "b"), (e + "a", e + "p", "lit"), (e + "a", rdf + "type", e + "T"), *(("http://x", e + "q", v) for v in ("0.5", "-3", "1e5", "true", "x", "5")),
        (e + "long", e + "says", 'first line\nwith " quotes "" and # no comment . and\n@prefix e: <http://not/> .\nend " still'), (e + "long", e + "also", "it's\nthree lines\n"),
    }
    got = set(rows)
    assert want <= got
    assert ("http://base/dir/rel", "http://base/dir/file#frag", "http://base/abs/path") in got and ("http://base/dir/rel", "http://base/dir/file#frag", "http://base/dir/file") in got
    assert ("http://f#x.y", "http://f#z", "http://e/a#b") in got and ("http://f#x.y", "http://f#z", "http://e/é") in got and ("http://f#x.y", "http://f#z", "tab\tnew\nline \U0001f600 \\n") in got
    assert ("_:n1", e + "p", "_:n2") in got and ("http://changed/a", "http://changed/p", "http://changed/b") in got and ("unknown:name", "http://changed/p", "last") in got
    forms = shape(rows)
    assert forms[(e + "s1", e + "p", f"[{e}q {e}r;{e}t [{e}deep 1];{e}t in]")] == 1 and any(s == f"[{e}alone {e}x]" for s, _, _ in forms)
    nil = f"{rdf}nil"
    assert forms[(e + "list", e + "items", nil)] == 1
    inner = f"[{rdf}first 3;{rdf}rest {nil}]"
    assert forms[(e + "list", e + "items", f"[{rdf}first {e}one;{rdf}rest [{rdf}first two;{rdf}rest [{rdf}first {inner};{rdf}rest {nil}]]]")] == 1


@pytest.mark.parametrize("size", [50, 230])
def test_cuts_anywhere(spark, tmp_path, splits, size):
    """The same rows however a file is cut: inside strings, IRIs, comments, statements and declarations."""
    text = DOC + ".\n"
    (tmp_path / "x.ttl").write_text(text)
    (tmp_path / "y.ttl").write_text('@prefix e: <http://other/> . e:a e:p """' + "long . \n" * 20 + '""" , "\'\'\'" . e:b e:p \'\'\'"""\n\'\'\' .')
    whole = shape([tuple(r) for r in TTL.read_turtle(spark, str(tmp_path)).collect()])
    assert sum(whole.values()) > 35 and ("http://other/a", "http://other/p", "long . \n" * 20) in whole and ("http://other/b", "http://other/p", '"""\n') in whole
    splits(f"{size}b")
    cut = TTL.read_turtle(spark, str(tmp_path), strict=True)
    tasks = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
    assert tasks >= len(text) // size and shape([tuple(r) for r in cut.collect()]) == whole


def test_bad_statements_are_left_out(spark, tmp_path):
    (tmp_path / "x.ttl").write_text('@prefix e: <http://e/> .\ne:a e:p e:b .\ne:only .\ne:a ) e:b .\ne:c e:p [ e:q .\n"lit" .\ne:d e:p "fine" .\n')
    assert sorted(r.s for r in TTL.read_turtle(spark, str(tmp_path)).collect()) == ["http://e/a", "http://e/d"]
    with pytest.raises(ValueError, match="x.ttl"):
        TTL.read_turtle(spark, str(tmp_path), strict=True)
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "z.ttl").write_text("# nothing\n")
    assert TTL.read_turtle(spark, str(tmp_path / "empty"), strict=True).collect() == []


ODD = ["plain", "", "two\nlines\r\nand\ttabs", 'say "hi"', "back\\slash \\n \\", '"""', "'''", "é 日本 \U0001f600", "ends with quote\"", "a . b ; c , d # e", "\\u0041", "\b\f\x01", "<tag>"]


def test_round_trips(spark, tmp_path, splits):
    rng = random.Random(3)
    rows = [(f"http://e.org/a/{i % 7}", f"http://e.org/p#{rng.choice('xyz')}", rng.choice([*ODD, "http://e.org/a/1", "http://other/q?x=1|2", "_:b1", "http://e.org/with space<>"])) for i in range(120)]
    rows += [("_:b1", "http://e.org/p#x", "http://e.org/a/9"), ("http://e.org/a/1", f"{TTL.RDF}type", "http://e.org/p#T")]
    triples = spark.createDataFrame([*rows, (None, "http://p", "x")], "s string, p string, o string")
    want = Counter(rows)
    TTL.write_turtle(triples, str(tmp_path / "ttl"), {"e": "http://e.org/a/"})
    text = "".join(f.read_text() for f in sorted((tmp_path / "ttl").glob("part-*")))
    assert "@prefix e: <http://e.org/a/> ." in text and "@prefix ns1: <http://e.org/p#> ." in text and re.search(r"e:\d? ?ns1:|<http://e.org/a/1>", text) and " ;\n" in text and " ,\n" in text
    splits("1000b")
    assert Counter(tuple(r) for r in TTL.read_turtle(spark, str(tmp_path / "ttl"), strict=True).collect()) == want
    R.write_ntriples(triples.dropna(), str(tmp_path / "nt"))
    assert Counter(tuple(r) for r in R.read_ntriples(spark, str(tmp_path / "nt")).collect()) == want
    assert all(len(line.split("\n")) == 1 for f in (tmp_path / "nt").glob("part-*") for line in f.read_text().splitlines())
    TTL.write_turtle(triples.limit(0), str(tmp_path / "none"))
    assert TTL.read_turtle(spark, str(tmp_path / "none")).collect() == []


def test_escapes_of_ntriples(spark, tmp_path):
    (tmp_path / "x.nt").write_text(r'<http://a> <http://p> "\u00e9\U0001F600\\u0041\\\"\t" .' + "\n" + r'_:x <http://p> "n"^^<http://t> . # note' + "\n# comment\n" + '<http://a> <http://p> "' + "long " * 20000 + '" .\n')
    rows = {(r.s, r.o) for r in R.read_ntriples(spark, str(tmp_path / "x.nt")).collect()}
    assert rows == {("http://a", 'é\U0001f600\\u0041\\"\t'), ("_:x", "n"), ("http://a", "long " * 20000)}


def test_hot_subject_is_spread(spark, tmp_path):
    many = spark.range(4000).select(F.lit("http://e/hot").alias("s"), F.lit("http://e/p").alias("p"), F.format_string("v%05d", "id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        TTL.write_turtle(many, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "t").glob("part-*"))
    assert len(files) >= 2 and max(f.stat().st_size for f in files) < 0.7 * sum(f.stat().st_size for f in files)
    assert TTL.read_turtle(spark, str(tmp_path / "t")).distinct().count() == 4000


def test_tasks_hold_bounded_triples(spark, tmp_path, monkeypatch):
    """A task sorts no more than its share of the triples, and reading neither sorts nor shuffles them."""
    monkeypatch.setattr(TTL, "ROWS_PER_TASK", 500)
    rows = spark.range(6000).select(F.concat(F.lit("http://e.org/"), (F.col("id") % 1500).cast("string")).alias("s"), F.lit("http://e.org/p").alias("p"), F.col("id").cast("string").alias("o"))
    texts = spark.range(40).select(F.lit("http://f.org/x").alias("s"), F.lit("http://e.org/p").alias("p"), F.repeat(F.concat("id", F.lit(" text ")), F.lit(1000)).alias("o"))
    TTL.write_turtle(rows, str(tmp_path / "t"))
    files = [f.read_text() for f in (tmp_path / "t").glob("part-*")]
    assert len(files) == 12 and max(text.count("\n") for text in files) < 1500
    monkeypatch.setattr(TTL, "CHARS_PER_TASK", 50_000)
    TTL.write_turtle(texts, str(tmp_path / "long"))
    assert len(list((tmp_path / "long").glob("part-*"))) >= 4
    for at, want in (("t", rows), ("long", texts)):
        found = TTL.read_turtle(spark, str(tmp_path / at), strict=True)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in plan
