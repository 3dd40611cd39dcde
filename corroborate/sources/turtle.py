"""Turtle read by many tasks, one file or many, and written with prefixes and lists.

A scan reads lines in byte ranges, so a cut may lie inside a long string or a statement. A first pass
tells, for each range and each state that it may begin in, the state that it ends in; a fold over a
file's ranges gives the true ones. The second pass parses each range from there. What stands before a
range's first end of a statement belongs to a statement that began earlier: such pieces are put
together, one statement at a time, and parsed. Prefixes hold from where they are declared, so names
stay unresolved until the declarations of all ranges are known; then they are joined.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corroborate.operators.lineage import ROWS_PER_TASK, new_folder

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: States at the start of a line: outside of long strings, or inside one of either quote.
STATES = ("", '"""', "'''")
#: The name under which the base stands among the prefixes.
BASE = "@base"
#: Characters of triples that a task writes, about.
CHARS_PER_TASK = 64 << 20

_WORD = r"""[^\s<>"'#;,\[\]().\\^]"""
_TOKEN = re.compile(
    rf"""(?P<space>\s+)|(?P<comment>\#.*)|(?P<long>\"\"\"|''')|(?P<short>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<iri><(?:[^<>"\s\\]|\\.)*>)
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<typed>\^\^)|(?P<mark>[;,\[\]()])|(?P<number>[+-]?\d*\.\d+(?:[eE][+-]?\d+)?(?!{_WORD}))
    |(?P<word>(?:\\.|{_WORD})(?:\\.|{_WORD}|\.+(?=\\.|{_WORD}))*)|(?P<dot>\.)|(?P<bad>.)""",
    re.X,
)
_REST = {q: re.compile(rf"((?:[^{q[0]}\\]|\\.|\\$|{q[0]}{{1,2}}(?!{q[0]}))*)({q})?") for q in STATES[1:]}
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_CONTROLS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
Token = tuple[str, str]
#: A term: the prefix that it needs (None: none; BASE: it is relative) and the rest.
Term = tuple[str | None, str]


def unescaped(text: str) -> str:
    """Text without its backslash escapes."""
    if "\\" not in text:
        return text
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _CONTROLS.get(m[3], m[3]), text)


class Lexer:
    """Tokens of lines, one after the other; a long string may go over many."""

    def __init__(self, state: str = "") -> None:
        self.state = state
        self.held: list[str] = []

    def line(self, text: str) -> Iterator[tuple[str, str, int]]:
        """(kind, text, end in the line) of the tokens that end in the line."""
        at = 0
        while True:
            if self.state:
                m = _REST[self.state].match(text, at)
                self.held.append(m[1])
                at = m.end()
                if m[2] is None:
                    if at < len(text):  # a backslash or quotes that end the line
                        self.held.append(text[at:])
                    self.held.append("\n")
                    return
                yield "string", unescaped("".join(self.held)), at
                self.state, self.held = "", []
            if at >= len(text):
                return
            m = _TOKEN.match(text, at)
            at = m.end()
            if m.lastgroup == "long":
                self.state = m[0]
            elif m.lastgroup == "short":
                yield "string", unescaped(m[0][1:-1]), at
            elif m.lastgroup not in ("space", "comment"):
                yield m.lastgroup, m[0], at


def state_after(text: str, state: str) -> str:
    """The state at the end of a line that begins in one."""
    if state not in text if state else '"""' not in text and "'''" not in text:
        return state
    lexer = Lexer(state)
    for _ in lexer.line(text):
        pass
    return lexer.state


class _Parser:
    """Triples and declarations of one statement, by descent over its tokens."""

    def __init__(self, tokens: list[Token], blank: str) -> None:
        self.tokens, self.at, self.blank, self.made = tokens, 0, blank, 0
        self.triples: list[tuple[Term, Term, Term]] = []
        self.declared: list[tuple[str, str]] = []

    def peek(self) -> Token:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ("end", "")

    def fresh(self) -> Term:
        self.made += 1
        return None, f"_:{self.blank}x{self.made}"

    def statement(self) -> None:
        """Declarations without a dot may stand before what has one."""
        while True:
            kind, text = self.peek()
            word = text.lower()
            if (kind, word) in (("at", "@prefix"), ("word", "prefix")):
                self.take()
                name, iri = self.take(), self.take()
                if name[0] != "word" or not name[1].endswith(":") or iri[0] != "iri":
                    raise ValueError("a prefix without a name and an IRI")
                self.declared.append((name[1][:-1], unescaped(iri[1][1:-1])))
            elif (kind, word) in (("at", "@base"), ("word", "base")):
                self.take()
                self.declared.append((BASE, unescaped(self.take()[1][1:-1])))
            else:
                break
        if self.at < len(self.tokens):
            anonymous = self.peek() == ("mark", "[")
            subject = self.node()
            if self.at < len(self.tokens) or not anonymous:
                self.predicates(subject)
        if self.at < len(self.tokens):
            raise ValueError("more than a statement")

    def predicates(self, subject: Term) -> None:
        while True:
            kind, text = self.peek()
            if kind not in ("iri", "word"):
                raise ValueError("no predicate")
            predicate = (None, f"{RDF}type") if (kind, text) == ("word", "a") else self.node()
            if predicate == (None, f"{RDF}type") and text == "a":
                self.take()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if self.peek() != ("mark", ","):
                    break
                self.take()
            if self.peek() != ("mark", ";"):
                return
            while self.peek() == ("mark", ";"):
                self.take()
            if self.peek() in (("end", ""), ("mark", "]")):
                return

    def node(self) -> Term:
        kind, text = self.take()
        if kind == "iri":
            iri = unescaped(text[1:-1])
            return (None, iri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else (BASE, iri)
        if kind == "string":
            if self.peek()[0] == "at":
                self.take()
            elif self.peek()[0] == "typed":
                self.take()
                self.take()
            return None, text
        if kind in ("word", "number"):
            name, colon, local = text.partition(":")
            return (None, text) if not colon or name == "_" else (name, unescaped(local))
        if (kind, text) == ("mark", "["):
            one = self.fresh()
            if self.peek() != ("mark", "]"):
                self.predicates(one)
            if self.take() != ("mark", "]"):
                raise ValueError("an open bracket")
            return one
        if (kind, text) == ("mark", "("):
            items = []
            while self.peek() != ("mark", ")"):
                items.append(self.node())
            self.take()
            rest: Term = (None, f"{RDF}nil")
            for item in reversed(items):
                cell = self.fresh()
                self.triples += [(cell, (None, f"{RDF}first"), item), (cell, (None, f"{RDF}rest"), rest)]
                rest = cell
            return rest
        raise ValueError(f"{text!r} is no term")


_ROW = "kind string, block long, seq long, s_ns string, s string, p_ns string, p string, o_ns string, o string, file string"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]


def _parsed(tokens: list[Token], file: str, block: int, seq: int) -> list[tuple]:
    """Rows of a statement: triples, declarations, or one error."""
    parser = _Parser(tokens, "b" + hashlib.md5(f"{file}:{block}:{seq}".encode()).hexdigest()[:16])
    try:
        parser.statement()
    except (ValueError, IndexError) as e:
        return [("error", block, seq, None, str(e), None, " ".join(t for _, t in tokens)[:200], None, None, file)]
    rows = [("prefix", block, seq, name, iri, None, None, None, None, file) for name, iri in parser.declared]
    return rows + [("triple", block, seq, *s, *p, *o, file) for s, p, o in parser.triples]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if " long" in c else pa.string() for c in _ROW.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, str]]:
    for b in batches:
        yield from zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("value").to_pylist(), strict=True)


def _end_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, ends) for each byte range: the states that the three states lead to."""

    def out(where, ends):
        return pa.RecordBatch.from_arrays([pa.array([where[0]]), pa.array([where[1]], pa.int64()), pa.array([ends], pa.list_(pa.string()))], ["file", "block", "ends"])

    where, ends = None, list(STATES)
    for file, block, text in _lines(batches):
        if where != (file, block):
            if where:
                yield out(where, ends)
            where, ends = (file, block), list(STATES)
        after = {s: state_after(text, s) for s in set(ends)}
        ends = [after[s] for s in ends]
    if where:
        yield out(where, ends)


def _pieces(begins: dict[tuple[str, int], str]):
    """mapInArrow function: rows of the statements that lie in a byte range, and what is left at its ends:
    `head` up to the first end of a statement, `tail` after the last, `middle` if it has none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, rows = None, []

        def piece(kind: str, raw: list[str]) -> tuple:
            return (kind, where[1], 0, None, "".join(raw), None, None, None, None, where[0])

        for file, block, text in _lines(batches):
            if where != (file, block):
                if where:
                    rows.append(piece("tail" if seq else "middle", raw))
                where, lexer, raw, tokens, seq = (file, block), Lexer(begins.get((file, block), "")), [], [], 0
            begin = 0
            for kind, token, end in lexer.line(text):
                if kind != "dot":
                    if seq:
                        tokens.append((kind, token))
                    continue
                if seq:
                    rows += _parsed(tokens, file, block, seq)
                else:
                    rows.append(piece("head", [*raw, text[begin:end]]))
                raw, tokens, begin, seq = [], [], end, seq + 1
            raw += [text[begin:], "\n"]
            if len(rows) > 5000:
                yield _batch(rows)
                rows = []
        if where:
            rows.append(piece("tail" if seq else "middle", raw))
        yield _batch(rows)

    return each


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of statements that were put together from pieces."""
    for b in batches:
        rows = []
        for file, block, text in zip(b.column("file").to_pylist(), b.column("block").to_pylist(), b.column("text").to_pylist(), strict=True):
            lexer, tokens = Lexer(), []
            for line in text.split("\n"):
                tokens += [(kind, token) for kind, token, _ in lexer.line(line)]
            if tokens and tokens[-1][0] == "dot":
                tokens.pop()
            if tokens:
                rows += _parsed(tokens, file, block, 0)
        yield _batch(rows)


def _begin_states(lines: DataFrame) -> dict[tuple[str, int], str]:
    """The byte ranges that begin inside a long string, and which. At most one for each split of the
    scan, of which the driver holds a list anyway."""
    ends = lines.mapInArrow(_end_states, "file string, block long, ends array<string>")
    states = F.array(*map(F.lit, STATES))
    # most ranges leave each state as it is; the others of a file are folded once, in order
    changing = ends.where(F.col("ends") != states)
    folds = changing.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "ends"))).alias("steps"))
    step = lambda s, e: F.get(e["ends"], F.array_position(states, s).cast("int") - 1)
    upto = F.filter("steps", lambda e: e["block"] < F.col("block"))
    begun = ends.select("file", "block").join(folds, "file").select("file", "block", F.aggregate(upto, F.lit(""), step).alias("state"))
    return {(r.file, r.block): r.state for r in begun.where("state <> ''").collect()}


def scan_turtle(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all statements, names unresolved: kind (triple, prefix, error), file, block, seq, and terms
    as namespace and rest. Written to the shared folder, as it is read for declarations and for triples: in the
    order of the text, since a folder for each kind would have every task sort all its rows in memory first."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    at = new_folder(spark, "turtle")
    lines.mapInArrow(_pieces(_begin_states(lines)), _ROW).write.parquet(at)
    rows = spark.read.schema(_ROW).parquet(at)
    left = rows.where(F.col("kind").isin("head", "middle", "tail")).select("file", "block", (F.col("kind") == "tail").cast("int").alias("part"), (F.col("kind") == "head").alias("ends"), "s")
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = left.drop("s").withColumn("nth", F.coalesce(F.sum(F.col("ends").cast("long")).over(order), F.lit(0)))
    pieces = left.drop("ends").join(numbered, ["file", "block", "part"]).groupBy("file", "nth")
    whole = pieces.agg(F.max("block").alias("block"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "part", "s"))), lambda x: x["s"]), "").alias("text"))
    across = whole.select("file", "block", "text").mapInArrow(_stitched, _ROW)
    return rows.where(F.col("kind").isin("triple", "prefix", "error")).unionByName(across)


def _resolved(triples: DataFrame, names: DataFrame, term: str) -> DataFrame:
    """triples with a term's prefix replaced by what it was declared as before; unknown ones stay as written."""
    d = names.alias("d")
    after = (F.col("block") > F.col("d.from_block")) | ((F.col("block") == F.col("d.from_block")) & (F.col("seq") >= F.col("d.from_seq")))
    until = F.col("d.to_block").isNull() | (F.col("block") < F.col("d.to_block")) | ((F.col("block") == F.col("d.to_block")) & (F.col("seq") < F.col("d.to_seq")))
    joined = triples.join(d, (F.col("file") == F.col("d.in_file")) & (F.col(f"{term}_ns") == F.col("d.ns")) & after & until, "left")
    iri, rest = F.col("d.iri"), F.col(term)
    relative = (
        F.when(rest == "", iri).when(rest.startswith("#"), F.concat(F.regexp_replace(iri, "#.*$", ""), rest))
        .when(rest.startswith("/"), F.concat(F.regexp_extract(iri, "^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)", 1), rest)).otherwise(F.concat(F.regexp_replace(iri, "[^/]*$", ""), rest))
    )
    named = F.when(F.col(f"{term}_ns") == BASE, F.coalesce(relative, rest)).otherwise(F.concat(F.coalesce(iri, F.concat(f"{term}_ns", F.lit(":"))), rest))
    return joined.select(*(F.when(F.col(f"{term}_ns").isNull(), rest).otherwise(named).alias(term) if c == term else F.col(c) for c in triples.columns))


def read_turtle(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(s, p, o) of Turtle files: prefixes, bases, lists by ; and , blank nodes, collections, long
    strings, comments, escapes. Literals lose their language or type; labels of blank nodes stay, those
    without one get a name from their place. A file is read by as many tasks as its splits.

    Statements that aren't Turtle are left out, or raise ValueError with the first of them if strict.
    Names with a prefix that was never declared stay as written. Relative IRIs are put after the base;
    dots in paths are not resolved.
    """
    rows = scan_turtle(spark, path)
    if strict and (bad := rows.where("kind = 'error'").select("file", "s", "p").first()):
        raise ValueError(f"{bad.file}: {bad.s}: {bad.p}")
    order = Window.partitionBy("in_file", "ns").orderBy("from_block", "from_seq")
    names = rows.where("kind = 'prefix'").select(F.col("file").alias("in_file"), F.col("s_ns").alias("ns"), F.col("s").alias("iri"), F.col("block").alias("from_block"), F.col("seq").alias("from_seq"))
    names = names.withColumn("to_block", F.lead("from_block").over(order)).withColumn("to_seq", F.lead("from_seq").over(order))
    # written, so that Spark knows their size before it plans the joins: small ones go to every task, and no triple is shuffled
    at = new_folder(spark, "prefixes")
    names.write.parquet(at)
    names = spark.read.schema(names.schema).parquet(at)
    out = rows.where("kind = 'triple'").drop("kind")
    for term in ("s", "p", "o"):
        out = _resolved(out, names, term)
    return out.select("s", "p", "o")


def is_node(term: Column) -> Column:
    """Whether an object is written as a node: an IRI or a blank node, else it is a literal."""
    return term.startswith("http") | term.startswith("_:")


def quoted(text: Column) -> Column:
    """A literal in quotes with its escapes, on one line."""
    for raw, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escape))
    return F.concat(F.lit('"'), text, F.lit('"'))


def bracketed(iri: Column) -> Column:
    """An IRI in brackets; what may not stand in one is escaped."""
    iri = F.replace(iri, F.lit("\\"), F.lit("\\u005C"))
    for c in '<>"{}|^` \n\r\t':
        iri = F.replace(iri, F.lit(c), F.lit(f"\\u{ord(c):04X}"))
    return F.concat(F.lit("<"), iri, F.lit(">"))


def plain(literal: Column) -> Column:
    """A literal without its escapes, in the JVM: backslashes that are escaped themselves split it first."""

    def unicode(text: Column, mark: str, digits: int, charset: str) -> Column:
        parts = F.split(text, re.escape(mark))
        tail = lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, digits)), charset), F.substring(x, digits + 1, 1 << 30))
        return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).when(x.rlike(f"^[0-9A-Fa-f]{{{digits}}}"), tail(x)).otherwise(F.concat(F.lit(mark), x))), "")

    def part(text: Column) -> Column:
        for escape, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"'), ("\\'", "'")):
            text = F.replace(text, F.lit(escape), F.lit(raw))
        return unicode(unicode(text, "\\u", 4, "UTF-16BE"), "\\U", 8, "UTF-32")

    whole = F.array_join(F.transform(F.split(literal, r"\\\\"), part), "\\")
    return F.when(F.instr(literal, "\\") == 0, literal).otherwise(whole)


def namespaces(triples: DataFrame, n: int = 32) -> DataFrame:
    """(namespace, uses): the n most used beginnings of IRIs up to their last # or /."""
    terms = F.array("s", "p", F.when(is_node(F.col("o")), F.col("o")))
    used = triples.select(F.explode(terms).alias("t")).select(F.regexp_extract("t", "^(.*[#/])[A-Za-z_][A-Za-z0-9_-]*$", 1).alias("namespace"))
    return used.where("namespace <> ''").groupBy("namespace").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "namespace").limit(n)


def _grouped(header: list[str]):
    """mapInArrow function: lines of sorted rows (s, p, o): a subject once, a predicate once, marks between."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        before, line, begun = (None, None), None, False
        for b in batches:
            lines = []
            for s, p, o in zip(*(b.column(c).to_pylist() for c in "spo"), strict=True):
                if not begun:
                    lines, begun = [*header], True
                if line is not None:
                    lines.append(line + (" ," if before == (s, p) else " ;" if before[0] == s else " ."))
                line = f"    {o}" if before == (s, p) else f"  {p} {o}" if before[0] == s else f"{s} {p} {o}"
                before = (s, p)
            yield out(lines)
        if line is not None:
            yield out([f"{line} ."])

    return each


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, most: int = 32, mode: str = "errorifexists") -> None:
    """Triples (s, p, o) as Turtle files, each with the prefixes. An object is a node if it starts with
    http or _:, else a literal. prefixes: name to namespace; the most used others are named ns1, ns2, …,
    `most` together at most. Rows without all three terms are left out.

    Files are ranges of (s, p, o), so a subject with most of the triples spreads over several; tasks sort some
    ROWS_PER_TASK triples, write them as they come and hold one line.
    """
    whole = triples.select("s", "p", "o").dropna()
    # URIs shrink in shuffle files, so tasks cut by bytes would sort many times what they seem to hold
    size = whole.agg(F.count("*").alias("n"), F.sum(F.length("s") + F.length("p") + F.length("o")).alias("chars")).first()
    tasks = math.ceil(max(size.n / ROWS_PER_TASK, (size.chars or 0) / CHARS_PER_TASK))
    given = {ns: name for name, ns in (prefixes or {}).items()}
    found = [r.namespace for r in namespaces(whole, most).collect() if r.namespace not in given][: max(0, most - len(given))]
    names = given | {ns: f"ns{i + 1}" for i, ns in enumerate(found)}
    header = [f"@prefix {name}: <{ns}> ." for ns, name in names.items()]
    known = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else None

    def node(term: Column) -> Column:
        short = F.regexp_extract(term, "^(.*[#/])([A-Za-z_][A-Za-z0-9_-]*)$", 2)
        ns = F.regexp_extract(term, "^(.*[#/])([A-Za-z_][A-Za-z0-9_-]*)$", 1)
        full = F.when(term.startswith("_:"), term).otherwise(bracketed(term))
        return full if known is None else F.when(known[ns].isNotNull(), F.concat(known[ns], F.lit(":"), short)).otherwise(full)

    s, p, o = (F.col(c) for c in "spo")
    dealt = whole.repartitionByRange(*([tasks] if tasks > 1 else []), "s", "p", "o")
    terms = dealt.select(node(s).alias("s"), F.when(p == f"{RDF}type", "a").otherwise(node(p)).alias("p"), F.when(is_node(o), node(o)).otherwise(quoted(o)).alias("o"))
    lines = terms.sortWithinPartitions("s", "p", "o").mapInArrow(_grouped(header), "value string")
    lines.write.mode(mode).option("lineSep", "\n").text(path)
