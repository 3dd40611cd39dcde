"""Secret scans: fixed patterns, and a guess-cost estimate of values in credential contexts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.common import map_batches, read, text_of

KINDS = ("assign", "access", "hex", "guess")
#: log10 of the guesses from which on a value counts as a secret, and the shortest such value.
COST, SHORTEST = 9.0, 6

# The patterns of the base kinds, from the contract.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 and more of [0-9a-f]+: a match starts where a run starts

#: Words that announce a credential, then a separator, then the value.
CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|(?:api|access|private|auth)[_\- ]?(?:key|token)|credentials?|bearer)"""
    r"""["']?(?:\x20*(?::=|=>|->|[:=])\x20*|\x20+is:?\x20+|(?<=bearer)\x20+)(?:(["'`])((?:(?!\1)[^\n])+)\1|["'`]?([^\s"'`,;<>(){}|\[\]]+))""",
    re.ASCII | re.IGNORECASE,
)
#: Of those, the ones whose quoted value may be several words.
PHRASE = re.compile(r"pass|pwd", re.IGNORECASE)
HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "bearer")

# Frequent password words by rank, rows of a keyboard, look-alike characters.
COMMON = (
    "password love admin welcome monkey dragon letmein master login princess sunshine shadow football baseball "
    "superman hello freedom whatever secret qwerty test user guest root changeme default iloveyou summer winter "
    "spring autumn monday friday hunter pass god money star computer internet access example"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LOOKS = str.maketrans("4@301$5!7", "aaeoissit")

_RANK = {w: math.log10(i + 2) for i, w in enumerate(COMMON)}
_PLACE = {c: (r, i) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d")
_UNLISTED_WORD = 5.3  # one of some 200,000 words of a language
_ODD_PAIR = 1.0  # what a pair of letters that words hardly have adds
# a consonant that hardly stands before the other; five consonants or four vowels in a row count as well
_UNUSUAL = re.compile(r"(?=q(?!u)|j[^aeiouy]|v[^aeiouyrl]|x[^aeiouytpchq]|z[^aeiouyzlw]|w[^aeiouyhrnlsdkt]|[^aeiouy](?:x|q)|(h|k|w|y|u)\1|[bcdfghjklmnpqrstvwxz]{5}|[aeiou]{4})", re.ASCII)


def _spans(value: str, limit: float) -> Iterator[tuple[int, int, float]]:
    """Segments (start, end, log10 of guesses) that a guesser tries before brute force.

    Their number and the time to find them are linear in the value's length: words and dates are
    bounded, and a repeat whose unit has `limit` characters can't make a value cheaper than that.
    """
    low = value.lower()
    plain = low.translate(LOOKS)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + 12) + 1):
            word = low[i:j] if low[i:j] in _RANK else plain[i:j]
            if word in _RANK:
                shape = value[i:j]
                extra = 0 if shape.islower() else 0.3 if shape.istitle() or shape.isupper() else 1.0
                yield i, j, _RANK[word] + extra + (0.5 if word != low[i:j] else 0)
    for m in re.finditer(r"[^\W\d_]{3,}", value):  # a run of letters in one case, or with a capital: some word
        if m.group().islower() or m.group().istitle() or m.group().isupper():
            odd = sum(1 for _ in _UNUSUAL.finditer(low, m.start(), m.end()))
            yield m.start(), m.end(), _UNLISTED_WORD + _ODD_PAIR * odd + (0 if m.group().islower() else 0.3)
    for i in range(n):
        if m := _DATE.match(value, i):
            yield i, m.end(), 4.6  # a day of about a century
    for m in _repeats(max(math.ceil(limit), 1)).finditer(value):  # a repeat costs its unit and the count
        yield m.start(), m.end(), len(m.group(1)) + math.log10(len(m.group()) / len(m.group(1)) + 1)
    for near in (  # keyboard walks and runs of neighbouring code points, each from any place to its end
        lambda a, b: a in _PLACE and b in _PLACE and _PLACE[a][0] == _PLACE[b][0] and abs(_PLACE[a][1] - _PLACE[b][1]) == 1,
        lambda a, b: a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1,
    ):
        j = n
        for i in range(n - 1, -1, -1):
            if i + 1 < n and not near(low[i], low[i + 1]):
                j = i + 1
            if j - i >= 3:
                yield i, j, 1.7 + math.log10(j - i)


@lru_cache
def _repeats(longest: int) -> re.Pattern:
    return re.compile(rf"(.{{1,{longest}}}?)\1+", re.DOTALL)


def guess_cost(value: str, limit: float = COST) -> float:
    """log10 of the guesses for value: the cheapest way to cut it into words, dates, repeats,
    keyboard walks and brute-force spans, where brute force costs one digit per character and
    every further segment doubles the guesses. Exact below the limit; from there on, what is
    returned is at least the limit."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _spans(value, limit):
        by_end.setdefault(j, []).append((i, cost))
    best = [0.0] + [math.inf] * len(value)  # of any way that ends here
    brute = [math.inf] * (len(value) + 1)  # of those whose last segment is brute force
    for j in range(1, len(value) + 1):
        start = best[j - 1] + 1 + (0.3 if j > 1 else 0)
        brute[j] = min(brute[j - 1] + 1, start)
        best[j] = min([brute[j], *(best[i] + cost + (0.3 if i else 0) for i, cost in by_end.get(j, ()))])
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the fixed patterns, leftmost and non-overlapping by kind."""
    low = text.lower()
    found = []
    if any(k in low for k in ("passw", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], cost: float = COST) -> list[tuple[int, int, int]]:
    """Values in a credential context that no base span covers and that are too dear to guess."""
    low = text.lower()
    if not any(h in low for h in HINTS):
        return []
    found = []
    for m in CONTEXT.finditer(text):
        start, end = m.span(2) if m.group(2) else m.span(3)
        if not m.group(2):
            end = start + len(m.group(3).rstrip(".!?:*#%&$"))
        elif re.search(r"\s", m.group(2)) and not PHRASE.match(m.group()):
            continue  # quoted prose
        if end - start >= SHORTEST and not any(s <= start and end <= e for s, _, e in base) and guess_cost(text[start:end], cost) >= cost:
            found.append((start, 3, end))
    return found


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cost: float = COST) -> DataFrame:
    """(doc_id, spans) for each row; spans: array of (kind, start, end), code points, end exclusive.

    Each text is scanned whole, where it is read, without a shuffle. The spans of the fixed
    patterns (assign, access, hex) come first; kind `guess` adds values that follow a credential
    word and that the minimum-cost segmentation finds too dear to guess, at any length: a quoted value up to its
    closing quote, else up to white space or punctuation; several words only for pass… and pwd. Sorted by start, then
    kind. Null counts as empty, which has no spans. Repeated rows are scanned each; other columns
    are not read; an empty table gives an empty result.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + guess_spans(text, base, cost))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = map_batches(rows, each, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")
    return found.withColumnRenamed("doc_id", id_col)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *(of(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
