import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts, or from (id, text, source) rows."""

    def make(rows):
        full = [(i, r, "en", f"s{i % 3}", None if r is None else len(r)) if not isinstance(r, tuple) else (r[0], r[1], "en", r[2], None) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns whose names
    operators use for their own results."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "word", "en", "b", 4), (4, "word", "en", "b", 4), (None, "a null id here", None, "b", 14),
        (5, "many words " * 30_000, "en", "a", None), (6, "x" * 200_000, "en", None, None), (7, "tie tie", "de", "c", 7), (8, "tie tie", "de", "c", 7),
    ]
    clashing = [f"{c} string" for c in ("kept", "fp", "row", "size", "spans", "ids", "score", "id", "_id", "h", "y", "text_sha256", "block", "n_words", "_gone_id", "_gone", "_document", "_n", "_k", "_doc_id", "_source", "_h", "_copy", "_nth", "_pieces", "_n_chars", "_text")]
    return spark.createDataFrame([(*r, *["?"] * len(clashing)) for r in rows], ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *clashing]))
