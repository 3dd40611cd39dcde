"""Reports from small aggregate frames, as Markdown and JSON text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a report shows of a frame; frames are aggregates, and longer ones say so.
SHOWN = 200
#: Rows of the longest frame that a chart or an export takes.
LARGEST = 100_000


def markdown_table(df: DataFrame, shown: int = SHOWN) -> str:
    """A frame as a Markdown table."""
    rows = df.limit(shown + 1).collect()
    lines = [" | ".join(df.columns), " | ".join("---" for _ in df.columns)]
    lines += [" | ".join("" if v is None else str(v) for v in r) for r in rows[:shown]]
    more = [f"\nOnly the first {shown} rows are shown."] if len(rows) > shown else []
    return "\n".join([f"| {x} |" for x in lines] + more)


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report: a heading and a table for each section."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"


def _all_of(df: DataFrame) -> list:
    """Every row of a frame that is an aggregate and therefore small; ValueError above LARGEST rows, never a cut."""
    rows = df.limit(LARGEST + 1).collect()
    if len(rows) > LARGEST:
        raise ValueError(f"a report holds aggregates of up to {LARGEST} rows; this frame has more")
    return rows


def bars(df: DataFrame, label: str, value: str, width: int = 40) -> str:
    """Bars of text for all rows, in the frame's order."""
    rows = _all_of(df.select(label, value))
    top = max((float(r[1]) for r in rows), default=0.0)
    return "\n".join(f"{r[0]!s:>24} {'#' * round(width * float(r[1]) / top) if top else ''} {r[1]}" for r in rows)


def export(name: str, metrics: dict[str, DataFrame]) -> str:
    """Metric frames, whole, as one JSON document."""
    return json.dumps({"model": name, "metrics": {k: [r.asDict() for r in _all_of(df)] for k, df in metrics.items()}}, indent=2, default=str, ensure_ascii=False)


def evaluation_summary(model: str, metrics: dict[str, DataFrame], paths: DataFrame, layers: DataFrame, shortcut: DataFrame) -> str:
    """The evaluation of a model: its metric frames, decision paths (A31), layers (A32) and the
    claims made to break shortcuts (A33)."""
    return report(f"Evaluation of {model}", {**metrics, "Decision paths": paths, "Layers": layers, "Shortcut-breaking claims": shortcut})


def comparison(a: str, b: str, deltas: DataFrame) -> str:
    """Metrics of two models side by side (metrics.model_deltas), with the one that is better."""
    better = F.when(F.col("delta") > 0, F.lit(b)).when(F.col("delta") < 0, F.lit(a)).otherwise(F.lit("-"))
    shown = deltas.orderBy("metric").select("metric", F.col("a").alias(a), F.col("b").alias(b), "delta", better.alias("better"))
    return report(f"{a} and {b}", {"Metrics": shown})
