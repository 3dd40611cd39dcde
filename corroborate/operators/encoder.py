"""Attention over claim graphs: typed edges, several heads, layers with residuals.

A layer is two joins of the edges with projected nodes, two aggregates by target (the largest logit,
then weighted sums) and one join back to the nodes. Aggregates are partial, so a claim with most of
the evidence is no group of one task. Only the dense products run in Python, on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.operators.lineage import checkpointed

# The kinds of edges between the kinds of nodes, and the slope of negative logits.
EDGE_KINDS = {
    "has_evidence": ("claim", "evidence"),
    "connected_to": ("evidence", "claim"),
    "co_evidence": ("evidence", "evidence"),
    "has_triple": ("claim", "triple"),
    "from_triple": ("evidence", "triple"),
}
SLOPE = 0.2


class EdgeWeights(NamedTuple):
    """One layer's weights for one kind of edges; hidden columns are dealt to heads in order."""

    source: np.ndarray
    target: np.ndarray
    att_source: np.ndarray
    att_target: np.ndarray
    bias: np.ndarray


class Encoder(NamedTuple):
    """inputs: (weights, bias) by kind of node; layers: EdgeWeights by kind of edge."""

    heads: int
    inputs: dict[str, tuple[np.ndarray, np.ndarray]]
    layers: tuple[dict[str, EdgeWeights], ...]

    @property
    def hidden(self) -> int:
        return len(next(iter(self.inputs.values()))[1])


def seeded_encoder(sizes: dict[str, int], hidden: int, heads: int = 4, layers: int = 2, seed: int = 42) -> Encoder:
    """Weights drawn evenly within sqrt(6 / (rows + columns)). sizes: features of each kind of node."""
    if hidden % heads:
        raise ValueError("heads must divide the hidden size")
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.uniform(-1, 1, shape) * np.sqrt(6 / (shape[0] + shape[-1]))
    inputs = {kind: (draw(n, hidden), np.zeros(hidden)) for kind, n in sorted(sizes.items())}
    made = lambda: EdgeWeights(draw(hidden, hidden), draw(hidden, hidden), draw(hidden), draw(hidden), np.zeros(hidden))
    return Encoder(heads, inputs, tuple({kind: made() for kind in EDGE_KINDS} for _ in range(layers)))


def weight_table(spark: SparkSession, encoder: Encoder) -> DataFrame:
    """(layer, kind, part, row, w): the encoder's weights as rows; layer -1 has the inputs, heads in `row` of part heads."""
    rows: list[tuple] = [(-1, "", "heads", encoder.heads, [])]
    named = [(-1, kind, part, m) for kind, ms in encoder.inputs.items() for part, m in zip(("weights", "bias"), ms, strict=True)]
    named += [(n, kind, part, m) for n, layer in enumerate(encoder.layers) for kind, w in layer.items() for part, m in w._asdict().items()]
    for n, kind, part, m in named:
        rows += [(n, kind, part, i, [float(x) for x in row]) for i, row in enumerate(np.atleast_2d(m))]
    return spark.createDataFrame(rows, "layer int, kind string, part string, row int, w array<double>")


def encoder_from(table: DataFrame) -> Encoder:
    """The encoder of a weight_table: as many rows as the model has, whatever the data."""
    found: dict[tuple, list] = {}
    heads = 1
    for r in table.orderBy("layer", "kind", "part", "row").collect():
        if r.part == "heads":
            heads = r.row
        else:
            found.setdefault((r.layer, r.kind, r.part), []).append(r.w)
    whole = {k: np.array(v) if k[2] in ("weights", "source", "target") else np.array(v[0]) for k, v in found.items()}
    inputs = {kind: (whole[-1, kind, "weights"], whole[-1, kind, "bias"]) for n, kind, part in whole if n < 0 and part == "bias"}
    depth = 1 + max((n for n, _, _ in whole), default=-1)
    layers = tuple({kind: EdgeWeights(*(whole[n, kind, p] for p in EdgeWeights._fields)) for m, kind, part in whole if m == n and part == "bias"} for n in range(depth))
    return Encoder(heads, inputs, layers)


def _elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1)


def _rows_of(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _listed(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).ravel()))


def _projected(nodes: DataFrame, key: str, products: dict[str, list[tuple[str, list[np.ndarray]]]], schema: str) -> DataFrame:
    """For each node and each (name, matrices) of its kind: a row (key, name, i, x @ matrix for each)."""
    outputs = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("type").to_numpy(zero_copy_only=False)
            for kind in sorted(set(kinds) & set(products)):
                some = b.take(pa.array(np.flatnonzero(kinds == kind)))
                for name, matrices in products[kind]:
                    x = _rows_of(some.column("x"), len(matrices[0]))
                    made = [_listed(x @ m) for m in matrices]
                    yield pa.RecordBatch.from_arrays([some.column(key), pa.array([name] * len(some), pa.string()), some.column("i"), *made], [key, "kind", "i", *outputs])

    kept = nodes.select(key, "type", F.col("i").cast("long").alias("i"), "x")
    return kept.mapInArrow(each, f"`{key}` {dict(nodes.dtypes)[key]}, kind string, i long, {schema}")


def _head_matrix(att: np.ndarray, heads: int) -> np.ndarray:
    """Columns that sum a head's own part of a projected row, weighted by its attention vector."""
    own = np.repeat(np.eye(heads), len(att) // heads, axis=0)
    return own * att[:, None]


def attention_layer(nodes: DataFrame, edges: DataFrame, weights: dict[str, EdgeWeights], heads: int, key: str = "claim_id") -> DataFrame:
    """nodes (key, type, i, x) after one round of messages along edges (key, kind, src, dst).

    Along each kind of edges, a target takes the sum of its projected sources, weighted by the softmax over
    its edges of LeakyReLU(source score + target score), head by head; kinds are added up, with
    the bias of each kind that the claim has. The result is ELU of that, plus what the node was. Edges
    that come twice count twice. A node whose kind no edge of its claim points to stays as it is.
    """
    hidden = len(next(iter(weights.values())).bias)
    edges = edges.where(F.col("kind").isin(*weights))
    sources = {kind: [] for kind, _ in EDGE_KINDS.values()}
    targets = {kind: [] for _, kind in EDGE_KINDS.values()}
    for name, w in weights.items():
        source, target = EDGE_KINDS[name]
        sources[source].append((name, [w.source, w.source @ _head_matrix(w.att_source, heads)]))
        targets[target].append((name, [w.target @ _head_matrix(w.att_target, heads)]))
    src = _projected(nodes, key, sources, "z array<double>, a array<double>").withColumnRenamed("i", "src")
    dst = _projected(nodes, key, targets, "b array<double>").withColumnRenamed("i", "dst")
    each_head, at = range(heads), [key, "kind", "dst"]
    raw = [F.col("a")[h] + F.col("b")[h] for h in each_head]
    logits = [F.when(r > 0, r).otherwise(SLOPE * r).alias(f"e{h}") for h, r in zip(each_head, raw, strict=True)]
    scored = edges.select(key, "kind", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).join(src, [key, "kind", "src"]).join(dst, at).select(*at, "z", *logits)
    tops = scored.groupBy(*at).agg(*(F.max(f"e{h}").alias(f"m{h}") for h in each_head))
    weighted = scored.join(tops, at).select(*at, "z", *(F.exp(F.col(f"e{h}") - F.col(f"m{h}")).alias(f"w{h}") for h in each_head))
    head_of = [j * heads // hidden for j in range(hidden)]
    sums = weighted.groupBy(*at).agg(*(F.sum(f"w{h}").alias(f"s{h}") for h in each_head), *(F.sum(F.col(f"w{head_of[j]}") * F.col("z")[j]).alias(f"v{j}") for j in range(hidden)))
    goal = F.create_map(*(F.lit(x) for name, (_, kind) in EDGE_KINDS.items() for x in (name, kind)))
    messages = sums.groupBy(key, goal[F.col("kind")].alias("type"), F.col("dst").alias("i")).agg(*(F.sum(F.col(f"v{j}") / F.col(f"s{head_of[j]}")).alias(f"v{j}") for j in range(hidden)))
    # the kinds of a claim are five at most
    kinds = edges.groupBy(key).agg(F.collect_set("kind").alias("_kinds"))

    def bias(j: int) -> Column:
        parts = [F.when((F.col("type") == EDGE_KINDS[name][1]) & F.array_contains("_kinds", name), F.lit(float(w.bias[j]))).otherwise(0.0) for name, w in weights.items()]
        return sum(parts[1:], parts[0])

    reached = F.exists("_kinds", lambda k: goal[k] == F.col("type"))
    both = nodes.join(kinds, key, "left").join(messages, [key, "type", "i"], "left")
    x = [F.when(F.coalesce(reached, F.lit(False)), _elu(F.coalesce(F.col(f"v{j}"), F.lit(0.0)) + F.coalesce(bias(j), F.lit(0.0)))).otherwise(0.0) + F.col("x")[j] for j in range(hidden)]
    return both.select(key, "type", "i", F.array(*x).alias("x"))


def encode(nodes: DataFrame, edges: DataFrame, encoder: Encoder, key: str = "claim_id") -> DataFrame:
    """(key, type, i, x): nodes (key, type, i, x: features of its kind) projected to the hidden size and
    passed through the encoder's layers; each layer is written before the next reads it. Kinds of nodes
    that the encoder has no input for are left out, and edges from or to nodes that are not there.
    """
    with_one = F.concat(F.transform("x", lambda v: v.cast("double")), F.array(F.lit(1.0)))
    known = nodes.where(F.col("type").isin(*encoder.inputs)).select(key, "type", "i", with_one.alias("x"))
    products = {kind: [(kind, [np.vstack([w, b])])] for kind, (w, b) in encoder.inputs.items()}
    x = _projected(known, key, products, "x array<double>").withColumnRenamed("kind", "type").select(key, "type", "i", F.transform("x", _elu).alias("x"))
    for weights in encoder.layers:
        x = attention_layer(checkpointed(x), edges, weights, encoder.heads, key)
    return x
