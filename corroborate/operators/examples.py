"""The first few rows of each group, as a mergeable bounded buffer (O2)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corroborate.operators.validate import each_of

#: Groups that a task holds before it hands on what it has, and parts that a group's rows are merged in first.
GROUPS_HELD, SALTS = 50_000, 32


class _Last:
    """Orders a heap with the largest first, so that the one to drop is on top."""

    __slots__ = ("key",)

    def __init__(self, key: tuple) -> None:
        self.key = key

    def __lt__(self, other: _Last) -> bool:
        return self.key > other.key


def _buffered(by: list[str], order: list[str], n: int):
    """mapInArrow function: of each group the n rows that are least in `order`, among those of this task.

    Nulls in the order come last; of equal rows any stays.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        schema = None

        def out() -> pa.RecordBatch:
            rows = [item[2] for heap in held.values() for item in heap]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        count = 0
        for b in batches:
            schema = b.schema
            columns = [b.column(c).to_pylist() for c in (*by, *order)]
            for i, values in enumerate(zip(*columns, strict=True)):
                group, rank = values[: len(by)], tuple((v is None, v if v is not None else 0) for v in values[len(by) :])
                heap = held.setdefault(group, [])
                if len(heap) < n or rank < heap[0][0].key:
                    count += 1
                    # the count keeps heaps from comparing rows
                    (heapq.heappush if len(heap) < n else heapq.heapreplace)(heap, (_Last(rank), count, b.slice(i, 1)))
            for heap in held.values():  # rows that stayed leave their batch
                for k, item in enumerate(heap):
                    if isinstance(item[2], pa.RecordBatch):
                        heap[k] = (item[0], item[1], item[2].to_pylist()[0])
            if len(held) > GROUPS_HELD:
                yield out()
                held.clear()
        if schema is not None and held:
            yield out()

    return each


def least_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """O2: of each group (columns `by`) the n rows that come first in `order`, with all their columns.

    Tasks keep n rows a group, then parts of a group do, then the group: what is shuffled is n rows for
    each group and task at most, nothing is sorted, and a group with most of the rows is no task's own.
    """
    each = _buffered(by, order, n)
    keys = [F.col(c) for c in by]
    parts = df.mapInArrow(each, df.schema).withColumn("_salt", F.spark_partition_id() % SALTS)
    merged = parts.repartition(*keys, "_salt").drop("_salt").mapInArrow(each, df.schema)
    return merged.repartition(*keys).mapInArrow(each, df.schema)


def issue_examples(checked: DataFrame, order: str = "id", records: int = 3, messages: int = 5, issues: str = "issues") -> DataFrame:
    """O2: (rule, order column, n, messages) of the first records that break each rule: n times each, with the first
    messages of all that the record breaks. checked has `issues` (validate)."""
    said = F.transform(issues, lambda i: F.concat(F.lit("["), i["category"], F.lit(":"), i["severity"], F.lit("] "), i["rule"]))
    rows = checked.select(F.col(order), F.col(issues).alias("_issues"), F.slice(said, 1, messages).alias("messages"))
    count = lambda rule: F.size(F.filter("_issues", lambda i: i["rule"] == rule)).cast("long")
    each = each_of(rows, F.array_distinct(F.transform("_issues", lambda i: i["rule"])), "rule", order, "_issues", "messages")
    return least_rows(each.select("rule", order, count(F.col("rule")).alias("n"), "messages"), ["rule"], [order], records)
