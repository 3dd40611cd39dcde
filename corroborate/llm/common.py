"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word of the contracts: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that a Python worker turns into its own objects at once.
ROWS_PER_STEP = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(each, schema), with batches of ROWS_PER_STEP rows at most.

    Spark bounds the bytes of the batches that it sends; `each` makes Python objects and lists of
    its rows, and these are bounded here. The session's settings stay as they are.
    """

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return each(b.slice(at, ROWS_PER_STEP) for b in batches for at in range(0, b.num_rows, ROWS_PER_STEP))

    return df.mapInArrow(stepped, schema)


def spare(name: str, columns: list[str]) -> str:
    """A column name like `name` that columns, in any case, don't have yet."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where that is unset, a local session, as in tests, takes a temporary folder; on a cluster
    this raises ValueError, as a folder of one machine would lose what executors write.
    """
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    return own or tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write df to the cluster's checkpoint folder and cut its lineage (see shared_folder)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
