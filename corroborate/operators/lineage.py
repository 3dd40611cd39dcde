"""Cutting a job's lineage where an iteration would otherwise plan and lose everything before it, and tasks of bounded size."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a task, about, where triples are dealt out.
ROWS_PER_TASK = 250_000


def tasks_for(rows: DataFrame, each: int = ROWS_PER_TASK) -> int:
    """How many tasks take some `each` rows. URIs shrink to a tenth in shuffle files, so Spark's own choice by
    their bytes gives a task many times what it seems; rows say it better. Counts a table, so ask it of one that is read."""
    return max(1, math.ceil(rows.count() / each))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where it is
    unset a local session takes a temporary folder; on a cluster this raises ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    return (named or tempfile.mkdtemp(prefix="shared-")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of this run's own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without what came before it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
