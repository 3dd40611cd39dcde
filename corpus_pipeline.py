"""A corpus of training tokens from raw documents: filter, dedup twice, mix, encode.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the docs of the next. All but the last return the columns
of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corroborate.llm import bpe, exact_dedup, quality_classifier, simhash, source_mix
from corroborate.llm.common import read, shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; the others go."""
    machine = quality_classifier.learn_from(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, machine)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with a similarity of 0.8 or more over 5-word shingles the document with
    the smallest id: SimHash fingerprints propose pairs, the shingles decide."""
    return simhash.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the source mix takes, one row per document and repeat."""
    return source_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the byte-level BPE ids of each row, and of the bytes that they decode to."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("source_mix", mix),
    ("byte_level_bpe", tokens),
]

#: SQL can express neither the classifier nor SimHash components; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents. What a stage hands on lies in the folder that all executors share,
    under a name of this run; the rows that come back are read from it, so the caller clears it."""
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
