"""Corpus pipeline: quality filter, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pathlib import PurePosixPath
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import linededup, mixing, packing, quality, simhash
from sightline.llm.session import docs_of, prepare


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.accepted(docs, docs_of(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    return linededup.without_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the words that the mix takes of them."""
    return mixing.mixed_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("packing", pack),
]

#: Trained models, hashes and packing are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written as Parquet and read again."""
    prepare(spark)
    shared = PurePosixPath(f"pipeline-{uuid4().hex}")
    root = spark.sparkContext.getCheckpointDir()
    docs = docs_of(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{root}/{shared}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
