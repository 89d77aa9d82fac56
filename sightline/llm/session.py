"""Session helpers shared by the operators: code shipping, lineage cuts, byte-bounded batches, callers' rows."""

from __future__ import annotations

import os
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch: Python holds a few copies of one batch, never of 10,000 long texts.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, bound Arrow batches by bytes, and make checkpoint() usable.

    The checkpoint folder is the one that the session names in
    ``spark.checkpoint.dir``. Without it there is no folder that all executors
    share, and a machine's own would lose rows with that machine, so this raises.
    """
    sc = spark.sparkContext
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    if int(spark.conf.get(_BATCH, "64mb").lower().rstrip("b").replace("m", "0" * 6).replace("k", "000") or 0) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut their lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a table of the shared folder and read again.

    Encoded columns are smaller than a checkpoint's rows, and sizes are then the
    files', while a checkpoint's estimate squares at each join.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash and row: whatever columns the caller has travel in one struct and meet no other name."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def rewritten(batch: pa.RecordBatch, kept_texts: list[str | None]) -> pa.RecordBatch:
    """The caller's columns (struct ``row``) with new texts, and n_chars, if there is one, set anew."""
    row = batch.column(batch.schema.get_field_index("row"))
    fields = list(row.type)
    made = {"text": kept_texts, "n_chars": [None if x is None else len(x) for x in kept_texts]}
    return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else a for f, a in zip(fields, row.flatten(), strict=True)], schema=pa.schema(fields))


def docs_of(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
