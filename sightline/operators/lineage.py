"""Sessions of plans: lineage cut by writing what many later plans read once to the shared folder, and batches bounded in bytes."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch: Python holds a few copies of one batch, never of 10,000 pages.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, whose Arrow batches hold BATCH_BYTES at most; a smaller bound that it has stays."""
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    given = spark.conf.get(_BATCH, "64m").lower().rstrip("b")
    own = int(given.rstrip("kmg") or 0) * units.get(given[-1:], 1)
    if not 0 < own <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder; how they are dealt stays known."""
    _shared(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder as a table: its size is known, so joins with it are planned rightly."""
    spark = df.sparkSession
    path = f"{_shared(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
