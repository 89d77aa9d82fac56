"""Joins whose large side may hold one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.session import kept

#: A key is hot if it has more rows than this and more than one in HOT_KEYS of all rows.
HOT_ROWS = 64
HOT_KEYS = 10_000


def hot_limit(rows: int) -> int:
    """Rows of a key beyond which it is hot, of which there are HOT_KEYS at most."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def hot_join(large: DataFrame, small: DataFrame, keys: list[str], rows: int, how: str = "inner", heavy: DataFrame | None = None) -> DataFrame:
    """``large`` joined (inner or left) with ``small``, which has one row a key at most.

    The rows of ``small`` for hot keys, fewer than HOT_KEYS, are sent to where the
    large side's rows are; only keys with few rows are dealt by key. ``rows`` is
    the number of rows of ``large``; ``heavy`` its hot keys, where they are known.
    """
    if heavy is None:
        heavy = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_limit(rows)).select(*keys)
    if rows <= HOT_ROWS or heavy.isEmpty():
        return large.join(small, keys, how)
    sent = kept(heavy.join(small, keys, how), "hot")
    there = large.join(F.broadcast(sent), keys)
    here = large.join(F.broadcast(sent.select(*keys)), keys, "left_anti").join(small, keys, how)
    return there.unionByName(here)
