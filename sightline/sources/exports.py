"""Exports as rows of strings: CSV and JSON files, their kind and their shape.

A scan gives ``raw`` (map of column name to text), ``keyed`` (the same under
normalized names; of names that become equal, the last counts) and ``row_ord``, so
that each side can match names in its own way.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How exports are told apart, by normalized column names.
METRICS = frozenset({"clicks", "impressions", "position", "ctr"})
LANDING = frozenset({"landingpageplusquerystring", "landingpage", "pagepathandscreenclass", "landing"})
VISITS = frozenset({"sessions", "engagedsessions", "views"})
CRAWL = frozenset({"statuscode", "indexability", "crawldepth", "contenttype", "title1", "h11"})
POST = frozenset({"posttype", "poststatus", "languagecode", "postid", "slug", "type"})
URL_KEYS = (
    "url", "address", "page", "permalink", "link", "live_url", "liveurl", "path", "finalurl", "final_url",
    "landingpageplusquerystring", "landingpage", "landing", "pagepathandscreenclass",
)
PREPARED_COLLECTIONS = ("rows", "pages", "items", "data")
AUDITED_COLLECTIONS = ("pages", "items", "rows")

RAW = "raw map<string,string>, keyed map<string,string>, row_ord long"


def key_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def alias(m: Column, *names: str) -> Column:
    """The first of the names whose value is not empty, in a map with normalized names."""
    found = [m[key_name(n)] for n in names]
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in found])


def exact(m: Column, *names: str) -> Column:
    """The first of the names whose value is not empty, in a map with names as written."""
    return F.coalesce(*[F.when(F.trim(m[n]) != "", m[n]) for n in names])


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    table = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    if not table.columns:
        return spark.createDataFrame([], RAW)
    pairs = lambda named: [x for k, c in named.items() for x in (F.lit(k), F.col(f"`{c}`").cast("string"))]
    raw, keyed = {c.lstrip("\ufeff"): c for c in table.columns}, {key_name(c): c for c in table.columns}
    return table.select(F.create_map(*pairs(raw)).alias("raw"), F.create_map(*pairs(keyed)).alias("keyed"), F.monotonically_increasing_id().alias("row_ord"))


def _text(value: object) -> str | None:
    if isinstance(value, dict) and ("rendered" in value or "raw" in value):
        value = value.get("rendered") or value.get("raw")
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def collection(data: object, names: tuple[str, ...], lone: bool) -> list[dict]:
    """The rows of a JSON document: a list, a named list, or an object of rows by address."""
    if isinstance(data, dict):
        name = next((n for n in names if n in data), None)
        if name is None:
            return [data] if lone and {key_name(k) for k in data} & {key_name(k) for k in URL_KEYS} else []
        data = data[name]
    if isinstance(data, dict):
        return [{"url": k} | (v if isinstance(v, dict) else {}) for k, v in data.items()]
    return [r for r in data if isinstance(r, dict)] if isinstance(data, list) else []


def json_rows(spark: SparkSession, path: str, names: tuple[str, ...] = PREPARED_COLLECTIONS, lone: bool = True) -> DataFrame:
    """Rows of whole JSON documents. A document is not splittable, so each file is one task's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = collection(json.loads(content.decode("utf-8-sig")), names, lone)
                for k in range(0, len(rows), 1000):
                    maps = [[(str(a), _text(b)) for a, b in r.items()] for r in rows[k : k + 1000]]
                    keyed = [list({key_name(a): b for a, b in m}.items()) for m in maps]
                    texts = pa.map_(pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(maps, texts), pa.array(keyed, texts), pa.array(range(k, k + len(maps)), pa.int64())], ["raw", "keyed", "row_ord"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RAW)


def is_table(spark: SparkSession, path: str) -> bool:
    """Whether a path holds rows (JSON lines or Parquet, one file or a folder of parts) and not one JSON document."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.lower().endswith((".jsonl", ".ndjson", ".parquet")) or at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


def table_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines or Parquet in the form of a scan; splittable, so a cache of any size is many tasks' work."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path").limit(1).count()
    table = spark.read.parquet(path) if parts else spark.read.option("primitivesAsString", "true").json(path)
    flat = [(c, F.col(f"`{c}`") if t in ("string", "int", "bigint", "double", "boolean") else F.to_json(f"`{c}`")) for c, t in table.dtypes]
    pairs = lambda name: [x for c, v in {name(c): v for c, v in flat}.items() for x in (F.lit(c), v.cast("string"))]
    return table.select(F.create_map(*pairs(str)).alias("raw"), F.create_map(*pairs(key_name)).alias("keyed"), F.monotonically_increasing_id().alias("row_ord"))


def document_value(spark: SparkSession, path: str, name: str) -> str | None:
    """A value of a JSON document's own object, read where the file is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [json.loads(c.decode("utf-8-sig")) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_text(d.get(name)) if isinstance(d, dict) else None for d in data], pa.string())], ["value"])

    row = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "value string").first()
    return row[0] if row else None


def export_rows(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".csv"):
        return csv_rows(spark, path)
    if path.lower().endswith(".json"):
        return json_rows(spark, path)
    raise ValueError(f"unsupported export format: {path}")


def inventory_rows(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".csv"):
        return csv_rows(spark, path)
    if path.lower().endswith(".json"):
        return json_rows(spark, path, AUDITED_COLLECTIONS, lone=False)
    raise ValueError(f"unsupported inventory format: {path}")


def fields_of(rows: DataFrame, first: int = 50) -> frozenset[str]:
    """Normalized column names of the first rows."""
    head = rows.orderBy("row_ord").limit(first).select(F.explode(F.map_keys("raw")).alias("k")).distinct().collect()
    return frozenset(key_name(r["k"]) for r in head)


def detect_kind(fields: frozenset[str]) -> str:
    rules = (
        ("gsc", "keys" in fields and fields & METRICS),
        ("ga4", fields & LANDING and fields & VISITS),
        ("crawler", "address" in fields and fields & CRAWL),
        ("wordpress", fields & {"liveurl", "permalink", "link"} and fields & POST),
        ("gsc", fields & {"page", "url"} and fields & METRICS),
    )
    return next((kind for kind, holds in rules if holds), "inventory")


def shape_fault(kind: str, fields: frozenset[str]) -> str:
    """Why these columns cannot be an export of that kind; empty if they can."""
    if not fields:
        return "source contains no data rows"
    needs = {
        "gsc": (fields & {"page", "url", "keys"}, fields & METRICS),
        "ga4": (fields & (LANDING | {"url", "page"}),),
        "wordpress": (fields & {"liveurl", "permalink", "link", "url"},),
        "crawler": (fields & {"address", "url"}, fields & {"statuscode", "status", "indexability", "contenttype", "crawldepth", "html", "renderedhtml"}),
    }
    held = needs.get(kind, (fields & {key_name(k) for k in URL_KEYS},))
    return "" if all(held) else f"columns do not match the declared {kind} export shape"
