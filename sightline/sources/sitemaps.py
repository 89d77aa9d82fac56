"""Sitemaps: namespace-aware reading, index traversal and inspection.

Files are read as bytes and parsed on the executors; an index's children are the
next frontier of a loop whose length is the depth of the index, not its size.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator
from urllib.parse import urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sightline.functions import text as T
from sightline.functions import urls as U

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"  # fixed value
MOST_BYTES = 10_000_000  # fixed value
FILE = S.StructType([S.StructField(c, S.StringType()) for c in ("kind", "namespace", "sha256", "error")] + [S.StructField("locs", S.ArrayType(S.StringType())), S.StructField("containers", S.LongType())])


def _split(tag: str) -> tuple[str, str]:
    space, _, name = tag[1:].rpartition("}") if tag.startswith("{") else ("", "", tag)
    return space, name.lower()


def sitemap_facts(body: bytes) -> dict:
    """Kind and direct loc children in the root's own namespace; an error instead if it does not parse."""
    facts = {"kind": None, "namespace": None, "locs": [], "containers": 0, "sha256": hashlib.sha256(body).hexdigest(), "error": None}
    try:
        if len(body) > MOST_BYTES:
            raise ValueError(f"sitemap exceeds {MOST_BYTES} bytes")
        root = ElementTree.fromstring(body)
    except Exception as e:  # noqa: BLE001  any malformed file is a finding, not a failure
        return facts | {"error": str(e) or type(e).__name__}
    space, kind = _split(root.tag)
    inner = {"sitemapindex": "sitemap", "urlset": "url"}.get(kind)
    if inner is None:
        return facts | {"kind": kind, "namespace": space, "error": f"Unsupported root element: {kind}"}
    per_container = [[e.text.strip() for e in box if _split(e.tag) == (space, "loc") and e.text] for box in root if _split(box.tag) == (space, inner)]
    return facts | {"kind": kind, "namespace": space, "locs": [v for vs in per_container for v in vs], "containers": sum(bool([v for v in vs if v]) for vs in per_container)}


@F.pandas_udf(FILE)
def parse_sitemap(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for bodies in parts:
        yield pd.DataFrame([sitemap_facts(b) for b in bodies], columns=FILE.names)


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    read = spark.read.format("binaryFile").load(paths)
    return read.select("path", parse_sitemap("content").alias("f")).select("path", "f.*")


def _beside(parent: str, child: str) -> str:
    """Where a child of an index is looked for: beside it under its own file name."""
    name = posixpath.basename(urlsplit(child).path) if urlsplit(child).scheme in ("http", "https") else child
    return name if name.startswith(("/", "file:")) else f"{posixpath.dirname(parent)}/{name}"


def load_sitemaps(spark: SparkSession, paths: list[str], site: str) -> dict:
    """urls (DataFrame of url), resolved paths, their hashes, and unresolved (source, error)."""
    jvm, seen, todo = spark._jvm, set(), list(dict.fromkeys(paths))
    resolved, hashes, unresolved, found = [], [], [], []
    while todo:
        seen.update(todo)
        there = []
        for p in todo:
            at = jvm.org.apache.hadoop.fs.Path(p)
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                there.append(p)
            else:
                unresolved.append({"source": p, "error": "no such file"})
        following: list[str] = []
        if there:
            level = files(spark, there)
            # One row for each file, without its addresses.
            for row in level.select("path", "kind", "sha256", "error").collect():
                if row["error"] and row["kind"] is None:
                    unresolved.append({"source": row["path"], "error": row["error"]})
                    continue
                resolved.append(row["path"])
                hashes.append(row["sha256"])
                if row["error"]:
                    unresolved.append({"source": row["path"], "error": row["error"]})
            for row in level.where("kind = 'sitemapindex' and error is null").select("path", "locs").toLocalIterator():
                following += [_beside(row["path"], loc) for loc in row["locs"]]
            found.append(level.where("kind = 'urlset' and error is null").select(F.explode("locs").alias("raw")))
        todo = [p for p in dict.fromkeys(following) if p not in seen]
    empty = spark.createDataFrame([], "raw string")
    raw = empty
    for part in found:
        raw = raw.unionByName(part)
    url = U.normalize(F.col("raw"), site)
    urls = raw.select(url.alias("url")).where((F.col("url") != "") & T.same_site(F.col("url"), F.lit(site))).distinct()
    return {"urls": urls, "resolved": resolved, "hashes": hashes, "unresolved": unresolved}


def inspect_sitemap(body: bytes) -> dict:
    """Status and record count of a declared sitemap source: the standard namespace and a loc are required."""
    f = sitemap_facts(body)
    if f["error"]:
        return {"status": "invalid", "records": 0, "reason": f["error"]}
    if f["namespace"] != NAMESPACE:
        return {"status": "invalid", "records": 0, "reason": "not in the standard sitemap namespace"}
    if not f["containers"]:
        return {"status": "invalid", "records": 0, "reason": "no loc entries"}
    return {"status": "collected", "records": f["containers"], "reason": ""}
