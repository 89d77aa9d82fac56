"""Adapters: rows of an export as records of one fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import text as T
from sightline.functions import urls as U
from sightline.sources.exports import URL_KEYS, alias

# Output columns and the names under which exports carry them.
TEXT_ALIASES = {
    "title": ("title", "title 1", "seo title", "yoastTitle", "post_title", "live_title"),
    "h1": ("h1", "h1-1", "h1 1", "live_h1"),
    "postType": ("postType", "post_type", "type"),
    "mechanismLane": ("mechanismLane", "mechanism", "lane"),
    "strategicCluster": ("strategicCluster", "cluster", "sourceCluster"),
    "language": ("language", "language_code", "lang"),
    "sourceRecordId": ("sourceRecordId", "post_id", "id"),
    "sourceDecision": ("decision",),
    "canonical": ("canonical", "canonical link element 1"),
    "indexability": ("indexability",),
    "metaRobots": ("meta robots 1", "metaRobots", "robots"),
    "contentType": ("content type", "contentType", "mime_type", "mimeType"),
    "crawlerStatus": ("status code", "statusCode", "http status"),
}
NUMBER_ALIASES = {
    "latestClicks": ("latestClicks", "clicks"),
    "latestImpressions": ("latestImpressions", "impressions"),
    "wordCount": ("wordCount", "word count"),
    "linkCount": ("linkCount", "link count"),
    "gscCtr": ("ctr",),
    "gscPosition": ("position",),
    "ga4Sessions": ("sessions",),
    "ga4EngagedSessions": ("engagedSessions", "engaged sessions"),
    "ga4Views": ("views",),
    "crawlDepth": ("crawlDepth", "crawl depth"),
}
ADDRESSES = {
    "gsc": ("page", "url", "top_page"),
    "wordpress": ("live_url", "liveurl", "url", "permalink", "link"),
    "crawler": ("address", "url"),
    "ga4": ("landingPagePlusQueryString", "landingPage", "pagePathAndScreenClass", "landing", "url", "page"),
}
SUMMED = ("latestClicks", "latestImpressions", "ga4Sessions", "ga4EngagedSessions", "ga4Views")
LARGEST = ("wordCount", "linkCount", "crawlDepth")
FIRST_SEEN = ("gscCtr", "gscPosition")
TEXTS = (*TEXT_ALIASES, "finalUrl")


def distinct_rows(rows: DataFrame) -> DataFrame:
    """One of each set of equal rows of a file, the first."""
    fingerprint = F.sha2(F.to_json(F.array_sort(F.map_entries("raw"))), 256)
    first = Window.partitionBy("src_ord", "_fp").orderBy("row_ord")
    found = rows.select("src_ord", "keyed", "row_ord", fingerprint.alias("_fp")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return found.drop("_fp", "_n")


def _address(kind: str, m: Column) -> tuple[Column, Column]:
    """The row's address and its queries."""
    if kind != "gsc":
        given = alias(m, "topQueries", "top_queries")
        none = F.array().cast("array<string>")
        return alias(m, *ADDRESSES.get(kind, URL_KEYS)), F.when(given.isNotNull(), F.array(given)).otherwise(none)
    direct = alias(m, *ADDRESSES["gsc"])
    keys = F.filter(F.coalesce(F.from_json(m["keys"], "array<string>"), F.array().cast("array<string>")), lambda k: F.trim(k) != "")
    located = F.filter(keys, lambda k: F.trim(k).rlike("^(http://|https://|/)"))
    own = F.array_compact(F.array(alias(m, "query", "keyword")))
    # Of the keys the first that looks like an address is it, if no column gave one; all others are queries.
    spoken = F.when(direct.isNull() & (F.size(located) > 0), F.filter(keys, lambda k: k != located[0])).otherwise(keys)
    queries = F.array_distinct(F.concat(own, F.transform(spoken, F.trim)))
    topics = alias(m, "topQueries", "top_queries")
    fallback = F.array_compact(F.array(topics))
    return F.coalesce(direct, F.trim(located[0])), F.when(F.size(queries) > 0, queries).otherwise(fallback)


def adapt(rows: DataFrame, kind: str, site: str) -> DataFrame:
    """Records (url, texts, numbers, queries, snapshot) of the rows of one kind that belong to the site."""
    m = F.col("keyed")
    address, queries = _address(kind, m)
    read = rows.withColumn("url", U.normalize_export(address, site, alias(m, "hostname", "host")))
    read = read.where(F.coalesce(F.col("url"), F.lit("")) != "")
    if kind == "wordpress":
        read = read.where(~F.lower(F.trim(T.text_of(alias(m, "post_status", "postStatus", "status")))).isin(*C.NON_PUBLIC_STATUSES))
    if kind == "crawler":
        kind_of = F.lower(F.trim(T.text_of(alias(m, *TEXT_ALIASES["contentType"]))))
        read = read.where(F.when(kind_of != "", kind_of.contains("html")).otherwise(T.is_page_like(F.col("url"))))
    ended = alias(m, "final address", "final url", "finalUrl")
    read = read.withColumn("finalUrl", U.final_url(ended, F.col("url"), site))
    status = T.number(alias(m, "status code", "statusCode", "http status", "status")).cast("int")
    html = alias(m, "html", "rendered html", "body")
    evidence = (status >= 200) & (status < 300) & T.same_origin(F.col("finalUrl"), F.col("url"))
    kept = F.when(evidence, html)
    whole = F.when(kept.isNotNull() & T.explicit_true(alias(m, *C.HTML_COMPLETE_FIELDS)), F.lit(True))
    snapshot = F.when(F.lit(kind == "crawler"), F.struct(status.alias("status"), F.col("finalUrl").alias("final_url"), kept.alias("html"), whole.alias("html_complete")))
    return read.select(
        "src_ord", "row_ord", "url",
        *[F.trim(alias(m, *names)).alias(c) for c, names in TEXT_ALIASES.items()],
        "finalUrl",
        *[T.number(alias(m, *names)).alias(c) for c, names in NUMBER_ALIASES.items()],
        queries.alias("queries"), snapshot.alias("snapshot"),
    )
