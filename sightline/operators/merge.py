"""Merging records of one URL: within a file, across files, and page snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.functions import text as T
from sightline.operators.adapt import FIRST_SEEN, LARGEST, SUMMED, TEXTS


def first_text(c: str, *order: str) -> Column:
    """The first non-empty value in arrival order."""
    return F.expr(f"min_by(`{c}`, struct({', '.join(order)})) filter (where trim(`{c}`) <> '')")


def _queries() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set("queries")))).alias("queries")


def within_file(records: DataFrame, kind: str) -> DataFrame:
    """One record for each file and URL."""
    if kind == "gsc":
        return search_totals(records)
    metric = F.sum if kind == "ga4" else F.max
    return records.groupBy("src_ord", "url").agg(
        *[first_text(c, "row_ord").alias(c) for c in TEXTS],
        *[F.greatest(metric(c), F.lit(0.0) if kind != "ga4" else metric(c)).alias(c) for c in SUMMED],
        *[F.max(F.greatest(F.col(c), F.lit(0.0))).alias(c) for c in LARGEST],
        *[F.min_by(c, "row_ord").alias(c) for c in FIRST_SEEN],
        _queries(),
    )


def search_totals(records: DataFrame) -> DataFrame:
    """Clicks and impressions summed, their ratio, and the position weighted by impressions; texts are not taken."""
    clicks, shown = (F.greatest(F.col(c), F.lit(0.0)) for c in ("latestClicks", "latestImpressions"))
    ranked = (shown > 0) & (F.col("gscPosition") > 0)
    totals = records.groupBy("src_ord", "url").agg(
        F.sum(clicks).alias("latestClicks"), F.sum(shown).alias("latestImpressions"),
        F.sum(F.when(ranked, F.col("gscPosition") * shown)).alias("_weight"), F.sum(F.when(ranked, shown)).alias("_shown"), _queries(),
    )
    nothing = {c: F.lit(None).cast("string") for c in TEXTS} | {c: F.lit(0.0) for c in (*SUMMED[2:], *LARGEST)}
    ratio = F.when(F.col("latestImpressions") > 0, F.col("latestClicks") / F.col("latestImpressions")).otherwise(0.0)
    place = F.when(F.col("_shown") > 0, F.col("_weight") / F.col("_shown")).otherwise(0.0)
    return totals.select("src_ord", "url", "latestClicks", "latestImpressions", ratio.alias("gscCtr"), place.alias("gscPosition"), *[v.alias(c) for c, v in nothing.items()], "queries")


def across_files(parts: DataFrame) -> DataFrame:
    """One record for each URL of per-file records (with kind and source_id).

    Search metrics come from one file as a whole: the one with most impressions,
    ties to the smallest fingerprint of its figures; they replace what any other
    source says. Everything else is the largest, first or united.
    """
    search = F.col("kind") == "gsc"
    shown = F.to_json(F.struct("latestClicks", "latestImpressions", "gscCtr", "gscPosition", "queries"))
    picked = F.struct("latestClicks", "latestImpressions", "gscCtr", "gscPosition", "source_id")
    merged = parts.groupBy("url").agg(
        F.min_by(F.when(search, picked), F.when(search, F.struct(-F.col("latestImpressions"), F.sha2(shown, 256)))).alias("_search"),
        *[first_text(c, "src_ord").alias(c) for c in TEXTS],
        *[F.greatest(F.max(F.when(~search, F.col(c))), F.lit(0.0)).alias(f"_{c}") for c in SUMMED],
        *[F.max(c).alias(c) for c in LARGEST],
        *[F.min_by(F.when(~search, F.col(c)), F.when(~search, F.col("src_ord"))).alias(f"_{c}") for c in FIRST_SEEN],
        _queries(),
        F.array_sort(F.collect_set("kind")).alias("types"), F.array_sort(F.collect_set("source_id")).alias("ids"),
        F.min("src_ord").alias("first_src"),
    )
    taken = ("latestClicks", "latestImpressions", "gscCtr", "gscPosition")
    chosen = {c: F.coalesce(F.col(f"_search.{c}"), F.col(f"_{c}"), F.lit(0.0)) for c in taken} | {c: F.coalesce(F.col(f"_{c}"), F.lit(0.0)) for c in SUMMED[2:]}
    return merged.select("url", *TEXTS, *[v.alias(c) for c, v in chosen.items()], *LARGEST, F.col("_search.source_id").alias("gscMetricSource"), "queries", "types", "ids", "first_src")


def tier(snapshot: Column) -> Column:
    """How much a snapshot claims; the least is believed when freshness is unknown."""
    status = snapshot["status"]
    return F.when((status < 200) | (status >= 300), 0).when(F.coalesce(snapshot["html"], F.lit("")) == "", 1).when(snapshot["html_complete"].isNull(), 2).otherwise(3)


def conservative_snapshot(snapshots: DataFrame) -> DataFrame:
    """One snapshot for each URL (url, source_id, snapshot), taken whole, with what disagreed."""
    s = F.col("snapshot")
    print_of = F.sha2(F.to_json(F.struct("url", "snapshot")), 256)
    keyed = snapshots.withColumn("_fp", print_of)
    order = F.struct(tier(s).alias("t"), s["status"].alias("s"), T.text_of(s["final_url"]).alias("f"), F.col("_fp"), "src_ord", "row_ord")
    # Chosen and counted on keys; the pages themselves are dealt once, to meet the choice.
    best = keyed.groupBy("url").agg(
        F.min(order).alias("b"), (F.count_distinct("_fp") > 1).alias("conflicting_snapshots"), F.count(F.lit(1)).cast("int").alias("candidate_count"),
        F.array_sort(F.collect_set("source_id")).alias("observed_source_ids"),
    )
    best = best.select("url", F.col("b.src_ord").alias("src_ord"), F.col("b.row_ord").alias("row_ord"), "conflicting_snapshots", "candidate_count", "observed_source_ids")
    return snapshots.join(best, ["url", "src_ord", "row_ord"]).select(
        "url", "snapshot.status", "snapshot.final_url", "snapshot.html", "snapshot.html_complete", F.col("source_id").alias("selected_source_id"),
        "observed_source_ids", F.col("observed_source_ids").alias("source_ids"), "candidate_count", "conflicting_snapshots",
    )


def source_statistics(raw: DataFrame, accepted: DataFrame, parts: DataFrame) -> DataFrame:
    """records, accepted, rejected, unique_urls and unique_urls_added of each source."""
    first = F.min("src_ord").over(Window.partitionBy("url"))
    new = parts.withColumn("_first", first).groupBy("src_ord").agg(F.count(F.lit(1)).alias("unique_urls"), F.count_if(F.col("_first") == F.col("src_ord")).alias("unique_urls_added"))
    counts = raw.groupBy("src_ord").agg(F.count(F.lit(1)).alias("records")).join(accepted.groupBy("src_ord").agg(F.count(F.lit(1)).alias("accepted")), "src_ord", "left").join(new, "src_ord", "left")
    filled = counts.na.fill(0, ["accepted", "unique_urls", "unique_urls_added"])
    return filled.select("src_ord", "records", "accepted", (F.col("records") - F.col("accepted")).alias("rejected"), "unique_urls", "unique_urls_added")


def known_identities(rows: DataFrame) -> DataFrame:
    """One record for each URL of audit-side rows, arriving in the order (src_ord, row_ord).

    Rows have url, source, title, h1, cluster, post_type, top_queries, lane, the
    six metrics and in_sitemap. The lane is fixed by the first row: its own, else
    what its post type or address says.
    """
    order = ("src_ord", "row_ord")
    metrics = ("latest_clicks", "latest_impressions", "since_work_clicks", "since_work_impressions", "inventory_word_count", "inventory_link_count")
    at = F.struct(*order)
    merged = rows.groupBy("url").agg(
        *[F.coalesce(first_text(c, *order), F.lit("")).alias(c) for c in ("title", "h1", "cluster", "post_type", "top_queries")],
        F.min_by(F.struct("lane", "post_type"), at).alias("_first"),
        *[F.greatest(F.max(c), F.lit(0.0)).alias(c) for c in metrics],
        F.coalesce(F.bool_or("in_sitemap"), F.lit(False)).alias("in_sitemap"),
        F.count(F.lit(1)).cast("int").alias("source_count"),
    )
    lane = T.infer_lane(F.col("url"), F.col("_first.lane"), F.col("_first.post_type"))
    return merged.withColumn("lane", lane).drop("_first")


def last_snapshots(rows: DataFrame) -> DataFrame:
    """Of snapshots (url, row_ord, s) with one URL the one that came last, as columns."""
    newest = Window.partitionBy("url").orderBy(F.col("row_ord").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("url", "s.*")
