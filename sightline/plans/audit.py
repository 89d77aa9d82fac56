"""The audit: inventories, sitemaps and saved pages to findings, page rows and a decision."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import config as C
from sightline.config import SiteConfig
from sightline.functions import text as T
from sightline.functions import urls as U
from sightline.operators import gates, graph, merge, pages, similarity
from sightline.operators.lineage import bounded, cut
from sightline.sources import manifest, sinks
from sightline.sources.exports import document_value, exact, inventory_rows, is_table, json_rows, table_rows
from sightline.sources.sitemaps import load_sitemaps

KNOWN = "url, title, h1, cluster, post_type, top_queries, lane, latest_clicks, latest_impressions, since_work_clicks, since_work_impressions, inventory_word_count, inventory_link_count, in_sitemap, src_ord, row_ord"
METRICS = {
    "latest_clicks": ("latestClicks", "clicks"), "latest_impressions": ("latestImpressions", "impressions"), "since_work_clicks": ("sinceWorkClicks",),
    "since_work_impressions": ("sinceWorkImpressions",), "inventory_word_count": ("wordCount", "word_count"), "inventory_link_count": ("linkCount", "link_count", "links"),
}


@dataclass
class Audit:
    """The audit's tables and its one-row decision."""

    findings: DataFrame
    pages: DataFrame
    links: DataFrame
    decision: dict
    universe: manifest.Universe
    contract: dict
    schema_types: DataFrame
    inputs: dict = field(default_factory=dict)


def inventory_records(rows: DataFrame, site: str, src_ord: int) -> DataFrame:
    """Audit-side rows (KNOWN) of one inventory, off-site addresses dropped."""
    raw = F.col("raw")
    url = U.normalize(exact(raw, *C.URL_FIELDS), site)
    read = rows.withColumn("url", url).where((F.coalesce(F.col("url"), F.lit("")) != "") & T.same_site(F.col("url"), F.lit(site)))
    texts = {"title": ("title", "yoastTitle"), "h1": ("h1",), "cluster": ("strategicCluster", "cluster", "sourceCluster"), "post_type": ("postType", "post_type"), "top_queries": ("topQueries", "top_queries"), "lane": ("mechanismLane", "mechanism", "lane")}
    marked = T.boolish(F.coalesce(exact(raw, "inSitemap"), exact(raw, "in_sitemap"))) | (F.coalesce(raw["sitemap"], F.lit("")) != "")
    return read.select(
        "url", *[F.coalesce(F.trim(exact(raw, *n)), F.lit("")).alias(c) for c, n in texts.items()], *[T.numeric(exact(raw, *n)).alias(c) for c, n in METRICS.items()],
        marked.alias("in_sitemap"), F.lit(src_ord).alias("src_ord"), "row_ord",
    )


def bare_records(urls: DataFrame, src_ord: int, in_sitemap: bool = False) -> DataFrame:
    """Audit-side rows that name a URL only."""
    return urls.select(
        "url", *[F.lit("").alias(c) for c in ("title", "h1", "cluster", "post_type", "top_queries", "lane")], *[F.lit(0.0).alias(c) for c in METRICS],
        F.lit(in_sitemap).alias("in_sitemap"), F.lit(src_ord).alias("src_ord"), F.lit(0).cast("long").alias("row_ord"),
    )


def page_cache(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Snapshots of a saved cache, one a URL: of rows with the same URL the last.

    A cache is one JSON document, or at any size a table of rows: JSON lines or Parquet, as the writer makes them.
    """
    if is_table(spark, path):
        rows, default = table_rows(spark, path), F.lit(False)
    else:
        rows = json_rows(spark, path, ("pages", "rows"), lone=False)
        default = T.boolish(F.lit(document_value(spark, path, "html_complete")))
    raw = F.col("raw")
    told = exact(raw, *C.HTML_COMPLETE_FIELDS)
    read = rows.withColumn("url", U.normalize(exact(raw, *C.URL_FIELDS), site))
    read = read.where((F.coalesce(F.col("url"), F.lit("")) != "") & T.same_site(F.col("url"), F.lit(site)))
    snapshot = F.struct(
        T.numeric(raw["status"]).cast("int").alias("status"), U.normalize(F.coalesce(exact(raw, "final_url"), exact(raw, "finalUrl"), F.col("url")), site).alias("final_url"),
        F.coalesce(exact(raw, *C.HTML_FIELDS), F.lit("")).alias("html"), F.when(told.isNotNull(), T.boolish(told)).otherwise(default).alias("html_complete"),
        T.boolish(raw["truncated"]).alias("truncated"), T.boolish(raw["conflicting_snapshots"]).alias("conflicting_snapshots"),
    )
    return merge.last_snapshots(read.select("url", "row_ord", snapshot.alias("s")))


def audit(spark: SparkSession, config: SiteConfig, inventories: list[str], sitemaps: list[str] = (), cache_path: str | None = None, manifest_path: str | None = None) -> Audit:
    """Run an audit over files. Only counts, gates and samples come to the driver."""
    bounded(spark)
    site = U.identity(config.site, config.site)
    config = SiteConfig(**{**asdict(config), "site": site})
    declared = [inventory_records(inventory_rows(spark, p), site, k) for k, p in enumerate(inventories)]
    maps = load_sitemaps(spark, list(sitemaps), site)
    listed = bare_records(maps["urls"], len(declared), in_sitemap=True)
    from_inventories = reduce(DataFrame.unionByName, declared) if declared else listed.limit(0)
    observed = gates.observed_identities(from_inventories, maps["urls"])
    cache = page_cache(spark, cache_path, site) if cache_path else None
    hashes = {"inventories": [h for p in inventories for h in sinks.file_hashes(spark, p)], "page_cache": sinks.file_hashes(spark, cache_path) if cache_path else [], "sitemaps": maps["hashes"]}
    if manifest_path:
        body = bytes(spark.read.format("binaryFile").load(manifest_path).first()["content"])
        universe = manifest.bind(body, site, hashes["inventories"], hashes["page_cache"], hashes["sitemaps"], observed)
    else:
        universe = manifest.Universe(observed=observed)
    hashes["source_manifest"] = universe.sha256
    accepted = {r["src_ord"]: r["n"] for r in from_inventories.groupBy("src_ord").agg(F.count(F.lit(1)).alias("n")).collect()}
    inputs = {
        "inventories": [{"rows": inventory_rows(spark, p).count(), "accepted": accepted.get(k, 0)} for k, p in enumerate(inventories)],
        "sitemaps_resolved": len(maps["resolved"]), "sitemaps_unresolved": len(maps["unresolved"]), "network_enabled": False,
        "mode": "saved_html_cache" if cache_path else "local_coverage",
    }
    return run(spark, config, from_inventories.unionByName(listed), cache, universe, len(maps["unresolved"]), hashes, inputs)


def run(spark: SparkSession, config: SiteConfig, records: DataFrame, cache: DataFrame | None, universe: manifest.Universe, unresolved: int = 0, hashes: dict | None = None, inputs: dict | None = None) -> Audit:
    """The audit over DataFrames: records (KNOWN) and snapshots."""
    bounded(spark)
    site = config.site
    if cache is None:
        cache = spark.createDataFrame([], "url string, status int, final_url string, html string, html_complete boolean, truncated boolean, conflicting_snapshots boolean")
    last = 1_000_000
    rows = cut(records.unionByName(bare_records(cache, last)))
    known = cut(merge.known_identities(rows))
    # Parsing is the one costly step; everything below reads its result.
    analyses = cut(pages.analyse(cache, known, config))
    links = cut(pages.links_of(analyses, site))
    found = cut(pages.discovered(known, analyses, links, site))
    universe.discovered = found.count()
    known = cut(merge.known_identities(rows.unionByName(bare_records(found, last + 1))))
    state = universe_row(spark, universe)
    cover = gates.coverage(known, analyses, site, unresolved).withColumn("_one", F.lit(1))
    decision = gates.decide(cover.join(state.withColumn("_one", F.lit(1)), "_one").drop("_one")).first().asDict()
    complete = decision["release_gate_passed"]

    counts = cut(graph.counters(links))
    start = analyses.where((F.col("url") == site) & F.col("html_available")).select("url")
    depth = graph.depths(links, analyses.select("url"), start)
    parts = [
        pages.parse_findings(analyses, config), graph.link_findings(links, analyses), graph.topology_findings(analyses, counts, depth, site, complete),
        similarity.exact_findings(analyses), similarity.near_findings(analyses, config), similarity.overlap_findings(known, analyses, config), gate_findings(spark, universe, decision, found, analyses),
    ]
    if complete:
        parts.append(graph.opportunities(known, analyses, counts, links, config))
    decision |= {"expected_count_origin": universe.origin}
    types = pages.schema_types(analyses).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    found_all = cut(reduce(DataFrame.unionByName, parts))
    return Audit(found_all, page_rows(known, analyses, counts, depth).orderBy("url"), links, decision, universe, gates.contract(decision, hashes or {}), types, inputs or {})


def write_audit(spark: SparkSession, done: Audit, folder: str) -> dict:
    """audit.json and decision.json, the three tables as CSV, the report and the dashboard; the audit document is returned.

    Tables of any size are files of their own; the document has their counts only.
    """
    counted = lambda rows, c: {r[c]: r["n"] for r in rows.orderBy(c).collect()}
    table = cut(done.pages)
    document = {
        "site": done.universe.site, "mode": done.inputs.get("mode"), "inputs": done.inputs, "coverage": {c: done.decision.get(c) for _, c in sinks.COVERAGE},
        "scope_reasons": done.universe.reasons, "sources": [sinks.public_source(s) for s in done.universe.sources], "release_contract": done.contract,
        "lane_counts": counted(sinks.lane_counts(table), "lane"), "schema_type_counts": counted(done.schema_types, "type"),
        "finding_counts": counted(sinks.finding_counts(done.findings), "type"), "tables": ["pages.csv", "links.csv", "findings.csv"],
    }
    sinks.write_json(spark, f"{folder}/audit.json", document)
    sinks.write_json(spark, f"{folder}/decision.json", done.contract)
    sinks.write_csv(table.orderBy("url"), f"{folder}/pages.csv")
    sinks.write_csv(done.links, f"{folder}/links.csv")
    sinks.write_csv(done.findings, f"{folder}/findings.csv")
    sinks.write_text(spark, f"{folder}/report.md", sinks.report(done.decision, done.findings))
    sinks.write_text(spark, f"{folder}/dashboard.html", sinks.dashboard(sinks.public_payload(done.decision, done.findings, table, sources=done.universe.sources)))
    return document


def universe_row(spark: SparkSession, u: manifest.Universe) -> DataFrame:
    row = (u.declared, len(u.sources), u.declared_complete, u.required, u.required_complete, u.site_matches, u.inventory_bound, u.page_cache_bound, u.sitemap_bound, u.expected, u.observed, u.discovered, u.complete, u.assurance)
    return spark.createDataFrame([row], "declared boolean, source_rows int, declared_complete boolean, required int, required_complete boolean, site_matches boolean, inventory_bound boolean, page_cache_bound boolean, sitemap_bound boolean, expected long, observed long, discovered long, source_universe_complete boolean, scope_assurance string")


def gate_findings(spark: SparkSession, u: manifest.Universe, d: dict, found: DataFrame, analyses: DataFrame) -> DataFrame:
    """What the gates withhold, and why."""
    out = []
    if u.discovered:
        out.append(("source_universe_contradicted", "high", f"{u.discovered} undeclared page-like identities were found; sample={pages.sample_of(found)}"))
    if d["conflicting"]:
        out.append(("cache_snapshot_conflict", "high", f"{d['conflicting']} URL(s) have conflicting crawler snapshots; sample={pages.sample_of(analyses.where('conflicting_snapshots'))}"))
    if d["excluded_html"]:
        out.append(("html_evidence_excluded", "info", f"{d['excluded_html']} cache record(s) hold HTML that is no evidence for the coverage gate"))
    if not u.complete:
        kind = "source_universe_incomplete" if u.declared else "source_universe_not_declared"
        out.append((kind, "info", f"incomplete required sources={', '.join(s['id'] for s in u.incomplete) or 'none'}; reasons={'; '.join(u.reasons)}"))
    if not d["release_gate_passed"]:
        out.append(("graph_claims_withheld", "info", f"active HTML coverage={d['html_coverage']:.2%} ({d['html_pages']}/{d['graph_eligible_urls']}); known URLs={d['known_urls']}"))
    rows = [(t, s, "withheld", None, None, None, None, None, e) for t, s, e in out]
    return spark.createDataFrame(rows, pages.FINDING)


def page_rows(known: DataFrame, analyses: DataFrame, counts: DataFrame, depth: DataFrame) -> DataFrame:
    """One row for each known URL with everything that is known of it."""
    types = pages.schema_types(analyses).groupBy("url").agg(F.array_sort(F.collect_set("type")).alias("schema_types"))
    a = analyses.select("url", *[F.col(c).alias(f"a_{c}") for c in ("title", "h1", "status", "lane", "cluster", "html_available", "noindex", "canonical", "word_count")])
    both = known.join(a, "url", "left").join(counts, "url", "left").join(depth, "url", "left").join(types, "url", "left")
    full = lambda c: F.when(F.coalesce(F.col(f"a_{c}"), F.lit("")) != "", F.col(f"a_{c}")).otherwise(F.col(c))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select(
        "url", T.path_of(F.col("url")).alias("path"), full("title").alias("title"), full("h1").alias("h1"), F.col("a_status").alias("status"),
        full("lane").alias("lane"), full("cluster").alias("cluster"), "in_sitemap", F.coalesce("a_html_available", F.lit(False)).alias("html_available"),
        F.coalesce("a_noindex", F.lit(False)).alias("noindex"), F.coalesce("a_canonical", F.lit("")).alias("canonical"),
        F.coalesce(F.col("a_word_count").cast("long"), F.col("inventory_word_count").cast("long")).alias("word_count"),
        zero("inbound_total"), zero("inbound_content"), zero("outbound_total"), "depth",
        F.coalesce("schema_types", F.array().cast("array<string>")).alias("schema_types"), "latest_impressions", "latest_clicks", "source_count",
    )
