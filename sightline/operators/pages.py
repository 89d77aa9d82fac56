"""Page analyses: what each cached snapshot proves, its parsed facts, links and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from sightline import config as C
from sightline.config import SiteConfig
from sightline.functions import text as T
from sightline.functions import urls as U
from sightline.functions.html import BLOCK, parse_page

FINDING = "type string, severity string, status string, url string, source string, target string, urls array<string>, sources array<string>, evidence string"
#: A finding's parts that differ by row, and a page's warning or one of its blocks.
TOLD = "array<struct<type:string,severity:string,status:string,evidence:string>>"
EACH = S.ArrayType(S.StructType([S.StructField("warning", S.StringType()), S.StructField("b", BLOCK)]))
_FIELDS = ("url", "source", "target", "urls", "sources", "evidence")


def finding(rows: DataFrame, kind: str | Column, severity: str | Column, status: str | Column, **fields: Column) -> DataFrame:
    """Rows of the common findings schema."""
    named = lambda v, name: (F.lit(v) if isinstance(v, str) else v).alias(name)
    lists = ("urls", "sources")
    given = [fields.get(c, F.lit(None)).cast("array<string>" if c in lists else "string").alias(c) for c in _FIELDS]
    return rows.select(named(kind, "type"), named(severity, "severity"), named(status, "status"), *given)


def analyse(cache: DataFrame, known: DataFrame, config: SiteConfig) -> DataFrame:
    """One row for each cached URL; only usable HTML is parsed, and the parsed struct is null otherwise."""
    site = F.lit(config.site)
    page = cache
    ended = F.when(F.coalesce(F.col("final_url"), F.lit("")) == "", F.col("url")).otherwise(F.col("final_url"))
    page = page.withColumn("final_url", ended).withColumn("identity_redirect", F.coalesce(U.normalize(F.col("final_url"), site) != F.col("url"), F.lit(True)))
    html = F.coalesce(F.col("html"), F.lit(""))
    usable = (html != "") & F.col("html_complete") & (F.col("status") >= 200) & (F.col("status") < 300) & T.same_origin(F.col("final_url"), site) & ~F.col("identity_redirect") & ~F.col("truncated") & ~F.col("conflicting_snapshots")
    page = page.withColumn("html_available", F.coalesce(usable, F.lit(False))).withColumn("html_present", html != "")
    page = page.withColumn("same_origin_identity_redirect", F.col("identity_redirect") & T.same_origin(F.col("final_url"), site))
    # Parsed in one pass, in which unusable pages are empty; the markup goes no further, and only facts meet what is known.
    parsed = parse_page(F.when(F.col("html_available"), F.col("html")), "final_url")
    page = page.withColumn("p", parsed).drop("html").withColumn("p", F.when(F.col("html_available"), F.col("p")))
    record = known.select("url", *[F.col(c).alias(f"k_{c}") for c in ("title", "h1", "lane", "cluster", "post_type", "inventory_word_count")])
    page = page.join(record, "url", "left")
    full = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.coalesce(b, F.lit("")))
    canonical = F.when(F.coalesce(F.col("p.canonical"), F.lit("")) != "", U.normalize(F.col("p.canonical"), site)).otherwise(F.lit(""))
    spoken = full(F.col("p.content_text"), F.col("p.visible_text"))
    own = F.when(F.coalesce(F.col("k_lane"), F.lit("")) != "", F.col("k_lane")).otherwise(T.infer_lane(F.col("url"), F.lit(""), F.lit("")))
    page = page.withColumn("tokens", T.tokenize(spoken)).withColumn("own_lane", own)
    lane = F.when(F.col("html_available"), T.infer_lane(F.col("url"), F.col("own_lane"), F.col("k_post_type"))).otherwise(F.col("own_lane"))
    return page.select(
        "url", T.path_of(F.col("url")).alias("path"), "status", "final_url", "html_available", "html_present", "html_complete",
        "truncated", "conflicting_snapshots", "identity_redirect", "same_origin_identity_redirect",
        full(F.col("p.title"), F.col("k_title")).alias("title"), full(F.col("p.h1"), F.col("k_h1")).alias("h1"),
        F.coalesce(canonical, F.lit("")).alias("canonical"), F.lower(F.coalesce(F.col("p.robots"), F.lit(""))).contains("noindex").alias("noindex"),
        F.coalesce(F.col("p.lang"), F.lit("")).alias("lang"), lane.alias("lane"), F.coalesce("k_cluster", F.lit("")).alias("cluster"),
        F.when(F.col("html_available"), F.size("tokens")).otherwise(F.coalesce(F.col("k_inventory_word_count").cast("int"), F.lit(0))).alias("word_count"),
        F.when(F.col("html_available"), F.col("tokens")).otherwise(F.array().cast("array<string>")).alias("tokens"),
        F.col("p.links").alias("raw_links"), F.col("p.blocks").alias("blocks"), F.col("p.warning").alias("warning"),
    )


def links_of(analyses: DataFrame, site: str) -> DataFrame:
    """source, target, anchor, rel, location of every internal link; repeats stay."""
    rows = analyses.where("html_available").select(F.col("url").alias("source"), F.explode("raw_links").alias("l"))
    found = rows.select("source", U.normalize(F.col("l.target"), site).alias("target"), "l.anchor", "l.rel", "l.location")
    return found.where((F.coalesce("target", F.lit("")) != "") & T.same_site(F.col("target"), F.lit(site)))


def parse_findings(analyses: DataFrame, config: SiteConfig) -> DataFrame:
    """Warnings of the parser and findings about structured data, in one pass: pages that are not written yet are parsed once."""
    blocks = F.when(F.col("html_available"), F.col("blocks"))
    # A page is a row of its own, for its warning, and a row for each of its blocks.
    page_itself = F.array(F.struct(F.col("warning"), F.lit(None).cast(BLOCK).alias("b")))
    each = F.concat(page_itself, F.coalesce(F.transform(blocks, lambda b: F.struct(F.lit(None).cast("string").alias("warning"), b.alias("b"))), F.array().cast(EACH)))
    rows = analyses.select("url", F.when(F.col("h1") != "", F.col("h1")).otherwise(F.col("title")).alias("shown"), F.explode(each).alias("r")).select("url", "shown", "r.warning", "r.b")
    ok = F.expr("b is not null and b.error is null")
    named = ok & F.expr("b.is_object and b.headline is not null")
    tokens = lambda c: T.signal_set(T.tokenize(F.when(named, c)), config.brand_terms)
    rows = rows.withColumn("x", tokens(F.col("b.headline"))).withColumn("y", tokens(F.col("shown")))
    differing = named & (F.size("x") > 0) & (F.size("y") > 0) & (T.jaccard(F.col("x"), F.col("y")) < 0.2)
    at = F.concat(F.lit("JSON-LD block "), F.col("b.at"))
    told = lambda kind, severity, status, evidence: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(status).alias("status"), evidence.alias("evidence"))
    rules = (
        (F.col("warning").isNotNull(), told("html_parse_warning", "low", "confirmed", F.col("warning"))),
        (F.col("b.error").isNotNull(), told("schema_parse_error", "high", "confirmed", F.col("b.error"))),
        (ok & F.expr("b.is_object and not b.has_context"), told("schema_context_candidate", "medium", "candidate", F.concat(at, F.lit(" lacks @context at its root")))),
        (ok & F.expr("size(b.types) = 0"), told("schema_missing_type", "medium", "confirmed", F.concat(at, F.lit(" lacks @type")))),
        (differing, told("schema_visible_mismatch_candidate", "medium", "candidate", F.concat(F.lit("schema="), F.col("b.headline"), F.lit(" | visible="), F.col("shown")))),
    )
    relative = F.when(ok, F.transform("b.relative", lambda r: told("schema_relative_url_candidate", "low", "candidate", r)))
    found = F.concat(F.array_compact(F.array(*[F.when(holds, f) for holds, f in rules])), F.coalesce(relative, F.array().cast(TOLD)))
    rows = rows.select("url", F.explode(found).alias("f"))
    return finding(rows, F.col("f.type"), F.col("f.severity"), F.col("f.status"), url=F.col("url"), evidence=F.col("f.evidence"))


def schema_types(analyses: DataFrame) -> DataFrame:
    """url, type of every structured-data type, repeats kept."""
    return analyses.where("html_available").select("url", F.explode(F.flatten(F.transform("blocks", lambda b: b["types"]))).alias("type"))


def discovered(known: DataFrame, analyses: DataFrame, links: DataFrame, site: str) -> DataFrame:
    """Page-like URLs of the site that evidence names and no source declared: url, evidence (kinds)."""
    told = links.select(F.col("target").alias("url"), F.lit("internal_link").alias("kind"))
    told = told.unionByName(analyses.where("identity_redirect").select(F.col("final_url").alias("url"), F.lit("redirect_final_url").alias("kind")))
    told = told.unionByName(analyses.where("canonical <> ''").select(F.col("canonical").alias("url"), F.lit("canonical").alias("kind")))
    ours = told.where(T.same_origin(F.col("url"), F.lit(site)) & T.is_page_like(F.col("url")))
    # A row for each address before known ones are sought, not one for each link.
    each = ours.groupBy("url").agg(F.array_sort(F.collect_set("kind")).alias("evidence"))
    return each.join(known.select("url"), "url", "left_anti")


def sample_of(rows: DataFrame, n: int = 5) -> str:
    return ", ".join(r["url"] for r in rows.select("url").orderBy("url").limit(n).collect())


def exact_hash(analyses: DataFrame) -> DataFrame:
    return analyses.where(f"status = 200 and not noindex and size(tokens) >= {C.EXACT_TOKENS}").select("url", T.text_hash(F.col("tokens")).alias("text_hash"))
