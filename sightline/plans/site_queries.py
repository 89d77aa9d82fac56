"""More registered queries: scans and writers, identities, adapters, gates and topology, over rows of the shared tables.

Each runs the library's own operator on rows built from a table, and has SQL that
says the same of that table. Files that a scan needs are written to the shared
folder first, by the library's writers where it has them.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline import config as C
from sightline.config import SiteConfig
from sightline.functions import text as T
from sightline.functions import urls as U
from sightline.functions.html import parse_page
from sightline.operators import gates, graph, merge, pages, similarity
from sightline.operators.adapt import adapt, distinct_rows
from sightline.operators.lineage import cut
from sightline.plans import audit as auditing
from sightline.plans.queries import _BARE, _GENERIC, _NORM, _TOKENS, ORACLE, _page_links, _site_pages, query, table
from sightline.sources import exports, manifest, sinks, sitemaps

SITE = "https://shop.example/"


def _folder(spark: SparkSession) -> str:
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid4().hex}"


def _rows(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """What a check of a few values found, as a table."""
    return spark.createDataFrame(rows, schema)


# -- identities and values --------------------------------------------------


_TAIL = "o_orderkey::VARCHAR || CASE WHEN o_orderkey % 2 = 0 THEN '.html' ELSE '/' END"


@query(f"SELECT o_orderkey, 'https://shop.example' || CASE o_orderkey % 3 WHEN 1 THEN ':8443' ELSE '' END || '/o/caf%c3%a9/' || {_TAIL} AS id FROM orders")
def identity_ports_escapes(spark, sf_dir):
    """Addresses with ports, www, doubled slashes, escapes of either case, queries and fragments."""
    k = F.col("o_orderkey")
    port = F.when(k % 3 == 0, ":443").when(k % 3 == 1, ":8443").otherwise("")
    raw = F.concat(F.lit(" HTTPS://WWW.Shop.example"), port, F.lit("//o/"), F.when(k % 5 == 0, "caf%C3%A9").otherwise("café"), F.lit("//"), k, F.when(k % 2 == 0, ".html?x=1").otherwise("#top"))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.normalize(raw, SITE).alias("id"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'https://shop.example/o/' || o_orderkey || '/' WHEN 1 THEN 'https://shop.example/o/' || o_orderkey || '/' "
    "WHEN 4 THEN 'http://shop.example/o/' || o_orderkey || '.html' WHEN 5 THEN 'https://shop.example/o/' || o_orderkey || '/' ELSE '' END AS id FROM orders"
)
def export_identities(spark, sf_dir):
    """Cells of exports: paths with the host beside them, unset values, other schemes, other sites, quoted addresses."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("o/"), k)
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("//"), path, F.lit("/?a=1"))).when(k % 6 == 1, F.concat(F.lit("/"), path)).when(k % 6 == 2, F.lit("(not set)")).when(k % 6 == 3, F.lit("mailto:x@shop.example"))
        .when(k % 6 == 4, F.concat(F.lit("<http://www.shop.example/"), path, F.lit(".html>"))).otherwise(F.concat(F.lit("/"), path))
    )
    host = F.when(k % 6 == 0, F.lit("WWW.Shop.example")).when(k % 6 == 5, F.lit("")).otherwise(F.lit("shop.example:443"))
    return table(spark, sf_dir, "orders").select("o_orderkey", U.normalize_export(raw, SITE, host).alias("id"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = l_suppkey % 2 AND l_linenumber % 3 = l_suppkey % 3 AS one_origin, l_linenumber % 2 = l_suppkey % 2 AS one_site FROM lineitem")
def origin_pairs(spark, sf_dir):
    place = lambda k: F.concat(F.when(k % 3 == 0, "http://").when(k % 3 == 1, "https://").otherwise("HTTPS://"), F.when(k % 2 == 0, "a.example").otherwise("B.example"), F.when(k % 3 == 0, ":80/x").when(k % 3 == 1, "/y").otherwise(":8443/"))
    a, b = place(F.col("l_linenumber")), place(F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.same_origin(a, b).alias("one_origin"), T.same_site(a, b).alias("one_site"))


@query(
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE floor(value) END AS number, event_id % 5 IN (0, 1, 2, 3) AS attested, "
    "CASE WHEN event_id % 3 = 0 THEN event_type ELSE user_id::VARCHAR END AS first FROM events"
)
def values_read(spark, sf_dir):
    """Plain numbers, attestations, and the first alias that is filled, as audits read them."""
    e, v = F.col("event_id"), F.col("value").cast("string")
    raw = F.when(e % 4 == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(e % 4 == 1, F.lit("nan")).when(e % 4 == 2, F.lit("1,5")).otherwise(F.floor("value").cast("string"))
    flag = F.when(e % 5 == 0, " Full ").when(e % 5 == 1, "1.0").when(e % 5 == 2, "ON").when(e % 5 == 3, "complete").otherwise("0")
    named = F.create_map(F.lit("firsturl"), F.when(e % 3 == 0, F.col("event_type")).otherwise(F.lit("  ")), F.lit("page"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.numeric(raw).alias("number"), T.explicit_true(flag).alias("attested"), exports.alias(named, "First URL", "page").alias("first"))


@query(
    "SELECT p_partkey, p_size % 4 IN (1, 3) AS page_like, p_size % 5 NOT IN (1, 2) AS content, "
    "CASE p_size % 3 WHEN 0 THEN 'commerce' WHEN 1 THEN 'lamp' ELSE 'content' END AS lane FROM part"
)
def page_kinds(spark, sf_dir):
    k = F.col("p_size")
    url = F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey"), F.when(k % 4 == 0, ".PDF").when(k % 4 == 1, ".html").when(k % 4 == 2, ".js/").otherwise("/"))
    lane = F.when(k % 5 == 0, "").when(k % 5 == 1, " Taxonomy").when(k % 5 == 2, "feed").otherwise("guide")
    kind = F.when(k % 3 == 0, " Product").when(k % 3 == 1, "Lamp").otherwise("article")
    bare = F.concat(F.lit("https://shop.example/p/"), F.col("p_partkey"), F.lit("/"))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_page_like(url).alias("page_like"), T.is_content_lane(lane).alias("content"), T.infer_lane(bare, F.lit(""), kind).alias("lane"))


# -- scans and writers ------------------------------------------------------


@query("SELECT n_name AS name, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN '''=' || n_regionkey ELSE n_regionkey::VARCHAR END AS cell FROM nation")
def csv_export_scan(spark, sf_dir):
    """A table through the CSV writer (formula guard, byte order mark) and the CSV scan."""
    n = table(spark, sf_dir, "nation")
    path = f"{_folder(spark)}/nation.csv"
    sinks.write_csv(n.select(F.col("n_name").alias("Nation Name"), F.col("n_nationkey").alias("Key"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("="), "n_regionkey")).otherwise(F.col("n_regionkey").cast("string")).alias("cell")), path)
    rows = exports.export_rows(spark, path)
    return rows.select(F.col("keyed")["nationname"].alias("name"), F.col("raw")["Key"].alias("key"), exports.exact(F.col("raw"), "none", "cell").alias("cell"))


@query("SELECT 'https://shop.example/n/' || n_nationkey AS url, n_name AS title, row_number() OVER (ORDER BY n_nationkey) - 1 AS place FROM nation")
def json_export_scan(spark, sf_dir):
    """A JSON document of rows by address, with nested rendered titles, through the JSON scan."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    path = f"{_folder(spark)}/export.json"
    sinks.write_json(spark, path, {"items": {f"https://shop.example/n/{r.n_nationkey}": {"Title": {"rendered": r.n_name}} for r in n}})
    rows = exports.export_rows(spark, path)
    return rows.select(F.col("raw")["url"].alias("url"), F.col("keyed")["title"].alias("title"), F.col("row_ord").alias("place"))


@query(
    f"SELECT {_NORM} AS url, CASE WHEN page_id % 3 = 0 THEN 404 ELSE 200 END AS status, sha256(CASE WHEN page_id % 3 = 0 THEN '' ELSE html END) AS html, page_id % 2 = 0 AND page_id % 3 <> 0 AS html_complete "
    f"FROM pages WHERE {_BARE} = (SELECT min({_BARE}) FROM pages)"
)
def page_cache_round_trip(spark, sf_dir):
    """Saved pages of one site through the cache writer and the cache scan."""
    rows = _site_pages(spark, sf_dir)
    host = rows.agg(F.min("host")).first()[0]
    gone, k = F.col("page_id") % 3 == 0, F.col("page_id")
    cache = rows.where(F.col("host") == host).select(F.col("id").alias("url"), F.when(gone, 404).otherwise(200).alias("status"), F.when(~gone, F.col("html")).alias("html"), F.when((k % 2 == 0) & ~gone, F.lit(True)).alias("html_complete"))
    path = f"{_folder(spark)}/page_cache"
    sinks.write_page_cache(cache, path, "parquet")
    read = auditing.page_cache(spark, path, f"https://{host}/")
    return read.select("url", "status", F.sha2("html", 256).alias("html"), "html_complete")


@query("SELECT 'https://shop.example/n/' || n_nationkey || '/' AS url FROM nation WHERE n_regionkey < 3")
def sitemap_urls(spark, sf_dir):
    """An index, two of its children, one that is missing, and locs of another namespace or site."""
    folder, space = _folder(spark), f"xmlns='{sitemaps.NAMESPACE}' xmlns:image='http://image.example/'"
    n = table(spark, sf_dir, "nation").collect()  # 25 rows
    part = lambda keep: f"<urlset {space}>" + "".join(f"<url><loc> https://www.shop.example/n/{r.n_nationkey} </loc><image:image><image:loc>https://shop.example/i.png</image:loc></image:image></url>" for r in n if keep(r)) + "<url><loc>https://other.example/</loc></url></urlset>"
    sinks.write_text(spark, f"{folder}/one.xml", part(lambda r: r.n_regionkey < 2))
    sinks.write_text(spark, f"{folder}/two.xml", part(lambda r: 1 <= r.n_regionkey < 3))
    sinks.write_text(spark, f"{folder}/index.xml", f"<sitemapindex {space}>" + "".join(f"<sitemap><loc>https://shop.example/maps/{c}.xml</loc></sitemap>" for c in ("one", "two", "gone")) + "</sitemapindex>")
    found = sitemaps.load_sitemaps(spark, [f"{folder}/index.xml"], SITE)
    if len(found["resolved"]) != 3 or len(found["unresolved"]) != 1:
        raise ValueError(f"sitemaps resolved otherwise than expected: {found['resolved']}, {found['unresolved']}")
    return found["urls"]


@query(
    "SELECT * FROM (VALUES ('plain', 'collected', 2::BIGINT), ('no namespace', 'invalid', 0), ('no loc', 'invalid', 0), ('broken', 'invalid', 0), ('feed', 'invalid', 0)) t(body, status, records)"
)
def sitemap_inspection(spark, sf_dir):
    space = f"xmlns='{sitemaps.NAMESPACE}'"
    bodies = {
        "plain": f"<urlset {space}><url><loc>a</loc></url><url><loc>b</loc></url><url/></urlset>", "no namespace": "<urlset><url><loc>a</loc></url></urlset>",
        "no loc": f"<urlset {space}><url><loc> </loc></url></urlset>", "broken": "<urlset", "feed": "<rss/>",
    }
    seen = {name: sitemaps.inspect_sitemap(body.encode()) for name, body in bodies.items()}
    return _rows(spark, [(name, s["status"], s["records"]) for name, s in seen.items()], "body string, status string, records long")


@query(
    "SELECT * FROM (VALUES ('gsc', 'gsc', ''), ('ga4', 'ga4', ''), ('crawler', 'crawler', ''), ('wordpress', 'wordpress', ''), ('inventory', 'inventory', ''), "
    "('other', 'inventory', 'columns do not match the declared inventory export shape')) t(file, kind, fault)"
)
def export_kinds(spark, sf_dir):
    """Kind and shape of exports by their column names."""
    heads = {"gsc": "Page,Clicks,Impressions", "ga4": "Landing page,Sessions", "crawler": "Address,Status Code", "wordpress": "live_url,post_status", "inventory": "URL,title", "other": "a,b"}
    folder, rows = _folder(spark), []
    for name, head in heads.items():
        sinks.write_text(spark, f"{folder}/{name}.csv", head + "\n" + ",".join("x" for _ in head.split(",")) + "\n")
        fields = exports.fields_of(exports.export_rows(spark, f"{folder}/{name}.csv"))
        kind = exports.detect_kind(fields)
        rows.append((name, kind, exports.shape_fault(kind, fields)))
    return _rows(spark, rows, "file string, kind string, fault string")


@query("SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey)) AS sha256 FROM nation GROUP BY n_regionkey")
def file_digests(spark, sf_dir):
    folder = _folder(spark)
    for r in table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n")).collect():  # five rows
        sinks.write_text(spark, f"{folder}/{r.n_regionkey}.txt", "\n".join(x.n_name for x in r.n))
    return _rows(spark, [(h,) for h in sinks.file_hashes(spark, folder)], "sha256 string")


# -- adapters and merges ----------------------------------------------------


def _export(spark, sf_dir) -> DataFrame:
    """Events as rows of an export (src_ord, row_ord, raw, keyed), every seventh row twice."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    cells = {
        "address": F.concat(F.lit("/e/"), k, F.when(k % 4 == 0, ".pdf").otherwise("")), "statuscode": F.when(k % 5 == 0, "404").otherwise("200"),
        "contenttype": F.when(k % 3 == 0, "Text/HTML; x").when(k % 3 == 1, "image/png").otherwise(""), "poststatus": F.when(k % 6 == 0, " Draft ").otherwise("publish"),
        "url": F.concat(F.lit("/e/"), k), "html": F.concat(F.lit("<p>"), k), "fullhtml": F.when(k % 2 == 0, "yes").otherwise(""),
        "finalurl": F.when(k % 7 == 0, F.lit("https://other.example/x")).when(k % 7 == 1, F.concat(F.lit("https://shop.example//e/"), k)).otherwise(F.lit("")),
    }
    keyed = F.create_map(*[x for n, c in cells.items() for x in (F.lit(n), c)])
    twice = F.explode(F.when(k % 7 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return e.select(F.lit(0).alias("src_ord"), (2 * k).alias("row_ord"), keyed.alias("raw"), keyed.alias("keyed"), twice.alias("copy")).withColumn("row_ord", F.col("row_ord") + F.col("copy")).drop("copy")


_CRAWLED = "(event_id % 3 = 0 OR (event_id % 3 = 2 AND event_id % 4 <> 0))"


@query(
    "SELECT event_id, 'https://shop.example/e/' || event_id || CASE WHEN event_id % 4 = 0 THEN '.pdf' ELSE '/' END AS url, "
    "CASE event_id % 7 WHEN 0 THEN 'https://other.example/x' WHEN 1 THEN 'https://shop.example/e/' || event_id || '/' ELSE 'https://shop.example/e/' || event_id || CASE WHEN event_id % 4 = 0 THEN '.pdf' ELSE '/' END END AS final_url, "
    "CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN '<p>' || event_id END AS html, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 2 = 0 AS html_complete "
    f"FROM events WHERE {_CRAWLED}"
)
def crawler_rows(spark, sf_dir):
    """Assets dropped, repeated rows once, final addresses placed, HTML kept only where it is evidence."""
    done = adapt(distinct_rows(_export(spark, sf_dir)), "crawler", SITE)
    return done.select((F.floor(F.col("row_ord") / 2)).cast("long").alias("event_id"), "url", F.col("snapshot.final_url").alias("final_url"), F.col("snapshot.html").alias("html"), F.coalesce(F.col("snapshot.html_complete"), F.lit(False)).alias("html_complete"))


@query("SELECT event_id, 'https://shop.example/e/' || event_id || '/' AS url FROM events WHERE event_id % 6 <> 0")
def public_posts(spark, sf_dir):
    """Posts that are not drafts."""
    done = adapt(distinct_rows(_export(spark, sf_dir)), "wordpress", SITE)
    return done.select((F.floor(F.col("row_ord") / 2)).cast("long").alias("event_id"), "url")


@query(
    "WITH r AS (SELECT o_custkey::VARCHAR AS url, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'guide' WHEN 'O' THEN '' ELSE 'Product' END AS post, o_orderkey % 3 = 0 AS listed, o_totalprice FROM orders), "
    "g AS (SELECT url, arg_min(post, o_orderkey) AS post, bool_or(listed) AS in_sitemap, max(o_totalprice) AS words, count(*)::INTEGER AS source_count, "
    "arg_min(post, o_orderkey) FILTER (post <> '') AS post_type FROM r GROUP BY 1) "
    "SELECT url, CASE post WHEN 'guide' THEN 'content' WHEN 'Product' THEN 'commerce' ELSE 'content' END AS lane, coalesce(post_type, '') AS post_type, in_sitemap, words, source_count FROM g"
)
def known_lane(spark, sf_dir):
    """One record for each URL: the first row fixes the lane, first texts, largest figures."""
    o = table(spark, sf_dir, "orders")
    post = F.when(F.col("o_orderstatus") == "F", "guide").when(F.col("o_orderstatus") == "O", "").otherwise("Product")
    rows = o.select(
        F.col("o_custkey").cast("string").alias("url"), *[F.lit("").alias(c) for c in ("title", "h1", "cluster", "top_queries", "lane")], post.alias("post_type"),
        *[F.lit(0.0).alias(c) for c in auditing.METRICS if c != "inventory_word_count"], F.col("o_totalprice").cast("double").alias("inventory_word_count"),
        (F.col("o_orderkey") % 3 == 0).alias("in_sitemap"), F.lit(0).alias("src_ord"), F.col("o_orderkey").alias("row_ord"),
    )
    done = merge.known_identities(rows)
    return done.select("url", "lane", "post_type", "in_sitemap", F.col("inventory_word_count").alias("words"), "source_count")


@query("SELECT o_custkey::VARCHAR AS url, arg_max(o_orderstatus, o_orderkey) AS final_url, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def last_row_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("url"), F.col("o_orderkey").alias("row_ord"), F.struct(F.col("o_orderstatus").alias("final_url"), F.col("o_totalprice").alias("price")).alias("s"))
    return merge.last_snapshots(rows)


# -- links and topology -----------------------------------------------------


_CODED = "array_to_string(list_transform(string_split({0}, ''), lambda c: CASE WHEN ord(c) > 127 THEN lower(url_encode(c)) WHEN c IN ('\"', ' ', '<', '>', '|', '`', '^', '{{', '}}', '\\') THEN lower(url_encode(c)) ELSE c END), '')"
_TARGET = (
    f"WITH h AS (SELECT page_id, {_BARE} AS host, {_NORM} AS source, regexp_extract(url, '^([A-Za-z]+)://', 1) AS scheme, html FROM pages), "
    "u AS (SELECT source, host, scheme, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS href FROM h), "
    f"p AS (SELECT source, host, scheme, {_CODED.format(chr(34) + 'plain' + chr(34))} AS path FROM (SELECT *, regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+', '/', 'g') AS plain FROM u)), "
    "t AS (SELECT source, host, scheme || '://' || host || CASE WHEN suffix(path, '/') OR regexp_matches(path, '\\.[A-Za-z0-9]{2,8}$') THEN path ELSE path || '/' END AS target FROM p) "
)


def _site_links(spark, sf_dir) -> DataFrame:
    links = _page_links(spark, sf_dir)
    target = U.normalize(F.col("target"), F.concat(F.lit("https://"), "host", F.lit("/")))
    return links.withColumn("target", target).where(T.bare_host(F.col("target")) == F.col("host"))


#: The same over links outside navigation and footers.
_CONTENT = _TARGET.replace("unnest(regexp_extract_all(html, ", "unnest(regexp_extract_all(regexp_replace(html, '<(nav|footer)[ >].*?</(nav|footer)>', '', 'gs'), ").replace("WITH ", "", 1)
for _name in ("h", "u", "p", "t"):
    _CONTENT = _CONTENT.replace(f"{_name} AS (SELECT", f"c{_name} AS (SELECT", 1).replace(f"FROM {_name})", f"FROM c{_name})").replace(f"FROM {_name} ", f"FROM c{_name} ")
ORACLE["inbound_outbound"] = (
    _TARGET + ", " + _CONTENT + "SELECT url, sum(i)::BIGINT AS inbound_total, sum(c)::BIGINT AS inbound_content, sum(o)::BIGINT AS outbound_total FROM "
    "(SELECT target AS url, 1 AS i, 0 AS c, 0 AS o FROM t UNION ALL SELECT source, 0, 0, 1 FROM t UNION ALL SELECT target, 0, 1, 0 FROM ct) GROUP BY 1"
)


@query(_TARGET + "SELECT url, sum(i)::BIGINT AS inbound_total, sum(o)::BIGINT AS outbound_total FROM (SELECT target AS url, 1 AS i, 0 AS o FROM t UNION ALL SELECT source, 0, 1 FROM t) GROUP BY 1")
def link_counters(spark, sf_dir):
    """Inbound and outbound links of every identity, from parsed pages."""
    return graph.counters(_site_links(spark, sf_dir)).select("url", "inbound_total", "outbound_total")


@query(_TARGET + "SELECT DISTINCT target AS url, 'internal_link' AS evidence FROM t WHERE target NOT IN (SELECT source FROM h) AND NOT regexp_matches(lower(target), '[^/.]\\.(" + "|".join(s[1:] for s in C.NON_PAGE_SUFFIXES) + ")/*$') AND prefix(target, (SELECT min(scheme || '://' || host || '/') FROM h))")
def discovered_pages(spark, sf_dir):
    """Addresses of one site that links name and no page row declares."""
    rows = _site_pages(spark, sf_dir)
    site = rows.agg(F.min(F.concat(F.regexp_extract("url", "^([A-Za-z]+)://", 1), F.lit("://"), "host", F.lit("/")))).first()[0]
    known = rows.select(F.col("id").alias("url"))
    links = _site_links(spark, sf_dir).select("source", "target")
    none = known.limit(0).select("url", F.lit("").alias("final_url"), F.lit("").alias("canonical"), F.lit(False).alias("identity_redirect"))
    return pages.discovered(known, none, links, site).select("url", F.array_join("evidence", ",").alias("evidence"))


def _steps(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts as pages: each links to twice its number and the one after, where a line item sells it; depth from part 1."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    links = part.where("p_size % 5 <> 0").select(F.col("k").alias("a"), F.explode(F.array(2 * F.col("k"), 2 * F.col("k") + 1)).alias("b"))
    links = links.join(part.select(F.col("k").alias("b")), "b")
    named = lambda c: F.concat(F.lit("p"), F.col(c))
    analyses = part.select(named("k").alias("url"), F.lit(200).alias("status"), F.lit(True).alias("html_available"), (F.col("p_size") == 7).alias("noindex"))
    return analyses, links.select(named("a").alias("source"), named("b").alias("target"), F.lit("content").alias("location")), analyses.where("url = 'p1'").select("url")


_STEPS = (
    "WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size FROM part), l AS (SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON b.k IN (2 * a.k, 2 * a.k + 1) WHERE a.p_size % 5 <> 0), "
    "w AS (SELECT 1::BIGINT AS k, 0 AS depth UNION ALL SELECT l.b, w.depth + 1 FROM w JOIN l ON l.a = w.k), n AS (SELECT k FROM p WHERE p_size <> 7 AND k <> 1) "
)


@query(
    _STEPS + "SELECT 'orphan_candidate' AS type, 'p' || k AS url FROM n WHERE k NOT IN (SELECT b FROM l) UNION ALL SELECT 'unreachable_from_home_candidate', 'p' || k FROM n WHERE k NOT IN (SELECT k FROM w) "
    "UNION ALL SELECT 'deep_page_candidate', 'p' || n.k FROM n JOIN w ON n.k = w.k WHERE depth > 3"
)
def orphans_unreachable_deep(spark, sf_dir):
    analyses, links, start = _steps(spark, sf_dir)
    depth = graph.depths(links, analyses.select("url"), start)
    return graph.topology_findings(analyses, graph.counters(links), depth, "p1", True).select("type", "url")


@query(_STEPS + "SELECT 'zero_inbound_partial' AS type, 'withheld' AS status, 'p' || k AS url FROM n WHERE k NOT IN (SELECT b FROM l)")
def orphans_withheld(spark, sf_dir):
    """With an incomplete graph only what was seen is told."""
    analyses, links, _ = _steps(spark, sf_dir)
    return graph.topology_findings(analyses, graph.counters(links), analyses.limit(0), "p1", False).select("type", "status", "url")


def _topic_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Suppliers as pages whose titles share words by number."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://shop.example/s/"), k, F.lit("/"))
    title = F.concat(F.lit("lantern"), k % 7, F.lit(" harbor"), k % 5, F.lit(" mooring"), k % 3)
    analyses = s.select(url.alias("url"), F.lit(200).alias("status"), F.lit(False).alias("noindex"), F.lit(True).alias("html_available"), title.alias("title"), F.lit("").alias("h1"), F.lit("content").alias("lane"), F.lit("en").alias("lang"))
    known = s.select(url.alias("url"), F.lit("").alias("top_queries"), (k % 11).cast("double").alias("latest_impressions"), F.lit("").alias("cluster"))
    return known, analyses


@query(
    "WITH s AS (SELECT s_suppkey AS k, 'https://shop.example/s/' || s_suppkey || '/' AS url, s_suppkey % 11 AS shown FROM supplier), "
    "c AS (SELECT t.url AS target, t.shown, x.url AS source, x.shown AS s_shown, (t.k % 7 = x.k % 7)::INT + (t.k % 5 = x.k % 5)::INT + (t.k % 3 = x.k % 3)::INT AS common "
    "FROM s t JOIN s x ON t.k <> x.k AND (t.k % 7 = x.k % 7 OR t.k % 5 = x.k % 5 OR t.k % 3 = x.k % 3) WHERE t.shown > 0 AND NOT (x.k = 1 AND t.k = 2)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY common / (6 - common) DESC, s_shown DESC, source DESC) AS place, count(*) OVER (PARTITION BY target) AS n FROM c) "
    "SELECT target, string_agg(source, ',' ORDER BY place) AS sources, 'latest impressions=' || any_value(shown) || '; contextual inbound=' || CASE WHEN target = 'https://shop.example/s/2/' THEN 1 ELSE 0 END || '; topical source candidates=' || any_value(n) AS evidence "
    "FROM r WHERE place <= 3 GROUP BY target ORDER BY any_value(shown) DESC, CASE WHEN target = 'https://shop.example/s/2/' THEN 1 ELSE 0 END, target LIMIT 50"
)
def top_opportunities(spark, sf_dir):
    """Pages with search interest and few links in text, and the three best pages that could link to them."""
    known, analyses = _topic_pages(spark, sf_dir)
    links = spark.createDataFrame([("https://shop.example/s/1/", "https://shop.example/s/2/", "content")], "source string, target string, location string")
    found = graph.opportunities(known, analyses, graph.counters(links), links, SiteConfig(SITE))
    return found.select("target", F.array_join("sources", ",").alias("sources"), "evidence")


@query("SELECT sha256(url) AS url, urls FROM (SELECT min(d) AS url, string_agg(d, ',' ORDER BY d) AS urls FROM (SELECT doc_id::VARCHAR AS d, sha256(array_to_string(w, ' ')) AS h FROM (SELECT doc_id, " + _TOKENS.format("text") + " AS w FROM documents) WHERE len(w) >= 40) GROUP BY h HAVING count(*) > 1)")
def exact_text_findings(spark, sf_dir):
    """Equal texts as findings."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit(200).alias("status"), F.lit(False).alias("noindex"), T.tokenize(F.col("text")).alias("tokens"))
    return similarity.exact_findings(rows).select(F.sha2(F.array_min("urls"), 256).alias("url"), F.array_join("urls", ",").alias("urls"))


@query(
    "SELECT type, count(*) AS n FROM (SELECT unnest(CASE event_id % 6 WHEN 0 THEN ['schema_parse_error'] WHEN 1 THEN ['schema_context_candidate', 'schema_relative_url_candidate'] WHEN 2 THEN ['schema_missing_type'] "
    "WHEN 3 THEN ['schema_visible_mismatch_candidate'] WHEN 4 THEN ['schema_parse_error'] ELSE [] END) AS type FROM events) GROUP BY 1"
)
def structured_data_findings(spark, sf_dir):
    """JSON-LD scripts with each of the faults, parsed from pages."""
    k = F.col("event_id")
    block = (
        F.when(k % 6 == 0, F.lit("{broken")).when(k % 6 == 1, F.lit('{"@type": ["Article"], "name": "quiet harbor lamps", "image": "/i.png"}')).when(k % 6 == 2, F.lit('{"@context": "x", "name": "quiet harbor lamps"}'))
        .when(k % 6 == 3, F.lit('{"@context": "x", "@type": "Thing", "headline": "something different"}')).when(k % 6 == 4, F.lit(" ")).otherwise(F.lit('{"@context": "x", "@type": "Thing", "url": "https://a.example/"}'))
    )
    html = F.concat(F.lit("<html><head><script type='application/ld+json'>"), block, F.lit("</script></head><body><h1>Quiet harbor lamps</h1></body></html>"))
    # Events are few bytes in few files, the pages made of them many: they are dealt before they are parsed.
    events = table(spark, sf_dir, "events").select("event_id")
    events = events.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "event_id")
    rows = events.select(F.concat(F.lit("https://shop.example/"), k).alias("url"), html.alias("html")).withColumn("p", parse_page("html", "url"))
    analyses = rows.select("url", F.col("p.title").alias("title"), F.col("p.h1").alias("h1"), F.lit(True).alias("html_available"), F.col("p.blocks").alias("blocks"), F.col("p.warning").alias("warning"))
    return sinks.finding_counts(pages.parse_findings(analyses, SiteConfig(SITE)))


# -- gates ------------------------------------------------------------------


@query(
    f"WITH h AS (SELECT min({_BARE}) AS host FROM pages), p AS (SELECT page_id, {_NORM} AS url FROM pages, h WHERE {_BARE} = host) "
    "SELECT count(*) AS known_urls, count(*) FILTER (page_id % 2 = 0) AS sitemap_urls, count(*) FILTER (page_id % 5 = 0) AS resolved_non_graph_urls, count(*) FILTER (page_id % 5 <> 0 AND page_id % 7 <> 0) AS html_pages, "
    "count(*) FILTER (page_id % 5 <> 0) AS graph_eligible_urls, round(count(*) FILTER (page_id % 5 <> 0 AND page_id % 7 <> 0) / count(*) FILTER (page_id % 5 <> 0), 6)::DOUBLE AS html_coverage, "
    "count(*) FILTER (page_id % 5 <> 0 AND page_id % 7 = 0) AS excluded_html FROM p"
)
def coverage_gate(spark, sf_dir):
    """Counts of one site's evidence, through page analyses: a fifth of its pages gone, a seventh not attested."""
    rows = _site_pages(spark, sf_dir)
    host = rows.agg(F.min("host")).first()[0]
    own = rows.where(F.col("host") == host).withColumn("url", F.regexp_replace("id", "^http://", "https://"))
    gone, whole = F.col("page_id") % 5 == 0, F.col("page_id") % 7 != 0
    no = F.lit(False)
    cache = own.select("url", F.when(gone, 404).otherwise(200).alias("status"), F.col("url").alias("final_url"), F.when(~gone, F.col("html")).alias("html"), whole.alias("html_complete"), no.alias("truncated"), no.alias("conflicting_snapshots"))
    known = own.select("url", *[F.lit("").alias(c) for c in ("title", "h1", "lane", "cluster", "post_type")], F.lit(0.0).alias("inventory_word_count"), (F.col("page_id") % 2 == 0).alias("in_sitemap"))
    site = f"https://{host}/"
    analyses = pages.analyse(cache, known, SiteConfig(site))
    done = gates.coverage(known, analyses, site, 0)
    return done.select("known_urls", "sitemap_urls", "resolved_non_graph_urls", "html_pages", "graph_eligible_urls", F.round("html_coverage", 6).alias("html_coverage"), "excluded_html")


@query("SELECT count(*) AS n FROM (SELECT 'https://shop.example/' || l_partkey AS url FROM lineitem WHERE l_partkey % 3 <> 0 UNION SELECT 'https://shop.example/' || l_suppkey FROM lineitem)")
def observed_identities(spark, sf_dir):
    """Distinct page-like addresses of two sources."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    place = lambda c, end: F.concat(F.lit("https://shop.example/"), c, end)
    a = l.select(place(F.col("l_partkey"), F.when(F.col("l_partkey") % 3 == 0, ".css").otherwise("")).alias("url"))
    return _rows(spark, [(gates.observed_identities(a, l.select(place(F.col("l_suppkey"), F.lit("")).alias("url"))),)], "n long")


@query("SELECT r_regionkey, r_regionkey = 1 AS same, r_regionkey = 1 AS bound FROM region")
def source_binding(spark, sf_dir):
    """Bags of digests, declared and given, of each region's nations against one region's in another order."""
    bags = {r.n_regionkey: r.h for r in table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.sha2("n_name", 256)).alias("h")).collect()}  # five rows
    rows = []
    for k, given in sorted(bags.items()):
        body = {"site": SITE, "universe_complete": True, "sources": [{"id": "a", "required": True, "status": "collected"}], "outputs": {"inventories": [{"sha256": h.upper()} for h in reversed(given)]}}
        u = manifest.bind(json.dumps(body).encode(), SITE, sorted(bags[1]), [], [], 0)
        rows.append((k, u.inventory_bound, u.complete))
    return _rows(spark, rows, "r_regionkey int, same boolean, bound boolean")


@query(
    "SELECT * FROM (VALUES ('bound', 'DECLARED_SCOPE_BOUND', 0::BIGINT, 'MANIFEST_DECLARED'), ('late', 'DECLARED_SCOPE_INCOMPLETE', 1, 'MANIFEST_DECLARED'), ('other site', 'DECLARED_SCOPE_INCOMPLETE', 1, 'MANIFEST_DECLARED'), "
    "('count', 'DECLARED_SCOPE_INCOMPLETE', 1, 'MANIFEST_DECLARED'), ('empty', 'DECLARED_SCOPE_INCOMPLETE', 3, 'NOT_PROVIDED'), ('none', 'NOT_DECLARED', 1, 'NOT_PROVIDED')) t(manifest, assurance, n_reasons, origin)"
)
def scope_gate(spark, sf_dir):
    """Manifests whose scope holds, and that fail it for one reason each."""
    full = {"site": "https://shop.example:443", "universe_complete": "yes", "expected_normalized_identities": 3, "expected_count_origin": "by hand", "sources": [{"id": "a", "required": 1, "status": "Collected"}], "outputs": {"inventory": {"sha256": "a" * 64}}}
    cases = {
        "bound": full, "late": full | {"sources": [{"id": "a", "required": "true", "status": "not_attempted"}]}, "other site": full | {"site": "https://www.shop.example"},
        "count": full | {"expected_normalized_identities": 4}, "empty": {k: v for k, v in full.items() if k in ("site", "outputs")},
    }
    bound = {name: manifest.bind(json.dumps(body).encode(), SITE, ["a" * 64], [], [], 3) for name, body in cases.items()} | {"none": manifest.Universe()}
    return _rows(spark, [(name, u.assurance, len(u.reasons), u.origin) for name, u in bound.items()], "manifest string, assurance string, n_reasons long, origin string")


@query("SELECT 'content' AS lane, count(*) FILTER (p_size % 3 <> 0) AS n FROM part UNION ALL SELECT 'commerce', count(*) FILTER (p_size % 3 = 0) FROM part")
def lane_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lane = T.infer_lane(F.concat(F.lit("https://shop.example/p/"), "p_partkey", F.lit("/")), F.lit(""), F.when(F.col("p_size") % 3 == 0, "offer").otherwise("page"))
    return sinks.lane_counts(part.select(lane.alias("lane")))


@query("SELECT 'https://shop.example/n/' || n_nationkey AS url FROM nation ORDER BY n_nationkey <> 7, url LIMIT 10")
def crawl_seeds(spark, sf_dir):
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("https://shop.example/n/"), "n_nationkey").alias("url"))
    return graph.crawl_seeds(known, "https://shop.example/n/7", 10)


@query(
    f"WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"/[^\"]*\">([^<]*)</a>', 1)) AS anchor FROM pages) SELECT count(*) AS n FROM a WHERE trim(lower(anchor)) IN {_GENERIC}"
)
def generic_anchor_findings(spark, sf_dir):
    """Generic anchors as findings, links without any known target."""
    links = _site_links(spark, sf_dir).select("source", "target", "anchor")
    known = links.limit(0).select(F.col("target").alias("url"), F.lit(200).alias("status"), F.lit(False).alias("identity_redirect"), F.lit("").alias("final_url"), F.lit(False).alias("noindex"), F.lit("").alias("canonical"))
    return graph.link_findings(links, known).where("type = 'generic_anchor'").agg(F.count(F.lit(1)).alias("n"))
