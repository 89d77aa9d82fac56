"""Queries on rows that the smallest tables lack, and what must not grow with the tables."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sightline.config import SiteConfig
from sightline.functions.html import parse_page
from sightline.operators import graph
from sightline.operators.lineage import BATCH_BYTES
from sightline.plans import queries as site

PAGES = [
    (k, f"https://h.example/p{k}", f"<html lang=\"en\"><head><title>{title}</title></head><body><h1>{title}</h1></body></html>")
    for k, title in enumerate(["Ropes &amp; &quot;knots&quot;", "Ropes knots &amp", "Ropes &amp;lt; &lt;knots&gt; &#39;a", "Ropes && knots&amp;&amp"])
]

BOUNDED = ["inbound_outbound", "exact_text_findings", "exact_duplicates", "anchor_generic", "signal_tokens", "discovered_pages", "near_duplicates_lsh"]


@pytest.fixture()
def pages(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["page_title_h1", "token_df_pruned", "topic_overlap_pairs"])
def test_references_as_in_sql(spark, pages, name):
    import duckdb

    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{pages}/pages.parquet/*.parquet'")
    found = entry.queries()[name](spark, pages)
    want = duck.execute(site.ORACLE[name]).fetchdf()[found.columns]
    assert len(want) and sorted(map(tuple, found.collect())) == sorted(want.itertuples(index=False, name=None))


def test_facts_told_in_pieces():
    """Facts of a batch are never all Python objects at once."""
    html = pd.Series(["<p>" + "x" * 100_000] * 50 + [None, ""])
    told = [len(x) for x in parse_page.func(iter([(html, html)]))]
    assert sum(told) == len(html) and max(told) <= 4


@pytest.mark.parametrize("name", BOUNDED)
def test_bytes_of_a_batch(spark, name):
    """Python gets a batch of bounded bytes, whatever number of rows the tables have."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    size = F.pandas_udf(lambda text: pd.Series([int(text.str.len().sum())] * len(text)), "long")
    seen = spark.range(0, 400, 1, 1).select(size(F.repeat(F.lit("x"), 100_000)).alias("n")).agg(F.max("n")).first()[0]
    assert 0 < seen <= BATCH_BYTES + 100_000


def test_findings_parse_pages_once(spark):
    """However many kinds of findings there are, a page is parsed once, and many tasks parse."""
    plan = entry.queries()["structured_data_findings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parse_page(") == 1 and "REPARTITION_BY_NUM" in plan


def test_opportunities_meet_classes(spark, monkeypatch):
    """Sources as by trying all pairs, while few rows of each class of equal pages are ranked."""
    n, site_url = 150, "https://h.example/"
    url = lambda k: f"{site_url}{k}/"
    titles = {k: f"lantern{k % 3} harbor{k % 2}" for k in range(n)}
    cluster = {k: ["", "a", "b"][k % 5 % 3] for k in range(n)}
    links = [(s, t) for t in range(3, n, 7) for s in range(t % 5, n, 40)] + [(s, 2) for s in range(0, n, 2)]
    analyses = spark.createDataFrame([(url(k), 200, False, True, titles[k], "", "content", "en") for k in range(n)], "url string, status int, noindex boolean, html_available boolean, title string, h1 string, lane string, lang string")
    known = spark.createDataFrame([(url(k), "", float(k % 11), cluster[k]) for k in range(n)], "url string, top_queries string, latest_impressions double, cluster string")
    edges = spark.createDataFrame([(url(s), url(t), "nav") for s, t in links], "source string, target string, location string")
    ranked, best = [], graph.best_sources
    monkeypatch.setattr(graph, "best_sources", lambda rows, *order: ranked.append(rows.count()) or best(rows, *order))
    found = graph.opportunities(known, analyses, graph.counters(edges), edges, SiteConfig(site_url)).collect()
    want, words = [], {k: set(titles[k].split()) for k in range(n)}
    for t in sorted((k for k in range(n) if k % 11), key=lambda k: (-(k % 11), url(k))):
        fit = [s for s in range(n) if s != t and (s, t) not in links and words[s] & words[t] and ("" in (cluster[s], cluster[t]) or cluster[s] == cluster[t])]
        fit.sort(key=lambda s: (len(words[s] & words[t]) / len(words[s] | words[t]), s % 11, url(s)), reverse=True)
        if fit:
            want.append((url(t), [url(s) for s in fit[:3]], f"latest impressions={t % 11}; contextual inbound=0; topical source candidates={len(fit)}"))
    assert [(r["target"], r["sources"], r["evidence"]) for r in found] == want[:50]
    # Three of each of 18 classes for each of 136 targets, and those barred; all pairs would be some 12,000.
    assert max(ranked) <= 136 * 18 * 3 + len(links) + n


def test_depths_shuffle_edges_once(spark, monkeypatch):
    """Edges, repeated or not, are shuffled once; without nodes, every target is one."""
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("x", "y")], "source string, target string")
    found = graph.depths(edges, None, spark.createDataFrame([("a",)], "url string"))
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 1), ("c", 1)]
    assert plans[0].count("Exchange") == 1 and "HashAggregate" not in plans[0]
