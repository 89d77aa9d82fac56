import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sightline.functions import html as H
from sightline.functions import text as T
from sightline.functions import urls as U
from sightline.sources.sitemaps import inspect_sitemap, sitemap_facts

SITE = "https://www.harbor.example/"


def values(spark, column, rows):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x string").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("http://harbor.example/Boats", "http://www.harbor.example/Boats/"),
        ("/a//b///c.html?x=1#y", "https://www.harbor.example/a/b/c.html"),
        ("https://HARBOR.example:443/", "https://www.harbor.example/"),
        ("https://harbor.example:8443/x/", "https://www.harbor.example:8443/x/"),
        ("/caf%C3%A9", "https://www.harbor.example/caf%c3%a9/"),
        ("/café/", "https://www.harbor.example/caf%c3%a9/"),
        ("/%FF/", "https://www.harbor.example/%25FF/"),
        ("/a%2Fb", "https://www.harbor.example/a/b/"),
        ("/why%3F", "https://www.harbor.example/why%3f/"),
        ("/a+b", "https://www.harbor.example/a+b/"),
        ("https://elsewhere.example/x", "https://elsewhere.example/x/"),
        ("", ""),
        (None, ""),
        ("https://harbor.example:bad/", None),
        ("https://[bad/", None),
    ],
)
def test_identity(raw, want):
    assert U.identity(raw, SITE) == want


@given(st.text(max_size=40))
def test_identity_is_total_and_stable(raw):
    once = U.identity(raw, SITE)
    assert once is None or isinstance(once, str)


@pytest.mark.parametrize(
    ("raw", "host", "want"),
    [
        ("//guide/?a=1", "harbor.example", "https://www.harbor.example/guide/"),
        ("(not set)", "", ""),
        ("<https://harbor.example/x>", "", "https://www.harbor.example/x/"),
        ("/x", "other.example", ""),
        ("mailto:a@b.c", "", ""),
        ("https://other.example/", "", ""),
    ],
)
def test_export_identity(raw, host, want):
    assert U.export_identity(raw, SITE, host) == want


def test_ascii_form_agrees(spark):
    rows = ["http://www.harbor.example/a//b?x=1", "https://harbor.example", "https://harbor.example/x.html#y"]
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    got = df.select(U.normalize_ascii(F.col("x"), F.lit("www.harbor.example")), U.normalize(F.col("x"), SITE)).collect()
    assert all(a == b for a, b in got)


def test_numbers(spark):
    rows = ["1,234", "1.234", "0.123", "1.234,56", "1,234.56", "10 %", "1 000", "x", None, "nan", "0,5", "-3"]
    assert values(spark, T.number, rows) == [1234, 1.234, 0.123, 1234.56, 1234.56, 10, 1000, 0, 0, 0, 0.5, -3]
    assert values(spark, T.numeric, ["5", " 2.5 ", "1,2", "nan", None]) == [5, 2.5, 0, 0, 0]


def test_flags(spark):
    assert values(spark, T.boolish, ["1", "TRUE", " yes ", "y", "on", "0", None]) == [True, True, True, True, False, False, False]
    assert values(spark, T.explicit_true, ["on", "full", "complete", "1.0", "0", None]) == [True, True, True, True, False, False]


def test_tokens(spark):
    rows = ["The boats' don't re-enter ﬁve А Это лодка 42 x", None]
    got = values(spark, T.tokenize, rows)
    assert got == [["boats", "don't", "re-enter", "five", "лодка", "42"], []]
    assert values(spark, lambda c: T.signal_set(T.tokenize(c), ("boats",)), rows)[0] == ["don't", "re-enter", "five", "лодка"]
    assert values(spark, T.clean_signal, ["/x", "http://a", "%20%20", "fine 5%", None]) == ["", "", "", "fine 5%", ""]


def test_lanes(spark):
    lane = lambda c: T.infer_lane(c, F.lit(""), F.lit("product"))
    s = "https://h.example"
    rows = [s + p for p in ("/amp/", "/es/tag/x/", "/product-category/x/", "/a/page/2/", "/a/", "/tags/x/")]
    assert values(spark, lane, rows) == ["legacy_amp", "taxonomy", "commerce_taxonomy", "pagination", "commerce", "taxonomy"]
    assert values(spark, lambda c: T.language_lane(c, F.lit("")), [s + "/es/x/", s + "/x/"]) == ["es", "und"]
    assert values(spark, lambda c: T.language_lane(F.lit(s), c), ["pt_BR", "EN-us"]) == ["pt", "en"]
    assert values(spark, T.is_page_like, [s + "/a.PDF", s + "/a.html", s + "/", s + "/x.js/"]) == [False, True, True, False]
    assert values(spark, T.is_content_lane, ["content", "Taxonomy ", "", None]) == [True, False, True, True]


def test_csv_safe(spark):
    assert values(spark, T.csv_safe, ["=1", "  +x", "-", "@a", "a=b", ""]) == ["'=1", "'  +x", "'-", "'@a", "a=b", ""]


def test_origin(spark):
    rows = [("https://h.example/a", "https://h.example:443/"), ("https://www.h.example/", "https://h.example/"), ("http://h.example/", "https://h.example/")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(T.same_origin(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(T.same_site(F.col("a"), F.col("b"))).collect()] == [True, True, True]


MARKUP = """<html lang="en"><head><title>Sail <b>well</b></title><link rel="Canonical" href="/sail"><meta name="ROBOTS" content="NoIndex">
<script type="application/ld+json">{"@type": ["Article", "Thing"], "name": "x", "image": "/i.png", "author": {"@type": "Person", "url": "https://a.example"}}</script>
<script type="application/ld+json"></script><script>var hidden;</script></head><body><nav><a href="/menu">Menu</a></nav>
<h1>First</h1><h1>Second</h1><p>Text <a href="/one" rel="nofollow">go <img alt="on"> now</a> <a href="mailto:x@y">no</a> <a href="#top">no</a></p>
<noscript><a href="/two">two</a></noscript><footer><nav><a href="/foot">Foot</a></nav></footer><a href="/open">never closed"""


def test_page():
    page = H.page_facts(MARKUP, "https://h.example/p/")
    assert (page["title"], page["h1"], page["lang"], page["robots"]) == ("Sail well", "First", "en", "NoIndex")
    assert page["canonical"] == "https://h.example/sail"
    assert [(x["target"], x["anchor"], x["location"], x["rel"]) for x in page["links"]] == [
        ("https://h.example/menu", "Menu", "nav", ""),
        ("https://h.example/one", "go on now", "content", "nofollow"),
        ("https://h.example/two", "two", "content", ""),
        ("https://h.example/foot", "Foot", "footer", ""),
    ]
    assert "hidden" not in page["visible_text"] and "Sail" not in page["visible_text"]
    first, second = page["blocks"]
    assert first["types"] == ["Article", "Thing", "Person"] and first["relative"] == ["image=/i.png"] and not first["has_context"]
    assert second["error"] == "JSON-LD block 1 is empty"


def test_sitemaps():
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1"'
    body = f"<urlset {ns}><url><loc> https://h.example/a </loc><image:image><image:loc>https://h.example/i.png</image:loc></image:image></url></urlset>".encode()
    assert sitemap_facts(body)["locs"] == ["https://h.example/a"]
    assert inspect_sitemap(body)["status"] == "collected"
    assert inspect_sitemap(b"<urlset><url><loc>https://h.example/a</loc></url></urlset>")["status"] == "invalid"
    assert inspect_sitemap(b"<urlset")["status"] == "invalid"
    assert sitemap_facts(b"<rss/>")["error"].startswith("Unsupported root element")
