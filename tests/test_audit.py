"""Whole audits over an invented site, complete and with sources left out."""

import hashlib
import json
from pathlib import Path

import pytest

from sightline.config import SiteConfig
from sightline.plans.audit import audit
from sightline.plans.prepare import prepare
from sightline.sources import manifest, sinks

SITE = "https://quay.example/"
LONG = " ".join(f"mooring{k} channel{k} lantern{k}" for k in range(20))


def page(title, body, links="", head=""):
    return f"<html lang='en'><head><title>{title}</title>{head}</head><body><nav>{links}</nav><h1>{title}</h1><p>{body}</p></body></html>"


def a(*targets):
    return "".join(f"<a href='{t}'>{t.strip('/') or 'start'}</a>" for t in targets)


HTML = {
    "/": page("Quay", "Welcome aboard", a("/ropes/", "/sails/", "/gone/")),
    "/ropes/": page("Choosing ropes", "Short words on ropes", a("/knots/") + "<a href='/sails/'>read more</a>"),
    "/knots/": page("Knots", "Knots again", a("/splices/")),
    "/splices/": page("Splices", "Splices", a("/deep/")),
    "/deep/": page("Deep water", "Deep", ""),
    "/sails/": page("Sails guide", "Sails", head="<link rel=canonical href='/sails-new/'>"),
    "/sails-new/": page("Sails guide", "New sails", head="<meta name=robots content=noindex>"),
    "/lonely/": page("Same words", LONG),
    "/twin/": page("Twin", "Twin", head="<script type='application/ld+json'>{bad</script>"),
    "/twin-a/": page("Same words", LONG),
}
ROWS = [(p, 200) for p in HTML] + [("/gone/", 404)]


def fixture(folder: Path, paths=None, expected=11, sources=None, cut_cache=None):
    """inventory.csv, page_cache.json, sitemap.xml and a manifest bound to them."""
    folder.mkdir(exist_ok=True)
    paths = [p for p, _ in ROWS] if paths is None else paths
    lines = ["url,title,latestImpressions,topQueries"] + [f"{SITE[:-1]}{p},,{10 * (k + 1)},rope knots sail" for k, p in enumerate(paths)]
    (folder / "inventory.csv").write_text("\n".join(lines) + "\n")
    cache = {SITE[:-1] + p: {"status": s, "final_url": SITE[:-1] + p, "html": HTML.get(p, "")} for p, s in ROWS if p in paths}
    (folder / "page_cache.json").write_text(json.dumps({"html_complete": True, "pages": cache | (cut_cache or {})}))
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    (folder / "sitemap.xml").write_text(f"<urlset xmlns='{ns}'>" + "".join(f"<url><loc>{SITE[:-1]}{p}</loc></url>" for p in paths) + "</urlset>")
    sha = lambda n: hashlib.sha256((folder / n).read_bytes()).hexdigest()
    body = {
        "version": 1, "site": SITE, "universe_complete": True, "expected_normalized_identities": expected,
        "sources": sources or [{"id": "inventory-1", "kind": "inventory", "required": True, "status": "collected"}],
        "outputs": {"inventory": {"sha256": sha("inventory.csv")}, "page_cache": {"sha256": sha("page_cache.json")}, "sitemaps": [{"sha256": sha("sitemap.xml")}]},
    }
    (folder / "manifest.json").write_text(json.dumps(body))
    return [str(folder / n) for n in ("inventory.csv", "sitemap.xml", "page_cache.json", "manifest.json")]


def run(spark, files):
    inventory, sitemap, cache, declared = files
    return audit(spark, SiteConfig(SITE, brand_terms=("quay",)), [inventory], [sitemap], cache, declared)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    done = run(spark, fixture(tmp_path_factory.mktemp("whole")))
    return done, done.findings.toPandas(), done.pages.toPandas().set_index("url")


def test_complete_site_is_ready(whole):
    d = whole[0].decision
    assert (d["known_urls"], d["resolved_non_graph_urls"], d["graph_eligible_urls"], d["html_pages"]) == (11, 1, 10, 10)
    assert d["decision"] == "READY_FOR_HUMAN_REVIEW" and d["blocker_codes"] == [] and not d["live_change_authorized"]
    assert d["unclassified_count"] == 0 and d["scope_assurance"] == "DECLARED_SCOPE_BOUND"


def test_findings_of_complete_site(whole):
    counts = whole[1].groupby("type").size().to_dict()
    assert counts["broken_internal_link"] == 1 and counts["link_to_noncanonical"] == 2 and counts["generic_anchor"] == 1
    assert counts["schema_parse_error"] == 1 and counts["exact_duplicate_candidate"] == 1
    orphans = set(whole[1][whole[1].type == "orphan_candidate"].url)
    assert orphans == {SITE + p for p in ("lonely/", "twin/", "twin-a/")}
    assert set(whole[1][whole[1].type == "unreachable_from_home_candidate"].url) == orphans
    assert list(whole[1][whole[1].type == "deep_page_candidate"].url) == [SITE + "deep/"]
    assert counts["internal_link_opportunity"] > 0 and "graph_claims_withheld" not in counts


def test_page_rows(whole):
    rows = whole[2]
    assert rows.loc[SITE + "knots/", "depth"] == 2 and rows.loc[SITE + "sails/", "inbound_total"] == 2
    assert rows.loc[SITE + "gone/", "status"] == 404 and rows.in_sitemap.all()
    assert rows.loc[SITE, "outbound_total"] == 3


def test_missing_identities_withhold(spark, tmp_path):
    kept = [p for p, _ in ROWS if p not in ("/deep/", "/splices/", "/twin/", "/gone/")]
    files = fixture(tmp_path / "part", paths=kept)
    done = run(spark, files)
    d = done.decision
    assert d["decision"] == "WITHHOLD" and "SOURCE_IDENTITY_COUNT_MISMATCH" in d["blocker_codes"] and "SOURCE_UNIVERSE_CONTRADICTED" in d["blocker_codes"]
    kinds = set(done.findings.select("type").distinct().toPandas()["type"])
    assert {"graph_claims_withheld", "source_universe_incomplete", "zero_inbound_partial", "source_universe_contradicted"} <= kinds
    assert not kinds & {"orphan_candidate", "deep_page_candidate", "unreachable_from_home_candidate", "internal_link_opportunity"}


def test_unusable_pages(spark, tmp_path):
    bad = {
        SITE + "knots/": {"status": 500, "html": HTML["/knots/"]},
        SITE + "deep/": {"status": 200, "html": HTML["/deep/"], "truncated": True},
        SITE + "sails/": {"status": 200, "html": HTML["/sails/"], "final_url": "https://elsewhere.example/"},
        SITE + "twin/": {"status": 200, "html": HTML["/twin/"], "html_complete": "false"},
    }
    done = run(spark, fixture(tmp_path / "bad", cut_cache=bad))
    assert done.decision["html_pages"] == 6 and done.decision["decision"] == "WITHHOLD"
    assert done.decision["excluded_html"] == 3


def test_changed_file_breaks_binding(spark, tmp_path):
    files = fixture(tmp_path / "x")
    Path(files[0]).write_text(Path(files[0]).read_text() + "\n")
    assert "INVENTORY_HASH_MISMATCH" in run(spark, files).decision["blocker_codes"]


def test_manifest_rules():
    base = {"site": SITE, "universe_complete": "yes", "sources": {"a": {"required": 1, "status": "Not_Attempted"}}}
    u = manifest.bind(json.dumps(base).encode(), SITE, [], [], [], 3)
    assert u.sources[0]["status"] == "not-attempted" and not u.required_complete and not u.inventory_bound
    assert u.page_cache_bound and u.count_matches is None and u.origin == "NOT_PROVIDED"
    for wrong in (True, -1, "03", 1.5):
        with pytest.raises(ValueError):
            manifest.bind(json.dumps(base | {"expected_normalized_identities": wrong}).encode(), SITE, [], [], [], 3)
    with pytest.raises(ValueError):
        manifest.bind(json.dumps(base | {"sources": [{"id": "a"}, {"id": "a"}]}).encode(), SITE, [], [], [], 3)
    with pytest.raises(ValueError):
        SiteConfig(SITE, complete_threshold=0.99)


def write(path, header, *rows):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


def test_prepare(spark, tmp_path):
    search = write(tmp_path / "s.csv", "Page,Query,Clicks,Impressions,CTR,Position", f"{SITE}guide,one,2,20,10%,6", f"{SITE}guide,two,3,30,10%,9", f"{SITE}guide,two,3,30,10%,9")
    posts = tmp_path / "p.json"
    posts.write_text(json.dumps([{"live_url": SITE + "guide/", "post_type": "post", "post_status": "publish", "post_title": {"rendered": "Guide"}}, {"live_url": SITE + "draft/", "post_type": "post", "post_status": "draft"}]))
    crawl = write(tmp_path / "c.csv", "Address,Status Code,Final URL,Content Type,Rendered HTML,html_complete", f"{SITE}guide,200,{SITE}guide/,text/html,<p>x</p>,true", f"{SITE}a.pdf,200,,,,", f"{SITE}out,200,https://other.example/,text/html,<p>y</p>,true")
    visits = write(tmp_path / "v.csv", "hostname,landingPagePlusQueryString,sessions,engagedSessions,views", "quay.example,//guide/?a=1,2,1,3", "quay.example,/guide/,4,3,5")
    done = prepare(spark, SITE, [("auto", search), ("auto", str(posts)), ("auto", crawl), ("auto", visits)], required=("gsc", "sitemap"), declare_complete=True)
    rows = done.records.toPandas().set_index("url")
    guide = rows.loc[SITE + "guide/"]
    assert (guide.latestClicks, guide.latestImpressions, guide.gscCtr, round(guide.gscPosition, 3)) == (5, 50, 0.1, 7.8)
    assert list(guide["queries"]) == ["one", "two"] and list(guide["types"]) == ["crawler", "ga4", "gsc", "wordpress"] and guide.title == "Guide"
    assert (guide.ga4Sessions, guide.ga4EngagedSessions, guide.ga4Views) == (6, 4, 8)
    assert set(rows.index) == {SITE + "guide/", SITE + "out/"}
    cache = done.page_cache.toPandas().set_index("url")
    assert cache.loc[SITE + "guide/", "html"] == "<p>x</p>" and cache.loc[SITE + "out/", "html"] is None
    by = {s["id"]: s for s in done.sources}
    assert by["gsc-1"]["records"] == 3 and by["gsc-1"]["accepted"] == 2 and by["gsc-1"]["rejected"] == 1
    assert by["sitemap-1"]["status"] == "not-attempted" and not done.universe_complete
    sinks.write_csv(sinks.inventory(done.records), str(tmp_path / "inv"))
    assert "one | two" in next((tmp_path / "inv").glob("*.csv")).read_text()


@pytest.mark.parametrize("form", ["json", "parquet"])
def test_prepare_to_audit(spark, tmp_path, form):
    """Exports through both commands: the manifest binds what was written, the cache reads back, the gate passes, and a change breaks it."""
    from sightline.__main__ import main

    quoted = lambda t: '"' + t.replace('"', '""') + '"'
    crawl = write(tmp_path / "c.csv", "Address,Status Code,Content Type,Rendered HTML,html_complete", *[f"{SITE[:-1]}{p},{s},text/html,{quoted(HTML.get(p, ''))},{'true' if p in HTML else ''}" for p, s in ROWS])
    ns = "http://www.sitemaps.org/schemas/sitemap/0.9"
    sitemap = tmp_path / "sitemap.xml"
    sitemap.write_text(f"<urlset xmlns='{ns}'>" + "".join(f"<url><loc>{SITE[:-1]}{p}</loc></url>" for p, _ in ROWS) + "</urlset>")
    out, told = str(tmp_path / "out"), str(tmp_path / "told")
    common = ["--site", SITE, "--output"]
    assert main(["prepare", *common, out, "--source", f"crawler={crawl}", "--source", f"sitemap={sitemap}", "--required", "crawler", "--required", "sitemap", "--declare-complete", "--cache-form", form], spark) == 0
    assert next(Path(out, "inventory.csv").glob("part-*.csv")).read_bytes().startswith(b"\xef\xbb\xbfurl,")
    cache = f"{out}/page_cache.{'parquet' if form == 'parquet' else 'jsonl'}"
    check = ["audit", *common, told, "--inventory", f"{out}/inventory.csv", "--sitemap", str(sitemap), "--page-cache", cache, "--manifest", f"{out}/source_manifest.json", "--gate-exit-code"]
    assert main(check, spark) == 0
    audit_file, decision = (json.loads(Path(told, n).read_text()) for n in ("audit.json", "decision.json"))
    assert decision == audit_file["release_contract"] and decision["decision"] == "READY_FOR_HUMAN_REVIEW" and decision["stages"]["active_html"]["full_html_identities"] == 10
    assert decision["evidence_hashes"]["source_manifest"] and audit_file["inputs"]["inventories"] == [{"rows": 11, "accepted": 11}]
    assert sum(audit_file["lane_counts"].values()) == 11 and audit_file["finding_counts"]["orphan_candidate"] == 3
    listed = next(Path(told, "pages.csv").glob("part-*.csv")).read_text("utf-8-sig").splitlines()
    assert [row.split(",")[0] for row in listed[1:]] == sorted(SITE[:-1] + p for p, _ in ROWS)
    report = Path(told, "report.md").read_text()
    assert sum(f"| {name} |" in report for name, _ in sinks.COVERAGE) == 19 and "<select" in Path(told, "dashboard.html").read_text()
    sitemap.write_text(sitemap.read_text() + "\n")
    assert main(check, spark) == 2
    assert "SITEMAP_HASH_MISMATCH" in json.loads(Path(told, "decision.json").read_text())["blocker_codes"]


def test_completeness_states():
    full = {"declared": True, "source_universe_complete": True, "content_graph_complete": True, "release_gate_passed": True}
    label = lambda **change: sinks.completeness(full | change)["label"]
    assert [label(declared=False), label(source_universe_complete=False), label(source_universe_complete=False, discovered=2), label(content_graph_complete=False), label(), label(release_gate_passed=False)] == [
        "sources not declared", "declared sources incomplete", "declared sources contradicted", "page content incomplete", "complete within the declared scope", "whole-site claims withheld"
    ]


def test_crawl_seeds(spark):
    from sightline.operators.graph import crawl_seeds

    known = spark.createDataFrame([("https://h/b",), ("https://h/",), ("https://h/a",), ("https://h/a",)], "url string")
    assert [r.url for r in crawl_seeds(known, "https://h/b", 2).collect()] == ["https://h/b", "https://h/"]


def test_overlapping_search_files(spark, tmp_path):
    one = write(tmp_path / "1.csv", "Page,Query,Clicks,Impressions,Position", f"{SITE}g,a,9,50,2")
    two = write(tmp_path / "2.csv", "Page,Query,Clicks,Impressions,Position", f"{SITE}g,b,3,100,5")
    row = prepare(spark, SITE, [("gsc", one), ("gsc", two)]).records.first()
    assert (row.latestClicks, row.latestImpressions, row.gscCtr, row.gscPosition, row.gscMetricSource, row["queries"]) == (3, 100, 0.03, 5, "gsc-2", ["a", "b"])


@pytest.mark.parametrize("order", [0, 1])
def test_conflicting_snapshots(spark, tmp_path, order):
    head = "Address,Status Code,Content Type,Rendered HTML,html_complete"
    files = [write(tmp_path / "1.csv", head, f"{SITE}g,200,text/html,<p>x</p>,yes"), write(tmp_path / "2.csv", head, f"{SITE}g,404,text/html,,")]
    row = prepare(spark, SITE, [("crawler", f) for f in files[:: 1 - 2 * order]]).page_cache.first()
    assert (row.status, row.html, row.conflicting_snapshots, row.candidate_count) == (404, None, True, 2)


def test_wrong_shapes(spark, tmp_path):
    other = write(tmp_path / "o.csv", "Page,Clicks,Impressions", "https://other.example/,1,2")
    odd = write(tmp_path / "n.csv", "a,b", "1,2")
    done = prepare(spark, SITE, [("auto", other), ("gsc", odd)], unavailable=(("ga4", "no access"),))
    assert [s["status"] for s in done.sources] == ["empty", "invalid", "attempted-unavailable"]


def test_ten_thousand_rows(spark, tmp_path):
    path = write(tmp_path / "big.csv", "Address,Status Code", *[f"{SITE}p{k},200" for k in range(10_000)])
    assert prepare(spark, SITE, [("auto", path)]).records.count() == 10_000


def test_sinks(whole):
    done, findings, _ = whole
    text = sinks.report(done.decision, done.findings)
    assert "READY_FOR_HUMAN_REVIEW" in text and "| orphan_candidate | 3 |" in text
    shown = sinks.public_payload(done.decision, done.findings, done.pages)
    assert shown["summary"]["completeness"] == "complete within the declared scope" and len(shown["pages"]) == 11
    assert "sha256" not in json.dumps(shown["summary"]) and "<script>" in sinks.dashboard(shown)
