"""Coverage, the two gates, and the decision. A decision never allows a live change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline import config as C
from sightline.functions import text as T


def coverage(known: DataFrame, analyses: DataFrame, home: str, unresolved: int) -> DataFrame:
    """One row of counts and the content gate. Counting is one pass over either table."""
    k = known.agg(F.count(F.lit(1)).alias("known_urls"), F.count_if("in_sitemap").alias("sitemap_urls"))
    gone = F.col("same_origin_identity_redirect") | F.col("status").isin(404, 410)
    a = analyses.agg(
        F.count(F.lit(1)).alias("page_records"), F.count_if("html_available").alias("html_pages"), F.count_if(gone).alias("resolved_non_graph_urls"),
        F.coalesce(F.bool_or((F.col("url") == home) & F.col("html_available")), F.lit(False)).alias("homepage_parsed"),
        F.count_if("conflicting_snapshots").alias("conflicting"),
        F.count_if(F.col("html_present") & ~F.col("html_available") & ((F.col("status") == 0) | F.col("status").between(200, 299))).alias("excluded_html"),
    )
    both = k.withColumn("_one", F.lit(1)).join(a.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return gate_columns(both.withColumn("unresolved_sitemaps", F.lit(unresolved).cast("long")))


def gate_columns(counts: DataFrame) -> DataFrame:
    """graph_eligible_urls, html_coverage and content_graph_complete of rows of counts."""
    eligible = F.greatest(F.lit(0), F.col("known_urls") - F.col("resolved_non_graph_urls"))
    share = F.when(F.col("graph_eligible_urls") > 0, F.col("html_pages") / F.col("graph_eligible_urls")).otherwise(0.0)
    passes = (F.col("graph_eligible_urls") > 0) & (F.col("html_pages") == F.col("graph_eligible_urls")) & F.col("homepage_parsed") & (F.col("unresolved_sitemaps") == 0)
    return counts.withColumn("graph_eligible_urls", eligible).withColumn("html_coverage", share).withColumn("content_graph_complete", passes)


def blockers() -> Column:
    """Blocker codes in order, from the columns of a coverage row joined with a source universe row."""
    declared = F.col("declared")
    rules = (
        ("SOURCE_MANIFEST_MISSING", ~declared),
        ("SOURCE_ROWS_MISSING", declared & (F.col("source_rows") == 0)),
        ("SOURCE_UNIVERSE_NOT_DECLARED_COMPLETE", declared & ~F.col("declared_complete")),
        ("REQUIRED_SOURCES_MISSING", declared & (F.col("required") == 0)),
        ("REQUIRED_SOURCES_INCOMPLETE", declared & (F.col("required") > 0) & ~F.col("required_complete")),
        ("SOURCE_SITE_MISMATCH", declared & ~F.col("site_matches")),
        ("INVENTORY_HASH_MISMATCH", declared & ~F.col("inventory_bound")),
        ("PAGE_CACHE_HASH_MISMATCH", declared & ~F.col("page_cache_bound")),
        ("SITEMAP_HASH_MISMATCH", declared & ~F.col("sitemap_bound")),
        ("SOURCE_IDENTITY_COUNT_MISMATCH", declared & F.coalesce(F.col("expected") != F.col("observed"), F.lit(False))),
        ("SOURCE_UNIVERSE_CONTRADICTED", declared & (F.col("discovered") > 0)),
        ("NO_ACTIVE_IDENTITIES", F.col("graph_eligible_urls") == 0),
        ("ACTIVE_HTML_INCOMPLETE", F.col("html_pages") != F.col("graph_eligible_urls")),
        ("HOMEPAGE_HTML_MISSING", ~F.col("homepage_parsed")),
        ("UNRESOLVED_SITEMAPS", F.col("unresolved_sitemaps") > 0),
    )
    return F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds in rules]))


def decide(row: DataFrame) -> DataFrame:
    """decision, release_gate_passed, unclassified_count and blocker_codes of coverage rows with a universe."""
    passed = F.col("content_graph_complete") & F.col("source_universe_complete")
    target = F.greatest(F.col("known_urls"), F.coalesce(F.col("expected"), F.col("observed")))
    left = F.greatest(F.lit(0), target - F.col("html_pages") - F.col("resolved_non_graph_urls"))
    return row.select(
        "*", blockers().alias("blocker_codes"), passed.alias("release_gate_passed"), F.lit(False).alias("live_change_authorized"),
        F.when(passed, F.lit("READY_FOR_HUMAN_REVIEW")).otherwise(F.lit("WITHHOLD")).alias("decision"), left.alias("unclassified_count"),
        F.lit(C.SCOPE_WARNING).alias("scope_warning"),
    )


BOUNDARY = "A reading of saved evidence. READY_FOR_HUMAN_REVIEW lets nobody change a live site; a person decides."


def contract(row: dict, hashes: dict) -> dict:
    """The decision as a document: both gates as stages, blockers, and what evidence it rests on."""
    expected, observed = row["expected"], row["observed"]
    return {
        "schema_version": "1.0", "decision": row["decision"], "release_gate_passed": row["release_gate_passed"], "live_change_authorized": False,
        "scope_assurance": row["scope_assurance"], "scope_warning": row["scope_warning"],
        "stages": {
            "source_universe": {
                "passed": row["source_universe_complete"], "observed_normalized_identities": observed, "expected_normalized_identities": expected,
                "expected_count_origin": row["expected_count_origin"], "identity_count_matches": None if expected is None else expected == observed,
            },
            "active_html": {
                "passed": row["content_graph_complete"], "eligible_identities": row["graph_eligible_urls"], "full_html_identities": row["html_pages"],
                "confirmed_terminal_identities": row["resolved_non_graph_urls"], "coverage": row["html_coverage"], "required_coverage": 1.0,
                "homepage_parsed": row["homepage_parsed"], "unresolved_sitemaps": row["unresolved_sitemaps"],
            },
            "final": {"passed": row["release_gate_passed"]},
        },
        "unclassified_count": row["unclassified_count"], "blocker_codes": list(row["blocker_codes"]), "evidence_hashes": {"algorithm": "sha256"} | hashes,
        "decision_boundary": f"{row['scope_warning']} {BOUNDARY}",
    }


def observed_identities(inventory: DataFrame, sitemap: DataFrame) -> int:
    """Distinct page-like URLs of inventories and sitemaps."""
    return inventory.select("url").union(sitemap.select("url")).where(T.is_page_like(F.col("url"))).distinct().count()
