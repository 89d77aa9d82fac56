"""Commands: ``prepare`` merges saved exports, ``audit`` checks a site. Exit code 2: a gate withheld and was asked for."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sightline.config import SiteConfig
from sightline.plans import audit as auditing
from sightline.plans import prepare as preparing


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sightline")
    commands = p.add_subparsers(dest="command", required=True)
    a = commands.add_parser("prepare", help="saved exports to an inventory, a page cache and a manifest")
    a.add_argument("--source", action="append", default=[], metavar="KIND=PATH")
    a.add_argument("--unavailable", action="append", default=[], metavar="KIND=REASON")
    a.add_argument("--not-attempted", action="append", default=[], metavar="KIND=REASON")
    a.add_argument("--required", action="append", default=[], metavar="KIND")
    a.add_argument("--declare-complete", action="store_true")
    a.add_argument("--cache-form", choices=("json", "parquet"), default="json")
    b = commands.add_parser("audit", help="inventories, sitemaps and saved pages to findings and a decision")
    b.add_argument("--inventory", action="append", default=[])
    b.add_argument("--sitemap", action="append", default=[])
    b.add_argument("--page-cache")
    b.add_argument("--manifest")
    b.add_argument("--brand-term", action="append", default=[])
    b.add_argument("--gate-exit-code", action="store_true")
    for c in (a, b):
        c.add_argument("--site", required=True)
        c.add_argument("--output", required=True)
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("sightline").getOrCreate()
    if given.command == "prepare":
        pairs = lambda values: tuple(preparing.assignment(v) for v in values)
        sources = pairs(given.source)
        done = preparing.prepare(spark, given.site, list(sources), tuple(given.required), pairs(given.unavailable), pairs(given.not_attempted), given.declare_complete)
        collected = {s.get("path") for s in done.sources if s["kind"] == "sitemap" and s["status"] == "collected"}
        preparing.write_prepared(spark, done, given.site, given.output, given.cache_form, tuple(p for _, p in sources if p in collected))
        return 0
    done = auditing.audit(spark, SiteConfig(given.site, tuple(given.brand_term)), given.inventory, given.sitemap, given.page_cache, given.manifest)
    auditing.write_audit(spark, done, given.output)
    return 2 if given.gate_exit_code and not done.decision["release_gate_passed"] else 0


if __name__ == "__main__":
    sys.exit(main())
