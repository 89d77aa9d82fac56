"""Source preparation: saved exports to one record a URL, with what each source contributed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import urls as U
from sightline.operators import merge
from sightline.operators.adapt import adapt, distinct_rows
from sightline.operators.lineage import bounded, cut
from sightline.sources import exports, sinks
from sightline.sources.sitemaps import inspect_sitemap

KINDS = ("auto", "inventory", "gsc", "ga4", "wordpress", "crawler", "sitemap")  # fixed value


@dataclass
class Prepared:
    """records (one a URL), page_cache, sources (manifest rows), and whether the declared scope is complete."""

    records: DataFrame | None
    page_cache: DataFrame | None
    sources: list[dict] = field(default_factory=list)
    universe_complete: bool = False


def assignment(value: str) -> tuple[str, str]:
    """KIND=VALUE."""
    kind, sep, rest = value.partition("=")
    if not sep or not kind.strip() or not rest.strip():
        raise ValueError(f"expected KIND=VALUE: {value}")
    return kind.strip().lower(), rest.strip()


def prepare(
    spark: SparkSession,
    site: str,
    sources: list[tuple[str, str]],
    required: tuple[str, ...] = (),
    unavailable: tuple[tuple[str, str], ...] = (),
    not_attempted: tuple[tuple[str, str], ...] = (),
    declare_complete: bool = False,
) -> Prepared:
    """Read (kind, path) sources in order and merge them; files are inspected, rows stay distributed."""
    bounded(spark)
    site = U.export_identity(site, site) or ""
    if not site:
        raise ValueError("site must be an absolute HTTP(S) URL")
    if unknown := [k for k in (*required, *[k for k, _ in (*sources, *unavailable, *not_attempted)]) if k not in KINDS]:
        raise ValueError(f"unsupported source kinds: {sorted(set(unknown))}")
    numbers: dict[str, int] = {}
    needed = lambda kind: not required or kind in required

    def entry(kind: str, status: str, **more: object) -> dict:
        numbers[kind] = numbers.get(kind, 0) + 1
        return {"id": f"{kind}-{numbers[kind]}", "kind": kind, "required": needed(kind), "status": status, "records": 0, "accepted": 0, "rejected": 0, "unique_urls": 0, "unique_urls_added": 0} | more

    rows_out, raws, adapted = [], [], []
    for k, (kind, path) in enumerate(sources):
        if kind == "sitemap":
            body = spark.read.format("binaryFile").load(path).select("content").first()
            seen = inspect_sitemap(bytes(body["content"]))
            rows_out.append(entry(kind, seen["status"], records=seen["records"], accepted=seen["records"] if seen["status"] == "collected" else 0, path=path) | ({"reason": seen["reason"]} if seen["reason"] else {}))
            continue
        try:
            raw = exports.export_rows(spark, path)
            fields = exports.fields_of(raw)
        except Exception as e:  # noqa: BLE001  an unreadable file is a source of status invalid
            rows_out.append(entry("inventory" if kind == "auto" else kind, "invalid", path=path, reason=str(e).splitlines()[0][:300]))
            continue
        kind = exports.detect_kind(fields) if kind == "auto" else kind
        fault = exports.shape_fault(kind, fields)
        row = entry(kind, "invalid" if fault else "collected", path=path, _ord=k) | ({"reason": fault} if fault else {})
        rows_out.append(row)
        raw = raw.withColumn("src_ord", F.lit(k))
        raws.append(raw.select("src_ord", "row_ord"))
        if not fault:
            named = [F.lit(kind).alias("kind"), F.lit(row["id"]).alias("source_id")]
            adapted.append(adapt(distinct_rows(raw), kind, site).select("*", *named))
    records = cache = None
    if adapted:
        accepted = cut(reduce(DataFrame.unionByName, adapted))  # three reads below
        kinds = {r["kind"] for r in rows_out if "_ord" in r}
        parts = reduce(
            DataFrame.unionByName,
            [merge.within_file(accepted.where(F.col("kind") == kind), kind).withColumn("kind", F.lit(kind)) for kind in sorted(kinds)],
        )
        ids = F.create_map(*[F.lit(x) for r in rows_out if "_ord" in r for x in (r["_ord"], r["id"])])
        parts = parts.withColumn("source_id", ids[F.col("src_ord")])
        records = merge.across_files(parts)
        cache = merge.conservative_snapshot(accepted.where("snapshot is not null").select("url", "src_ord", "row_ord", "source_id", "snapshot"))
        # A row for each source.
        counted = {r["src_ord"]: r.asDict() for r in merge.source_statistics(reduce(DataFrame.unionByName, raws), accepted, parts).collect()}
        for row in rows_out:
            row |= {k: v for k, v in counted.get(row.get("_ord"), {}).items() if k != "src_ord"}
            if row["status"] == "collected" and row["kind"] != "sitemap" and not row["accepted"]:
                row |= {"status": "empty", "reason": "no same-site public page rows were accepted"}
    rows_out += [entry(k, "attempted-unavailable", reason=r) for k, r in unavailable] + [entry(k, "not-attempted", reason=r) for k, r in not_attempted]
    missing = sorted(set(required) - {r["kind"] for r in rows_out})
    rows_out += [entry(k, "not-attempted", reason="required source kind was declared but no file or status was supplied") for k in missing]
    needed_rows = [r for r in rows_out if r["required"]]
    for row in rows_out:
        row.pop("_ord", None)
    whole = bool(declare_complete and needed_rows and all(r["status"] == "collected" for r in needed_rows))
    return Prepared(records, cache, rows_out, whole)


def write_prepared(spark: SparkSession, done: Prepared, site: str, folder: str, cache_form: str = "json", sitemaps: tuple[str, ...] = ()) -> dict:
    """The inventory, the page cache, and the manifest that binds them by digest, as an audit reads them; the manifest is returned."""
    paths = {"inventory": f"{folder}/inventory.csv", "page_cache": f"{folder}/page_cache.{'parquet' if cache_form == 'parquet' else 'jsonl'}"}
    outputs: dict[str, object] = {}
    records = 0
    if done.records is not None:
        sinks.write_csv(sinks.inventory(done.records), paths["inventory"])
        records = done.records.count()
        outputs["inventories"] = [{"path": "inventory.csv", "sha256": h, "records": records} for h in sinks.file_hashes(spark, paths["inventory"])]
    if done.page_cache is not None:
        sinks.write_page_cache(done.page_cache, paths["page_cache"], cache_form)
        outputs["page_cache"] = [{"path": paths["page_cache"].rsplit("/", 1)[1], "sha256": h} for h in sinks.file_hashes(spark, paths["page_cache"])]
        outputs["page_cache_records"] = done.page_cache.agg(
            F.count(F.lit(1)).alias("records"), F.count("html").alias("html_records"), F.count_if("html_complete").alias("complete_html_records"), F.count_if("conflicting_snapshots").alias("conflicted_records")
        ).first().asDict()
    if sitemaps:
        outputs["sitemaps"] = [{"path": p.rsplit("/", 1)[1], "sha256": h} for p in sitemaps for h in sinks.file_hashes(spark, p)]
    manifest = {
        "version": 1, "site": U.export_identity(site, site), "universe_complete": done.universe_complete, "normalized_unique_urls": records,
        "expected_normalized_identities": records, "expected_count_origin": "AUTO_DERIVED_FROM_PREPARED_UNION", "sources": done.sources, "outputs": outputs,
    }
    sinks.write_json(spark, f"{folder}/source_manifest.json", manifest)
    sinks.write_json(spark, f"{folder}/prepare_report.json", manifest | {"network_used": False, "source_count": len(done.sources), "required_source_count": sum(s["required"] for s in done.sources)})
    return manifest
