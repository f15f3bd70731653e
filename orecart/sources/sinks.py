"""Append-only tables, upserts as folds, exports."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.functions import url as U
from orecart.functions.text import sha256


def append_pages(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """Raw pages with normal URL, hashes and fetch time, by hash of the domain."""
    url = U.normalized(F.col("url"))
    rows = pages.withColumn("url", url).withColumn("domain", U.registrable(U.hostname(F.col("url")))).withColumn("url_hash", sha256(F.col("url"))).withColumn("content_hash", sha256(F.col("html")))
    if "fetched_at" not in rows.columns:
        rows = rows.withColumn("fetched_at", F.current_timestamp())
    rows.withColumn("domain_bucket", F.pmod(F.xxhash64("domain"), F.lit(buckets)).cast("int")).write.mode("append").partitionBy("domain_bucket").parquet(path)


def append_records(records: DataFrame, path: str) -> None:
    rows = records.withColumn("status", F.coalesce("status", F.lit("pending"))) if "status" in records.columns else records.withColumn("status", F.lit("pending"))
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").partitionBy("record_type").parquet(path)


def mark_parsed(pages: DataFrame, path: str, version: int = 1) -> None:
    pages.select("page_id").withColumn("version", F.lit(version)).withColumn("parsed_at", F.current_timestamp()).write.mode("append").parquet(path)


def append_cache(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def save_report(report: dict, path: str) -> None:
    """One pretty JSON file, replaced as a whole."""
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(fd, "w") as out:
        json.dump(report, out, indent=2, default=str)
    os.replace(part, path)


def upsert_product_sources(existing: DataFrame, added: DataFrame) -> DataFrame:
    """Insert or re-enable by product and url; the error is cleared."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(added.withColumns({"enabled": F.lit(True), "last_error": F.lit(None).cast("string"), "__new": F.lit(1)}), allowMissingColumns=True)
    keys = ["product_id", "source_url"]
    first = [c for c in existing.columns if c not in (*keys, "product_name", "enabled", "last_error")]
    latest = lambda c: F.max_by(c, "__new").alias(c)
    return both.groupBy(*keys).agg(latest("product_name"), latest("enabled"), latest("last_error"), *[F.min_by(c, "__new").alias(c) for c in first])


def console_report(rows: DataFrame, most: int = 50) -> str:
    """A numbered text of report rows (domain, confidence, contacts), best first; `most` bounds what reaches the driver."""
    lines = []
    for i, r in enumerate(rows.limit(most).collect(), 1):
        lines.append(f"{i}. {r['domain']} ({(r['confidence'] or 0) * 100:.0f} %)")
        for c in r["contacts"] or []:
            own = c.asDict()
            lines.append("   - " + ", ".join(str(own[k]) for k in ("full_name", "title", "email", "phone") if own.get(k)))
    return "\n".join(lines)


#: Tables of a deployment, by name.
TABLES = {
    "raw_pages": "id bigint, url string, domain string, html string, url_hash string, content_hash string, fetched_at timestamp, parse_version int, domain_bucket int",
    "raw_records": "id bigint, page_id bigint, record_type string, source_type string, source_ref string, payload string, confidence double, status string, qualification_status string, product_id string, created_at timestamp",
    "crawl_targets": "url string, domain string, state string, priority int, depth int, attempts int, next_attempt_at timestamp, last_error string, updated_at timestamp",
    "product_sources": "id bigint, product_id string, product_name string, source_url string, enabled boolean, last_crawled_at timestamp, last_discovered_count bigint, last_error string, created_at timestamp",
    "crawl_suppressions": "domain string, reason string, active boolean, created_at timestamp",
}


def migrate(spark: SparkSession, database: str) -> list[str]:
    """Creates what is missing; running it again changes nothing. Names of the tables."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, columns in TABLES.items():
        by = " PARTITIONED BY (domain_bucket)" if name == "raw_pages" else " PARTITIONED BY (record_type)" if name == "raw_records" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({columns}) USING parquet{by}")
    return list(TABLES)
