"""Scans of pages, records, targets and product sources; files of search results, caches, sitemaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "query string, page int, position int, url string, title string, snippet string, engine string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unparsed(pages: DataFrame, version: int = 1, limit: int | None = 5000, order: Sequence[Column] | None = None) -> DataFrame:
    """Pages never parsed or parsed by an older version, newest first."""
    out = pages.where(F.col("parse_version").isNull() | (F.col("parse_version") < version))
    return out if limit is None else out.orderBy(*(order or (F.desc("fetched_at"), F.desc("id")))).limit(limit)


def unparsed_by_log(pages: DataFrame, log: DataFrame, version: int = 1) -> DataFrame:
    """The same over an append-only parse log."""
    return pages.join(log.where(F.col("version") >= version).select("page_id").distinct(), "page_id", "left_anti")


def by_domain(pages: DataFrame, domain: str, limit: int = 200) -> DataFrame:
    return pages.where(F.col("domain") == domain).orderBy(F.desc("fetched_at"), F.desc("id")).limit(limit)


def by_id(pages: DataFrame, page_id: int) -> DataFrame:
    return pages.where(F.col("id") == page_id)


def records(rows: DataFrame, record_type: str | None = None, limit: int = 10000) -> DataFrame:
    out = rows if record_type is None else rows.where(F.col("record_type") == record_type)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def targets(rows: DataFrame, limit: int = 10000) -> DataFrame:
    return rows.orderBy("priority", "id").limit(limit)


def target_by_url(rows: DataFrame, url: str) -> DataFrame:
    return rows.where(F.col("url") == url)


def product_sources(rows: DataFrame, product_id: str, enabled_only: bool = False) -> DataFrame:
    own = rows.where(F.col("product_id") == product_id)
    return own.where("enabled").orderBy("id") if enabled_only else own.orderBy(F.desc("created_at"), F.desc("id"))


def not_suppressed(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    active = suppressions.where("active").select(F.lower("domain").alias("__d")).distinct()
    return rows.join(active, F.lower(rows["domain"]) == F.col("__d"), "left_anti")


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """Search results from JSON files: fields coerced, http(s) only."""
    return spark.read.schema(RESULTS).json(path, mode="PERMISSIVE").where(F.col("url").rlike("(?i)^https?://"))


def search_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached results per key; a missing or unreadable cache is empty."""
    schema = "key string, cached_at string, results array<struct<url:string,title:string,snippet:string,engine:string>>"
    try:
        return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def fresh(cache: DataFrame, now: Column, days: int = 30, bypass: bool = False) -> DataFrame:
    """Latest entry per key if its age is below the limit; unreadable times are stale."""
    if bypass:
        return cache.limit(0)
    at = F.try_to_timestamp("cached_at")
    last = cache.withColumn("at", at).where("at IS NOT NULL").groupBy("key").agg(F.max_by(F.struct(*cache.columns), "at").alias("x"), F.max("at").alias("at"))
    return last.where(F.col("at") > now - F.expr(f"INTERVAL {days} DAYS")).select("x.*")


def targets_from_results(results: DataFrame) -> DataFrame:
    """Search rows as crawl targets; priority is the position, one at least."""
    from orecart.functions import url as U
    from orecart.rules import SEARCH_EXCLUDED

    out = results.withColumn("norm", U.normalize(F.col("url"))).where("norm IS NOT NULL").where(~F.col("norm.domain").isin(SEARCH_EXCLUDED))
    return out.select(F.col("norm.domain").alias("domain"), F.col("norm.normalized_url").alias("url"), F.col("norm.base_url").alias("base_url"), F.greatest(F.lit(1), "position").alias("priority"), F.lit("website").alias("source_type"), F.lit(0).alias("depth"), F.lit("queued").alias("state"), "title", "snippet", F.coalesce(F.nullif("engine", F.lit("")), F.lit("unknown")).alias("search_engine"), F.array("query").alias("matched_queries"), F.struct("query", "page", "position").alias("seq"))


def robots_sitemaps(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*Sitemap:[ \t]*(\S+)[ \t]*\r?$"), F.lit(1))


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.trim(x))


def is_sitemap_index(xml: Column) -> Column:
    return xml.rlike("(?i)<sitemapindex")


def sitemap_pages(sitemaps: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """Page URLs reachable from root sitemaps (url, domain) through index files in the table (url, xml), same domain only."""
    from orecart.functions import url as U

    level, pages, seen = roots.select("url", "domain").distinct(), None, None
    for _ in range(depth):
        files = level.join(sitemaps, "url")
        found = files.select("domain", is_sitemap_index(F.col("xml")).alias("index"), F.explode(sitemap_locations(F.col("xml"))).alias("url")).where(U.registrable(U.hostname(F.col("url"))) == F.col("domain"))
        leaf = found.where(~F.col("index")).select("url", "domain")
        pages = leaf if pages is None else pages.union(leaf)
        seen = level if seen is None else seen.union(level)
        level = found.where("index").select("url", "domain").distinct().join(seen, ["url", "domain"], "left_anti")
    return pages.where(~U.is_dropped(F.col("url"))).distinct()


def registry_candidates(rows: DataFrame) -> DataFrame:
    """Registry rows with their aliased fields resolved to one name each."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns], F.lit(""))
    return rows.select(pick("cin", "CIN", "company_cin").alias("cin"), pick("company_name", "name", "companyName").alias("company_name"), pick("status", "company_status").alias("status"))
