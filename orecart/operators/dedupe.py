"""Grouping by domain: search targets, best companies, funnel counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart import rules


def dedupe_by_domain(rows: DataFrame, queries: str = "matched_queries", priority: str = "priority", seq: str = "seq") -> DataFrame:
    """One row per domain: that of least priority (first of equals), distinct queries in first-seen order, occurrences."""
    others = [c for c in rows.columns if c not in ("domain", queries)]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(queries).alias("q"))))
    out = rows.groupBy("domain").agg(F.min_by(F.struct(*others), F.struct(priority, seq)).alias("best"), F.array_distinct(F.flatten(F.transform(ordered, lambda x: x["q"]))).alias(queries), F.count("*").alias("occurrences"))
    return out.select("domain", "best.*", queries, "occurrences")


def best_company(records: DataFrame) -> DataFrame:
    """The record of highest confidence per domain, the first of equals; rows without a domain go."""
    rows = records.where(F.coalesce("domain", F.lit("")) != "")
    return rows.groupBy("domain").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "domain"]), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("seq"))).alias("best")).select("domain", "best.*")


def leadership_count(contacts: DataFrame) -> DataFrame:
    return contacts.agg(F.count("*").alias("contacts"), F.count_if(F.col("role_category").isin(rules.LEADERSHIP_ROLES)).alias("leaders"))


def engine_counts(results: DataFrame, *by: str) -> DataFrame:
    """Results per engine (unknown where none is named), within the columns `by`."""
    engine = F.coalesce(F.nullif("search_engine", F.lit("")), F.lit("unknown"))
    return results.groupBy(*by, engine.alias("engine")).agg(F.count("*").alias("results"))


def diagnose(results: DataFrame) -> DataFrame:
    """Per query the number of results and the engines that gave them."""
    return results.groupBy("query").agg(F.count("*").alias("results"), F.array_sort(F.collect_set(F.nullif("engine", F.lit("")))).alias("engines"))


def run_stats(decided: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s)
    return decided.agg(F.count("*").alias("discovered"), one("approved").alias("relevant"), one("rejected").alias("rejected"), one("review").alias("review"))


def unique_phones(people: DataFrame) -> DataFrame:
    """Phones that some domain has exactly once; uniqueness in one domain counts for all."""
    return people.where("phone IS NOT NULL").groupBy(F.coalesce("company_domain", F.lit("")).alias("d"), "phone").count().where("count = 1").select("phone").distinct()
