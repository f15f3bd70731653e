"""Serving: dashboard, company index, evidence ranking, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions import url as U

RECORD = "id long, page_id long, source_type string, source_ref string, record_type string, payload string, confidence double, status string, qualification_status string, qualification_reasons array<string>, run_id string, product_id string, product_name string, created_at timestamp"


def status_rank(status: Column) -> Column:
    return F.when(status == "qualified", 0).when(status == "review", 1).otherwise(2)


def latest_companies(records: DataFrame, key: Column | None = None) -> DataFrame:
    """One company record per product and domain: best status, confidence, description, newest."""
    key = key if key is not None else U.domain_key(F.col("source_ref"))
    length = F.length(F.coalesce(F.get_json_object("payload", "$.company_description"), F.lit("")))
    w = Window.partitionBy(F.coalesce("product_id", F.lit("")), key).orderBy(status_rank(F.col("qualification_status")), F.col("confidence").desc_nulls_last(), length.desc(), F.col("created_at").desc(), F.col("id").desc())
    return records.where("record_type = 'company'").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def summary(records: DataFrame) -> DataFrame:
    """One row: companies, contacts and the three qualification counts."""
    one = lambda s: F.count_if(F.col("qualification_status") == s).alias(s)
    contacts = records.where("record_type = 'contact'").agg(F.count("*").alias("contacts"))
    return latest_companies(records).agg(F.count("*").alias("companies"), one("qualified"), one("review"), one("not_qualified")).crossJoin(F.broadcast(contacts))


def visible(records: DataFrame, limit: int = 100) -> DataFrame:
    rows = latest_companies(records).unionByName(records.where("record_type = 'contact'"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def dashboard(records: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
    return {"summary": summary(records), "records": visible(records), "targets": targets.groupBy("state").agg(F.count("*").alias("count")), "recent_targets": targets.orderBy(F.desc("updated_at"), F.desc("id")).limit(100)}


def scope(rows: DataFrame, product: str = "all", record_type: str | None = None, status: str | None = None) -> DataFrame:
    """Interactive filters: all products, 'unassigned', or one id; record type; qualification."""
    out = rows if product == "all" else rows.where(F.col("product_id").isNull() if product == "unassigned" else F.col("product_id") == product)
    out = out.where(F.col("record_type") == record_type) if record_type else out
    return out.where(F.col("qualification_status") == status) if status else out


def search_terms(text: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split(r"[^\w]+|_", (text or "").lower()) if t))


def search_index(rows: DataFrame, terms: Sequence[str], key: Column, product: Column, order: Sequence[Column], limit: int = 50) -> DataFrame:
    """Full-text search over ref (weight 10) and body (weight 4): all terms must occur; the score adds weighted term counts.

    The score is this engine's own. One row per key and product, best score first.
    """
    if not terms:
        return rows.withColumn("relevance", F.lit(0)).limit(0)
    split = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    want = F.array(*[F.lit(t) for t in terms])
    found = rows.withColumn("__a", F.filter(split(F.col("ref")), lambda t: F.array_contains(want, t))).withColumn("__b", F.filter(split(F.col("body")), lambda t: F.array_contains(want, t)))
    hit = found.where(F.size(F.array_except(want, F.concat("__a", "__b"))) == 0).withColumn("relevance", F.size("__a") * 10 + F.size("__b") * 4)
    w = Window.partitionBy(key, product).orderBy(F.desc("relevance"), *order)
    return hit.withColumn("rn", F.row_number().over(w)).where("rn = 1").orderBy(F.desc("relevance"), *order).limit(min(max(limit, 1), 100)).drop("rn", "__a", "__b")


def evidence_score(title: Column, headings: Column, url: Column, text: Column, terms: Sequence[str]) -> Column:
    score = F.lit(0)
    for t in terms:
        for c, n in ((title, 8), (headings, 5), (url, 4), (text, 1)):
            score = score + F.when(F.lower(F.coalesce(c, F.lit(""))).contains(t), n).otherwise(0)
    for p in rules.IMPORTANT_PATHS:
        score = score + F.when(F.lower(F.coalesce(url, F.lit(""))).contains(p), 4).otherwise(0)
    return score


def report(companies: DataFrame, contacts: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """(companies with their best contacts, totals). companies: domain, confidence, seq; contacts: domain, confidence, seq, role_category."""
    w = Window.partitionBy("domain").orderBy(F.desc("confidence"), "seq")
    best = contacts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    entry = F.struct("rank", *[c for c in contacts.columns if c != "domain"])
    per = best.groupBy("domain").agg(F.array_sort(F.collect_list(entry)).alias("contacts"))
    rows = companies.join(per, "domain", "left").orderBy(F.desc("confidence"), "seq")
    totals = contacts.agg(F.count("*").alias("total_contacts"), F.count_if(F.col("role_category").isin(rules.LEADERSHIP_ROLES)).alias("leadership_contacts")).crossJoin(F.broadcast(companies.agg(F.count("*").alias("total_companies"))))
    return rows, totals


def readiness(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and(F.when(F.col("required"), F.coalesce("ok", F.lit(False)) | F.coalesce("skipped", F.lit(False)))), F.lit(True)).alias("ready"))
