"""Relevance of search candidates: reject chain, representatives, batches, decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions import url as U


def filter_candidates(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """Normal URL columns and reason_code, the first rule that rejects (null: accepted). Later equals of an accepted URL are duplicates."""
    norm = candidates.withColumn("norm", U.normalize(F.col("url")))
    early = (
        F.when(F.col("norm").isNull(), "malformed_url")
        .when(U.is_asset(F.col("norm.normalized_url")), "non_html_asset")
        .when(U.is_blocked(F.col("norm.hostname")), "excluded_domain")
        .when(U.is_listicle(F.col("title")), "listicle_title")
        .when(U.is_search_result(F.col("norm.normalized_url")), "search_result_page")
    )
    # Rejected rows get a key of their own, so they neither shadow an accepted row nor gather in one partition.
    w = Window.partitionBy(F.when(F.col("early").isNull(), F.col("norm.normalized_url")).otherwise(F.concat(F.lit("\0"), F.col(seq).cast("string")))).orderBy(seq)
    out = norm.withColumn("early", early).withColumn("rn", F.row_number().over(w))
    reason = F.coalesce("early", F.when(F.col("rn") > 1, "duplicate_url"))
    return out.withColumn("reason_code", reason).select(*candidates.columns, F.col("norm.normalized_url").alias("normalized_url"), F.col("norm.base_url").alias("base_url"), F.col("norm.hostname").alias("hostname"), F.col("norm.domain").alias("domain"), "reason_code")


def drop_blocked(rows: DataFrame, host: str, deny: DataFrame, deny_col: str = "domain") -> DataFrame:
    """Anti-join of hosts and all their parents with a table of domains; Spark sizes the join."""
    labels = F.split(F.col(host), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = rows.select(host).where(F.col(host).isNotNull()).distinct()
    hit = hosts.select(host, F.explode(parents).alias("__parent")).join(deny.select(F.col(deny_col).alias("__parent")).distinct(), "__parent", "left_semi").select(host).distinct()
    return rows.join(hit, host, "left_anti")


def representatives(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """Per domain the first candidate that has a title or a snippet, else the first."""
    has = (F.coalesce("title", F.lit("")) != "") | (F.coalesce("snippet", F.lit("")) != "")
    w = Window.partitionBy("domain").orderBy(has.desc(), seq)
    return candidates.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows numbered from 0 in order. Offsets per range replace one global window; the ranges are written once, so that both uses see the same."""
    marked = rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()).checkpoint()
    local = marked.withColumn("__rn", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    counts = marked.groupBy("__part").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return local.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__rn") - 1).drop("__part", "__rn", "__before")


def batches(reps: DataFrame, order: str = "seq", size: int = rules.BATCH) -> DataFrame:
    """Numbered batches of `size` rows in order."""
    return numbered(reps, order, "__n").withColumn("batch", F.floor(F.col("__n") / size).cast("int")).drop("__n")


def decide(type_: Column, is_website: Column, matches_plan: Column, missing: Column) -> Column:
    """Status of three-valued facts."""
    company = type_.isin("company", "company_profile") & is_website.eqNullSafe(F.lit(True))
    return (
        F.when(missing, "review")
        .when(is_website.eqNullSafe(F.lit(False)), "rejected")
        .when(type_.isin(rules.EXCLUDED_TYPES), "rejected")
        .when(company & (matches_plan.isNull() | matches_plan), "approved")
        .when(matches_plan.eqNullSafe(F.lit(False)), "rejected")
        .otherwise("review")
    )


def decide_reason(type_: Column, is_website: Column, matches_plan: Column, missing: Column, given: Column) -> Column:
    company = type_.isin("company", "company_profile") & is_website.eqNullSafe(F.lit(True))
    own = (
        F.when(is_website.eqNullSafe(F.lit(False)), "not_company_website")
        .when(type_.isin(rules.EXCLUDED_TYPES), type_)
        .when(company & matches_plan, "matches_search_plan")
        .when(company & matches_plan.isNull(), "company_needs_profile_verification")
        .when(matches_plan.eqNullSafe(F.lit(False)), "not_matching_search_plan")
        .otherwise("insufficient_evidence")
    )
    return F.when(missing, "no_decision").otherwise(F.coalesce(F.nullif(given, F.lit("")), own))


FACTS = "domain string, type string, is_company_website boolean, matches_search_plan boolean, fact_reason string, evidence string"


def rank_candidates(candidates: DataFrame, provider: Callable[[list[dict]], list[dict]] | None = None, retries: int = 1) -> DataFrame:
    """Filter, ask the provider once per domain in batches, and fan decisions out to all URLs.

    A batch fails as a whole when a domain is unanswered; after the retry its domains go to review.
    Without a provider everything accepted goes to review.
    """
    chain = filter_candidates(candidates)
    accepted = chain.where("reason_code IS NULL")
    if provider is None:
        facts = accepted.sparkSession.createDataFrame([], FACTS)
        failed = F.lit("provider_unavailable")
    else:
        asked = batches(representatives(accepted))

        def ask(group):
            import pandas as pd

            want = group[["domain", "title", "snippet", "normalized_url"]].to_dict("records")
            for _ in range(retries + 1):
                try:
                    got = {x["domain"].lower(): x for x in provider(want)}
                except Exception:  # noqa: BLE001  a provider's failure is an answer: review
                    continue
                if all(w["domain"].lower() in got for w in want):
                    return pd.DataFrame([{"domain": w["domain"], **{k: got[w["domain"].lower()].get(k) for k in ("type", "is_company_website", "matches_search_plan")}, "fact_reason": got[w["domain"].lower()].get("reason_code"), "evidence": got[w["domain"].lower()].get("evidence", "")} for w in want])
            return pd.DataFrame({c: pd.Series(dtype=object) for c in ("domain", "type", "is_company_website", "matches_search_plan", "fact_reason", "evidence")})

        facts = asked.groupBy("batch").applyInPandas(ask, FACTS)
        failed = F.lit("provider_failed")
    joined = accepted.drop("reason_code").join(facts, "domain", "left")
    missing = F.col("type").isNull()
    status = decide(F.col("type"), F.col("is_company_website"), F.col("matches_search_plan"), missing)
    reason = F.when(missing, failed).otherwise(decide_reason(F.col("type"), F.col("is_company_website"), F.col("matches_search_plan"), missing, F.col("fact_reason")))
    decided = joined.withColumn("status", status).withColumn("reason_code", reason).drop("fact_reason")
    rejected = chain.where("reason_code IS NOT NULL").withColumn("status", F.lit("rejected"))
    return decided.unionByName(rejected, allowMissingColumns=True)
