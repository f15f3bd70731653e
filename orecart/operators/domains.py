"""Registrable domains by a table of public-suffix rules.

A rule names a suffix (`co.in`), all names below one (`*.ck`), or takes one of these back (`!www.ck`). The
longest suffix that a rule gives stands, an exception before all; without a rule the last label is the
suffix. A host's registrable domain is its suffix and one label more. Every suffix of a distinct host
meets the rules by equality; no host is compared with a rule that it does not end in.

Defined cases: an address, and a host that is a suffix itself or has one label, are their own domain; a
null host has none; labels are taken as they stand, in lower case; repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDRESS = r"^\d+(\.\d+){3}$|^\[|:"


def read_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """Rules of a file in the public list's format: one rule a line up to white space, `//` comments, a marked section of private ones."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    start = lines.where("line LIKE '%BEGIN PRIVATE DOMAINS%'").agg(F.min("n").alias("start"))
    rule = F.lower(F.split(F.trim("line"), r"\s+")[0])
    kept = lines.crossJoin(F.broadcast(start)).where((rule != "") & ~rule.startswith("//"))
    return (kept if private else kept.where("start IS NULL OR n < start")).select(rule.alias("rule")).distinct()


def rule_keys(rules: DataFrame) -> DataFrame:
    """suffix, and how many labels more (wildcard: 1) or fewer (exception: 1) than it the rule's suffix has."""
    r = F.lower(F.trim("rule"))
    more = F.when(r.startswith("*."), 1).when(r.startswith("!"), -1).otherwise(0)
    return rules.where(F.col("rule").isNotNull()).select(F.regexp_replace(r, r"^(\*\.|!)", "").alias("suffix"), more.alias("more")).distinct()


def domains(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """host, domain for every distinct host."""
    own = hosts.select(F.col(host).alias("host")).where("host IS NOT NULL").distinct()
    labels = F.split("host", r"\.")
    each = own.where(~F.col("host").rlike(ADDRESS)).select("host", F.size(labels).alias("n"), F.posexplode(labels).alias("at", "_"), labels.alias("labels"))
    each = each.select("host", "n", (F.col("n") - F.col("at")).alias("size"), F.array_join(F.slice("labels", F.col("at") + 1, F.col("n")), ".").alias("suffix"))
    met = each.join(rule_keys(rules), "suffix", "left")
    size = F.col("size") + F.col("more")
    best = met.groupBy("host", "n").agg(F.max(F.when(F.col("more") < 0, size)).alias("taken_back"), F.max(F.when((F.col("more") >= 0) & (size <= F.col("n")), size)).alias("longest"))
    size = F.coalesce("taken_back", "longest", F.lit(1))
    named = best.select("host", F.when(size < F.col("n"), F.array_join(F.slice(F.split("host", r"\."), F.col("n") - size, size + 1), ".")).otherwise(F.col("host")).alias("domain"))
    return named.unionByName(own.where(F.col("host").rlike(ADDRESS)).select("host", F.col("host").alias("domain")))


def with_domain(rows: DataFrame, host: Column, rules: DataFrame) -> DataFrame:
    """Adds domain. Only distinct hosts meet the rules; a host with many rows is joined as any skewed key is."""
    own = rows.withColumn("__host", host)
    return own.join(domains(own, rules, "__host").withColumnRenamed("host", "__host"), "__host", "left").drop("__host")
