"""Enrichment of companies from a registry and a code host: the match, its status, and the people it carries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart import rules
from orecart.operators import matching, resolve

RECORD = ["company_id", "entity_id", "entity_name", "confidence", "status", "reason", "accepted"]


def registry(companies: DataFrame, candidates: DataFrame, details: DataFrame) -> DataFrame:
    """One record per company. companies: company_id, name, domain, cin; candidates: cin, name; details: cin, name.

    A company with a number is looked up by it. Others take the best candidate by name: none, a weak one
    that waits for review with the candidate's identity only, or one whose detail is fetched and scored anew.
    """
    known = details.select(F.col("cin").alias("entity_id"), F.col("name").alias("entity_name")).dropDuplicates(["entity_id"])
    own = companies.withColumn("cin", F.nullif(F.trim(F.col("cin")), F.lit("")))
    score = matching.registry_score(F.col("entity_name"), F.col("entity_id"), F.col("name"), F.col("cin"), F.col("domain"))
    asked = own.where("cin IS NOT NULL").join(known, F.col("cin") == F.col("entity_id"), "left")
    asked = asked.withColumn("confidence", F.when(F.col("entity_id").isNotNull(), score).otherwise(F.lit(0.0))).withColumn("reason", F.when(F.col("entity_id").isNull(), "number not found").otherwise("number"))
    free = own.where("cin IS NULL")
    first = matching.registry_score(F.col("candidate_name"), F.lit(""), F.col("company_name"), F.lit(""), F.col("company_domain"))
    found = matching.enrich(free.select("company_id", "name", "domain"), candidates.select(F.col("cin").alias("candidate_id"), "name"), first)
    met = free.join(found.select("company_id", "candidate_id", "candidate_name", F.col("score").alias("first")), "company_id", "left")
    weak = F.col("first").isNull() | (F.col("first") < rules.ACCEPT)
    met = met.join(known.withColumnsRenamed({"entity_id": "detail_id", "entity_name": "detail_name"}), (F.col("candidate_id") == F.col("detail_id")) & ~weak, "left")
    met = met.select("*", F.col("candidate_id").alias("entity_id"), F.coalesce("detail_name", "candidate_name").alias("entity_name"))
    met = met.withColumn("confidence", F.when(F.col("first").isNull(), F.lit(0.0)).when(weak, F.col("first")).otherwise(score)).withColumn("reason", F.when(F.col("first").isNull(), "no match").when(weak, "weak match").otherwise("name"))
    met = met.withColumn("accepted", ~weak)
    both = asked.withColumn("accepted", F.col("confidence") >= rules.ACCEPT).select(*[c for c in RECORD if c != "status"]).unionByName(met.select(*[c for c in RECORD if c != "status"]))
    return both.withColumn("status", F.when(F.col("accepted"), "pending").otherwise("review")).select(*RECORD)


def code_host(companies: DataFrame, organisations: DataFrame) -> DataFrame:
    """One record per company. companies: company_id, name, domain; organisations: login, name, description."""
    orgs = organisations.select(F.col("login").alias("candidate_id"), F.col("login").alias("name"))
    known = organisations.select(F.col("login").alias("entity_id"), F.col("name").alias("entity_name"), "description")
    # Blocks are those of the login; a name or a description that holds the company's name meets by its own blocks.
    said = organisations.select(F.col("login").alias("candidate_id"), F.concat_ws(" ", "name", "description").alias("name"))
    text = organisations.select(F.col("login").alias("l"), F.col("name").alias("shown"), F.col("description").alias("about"))
    pairs = matching.met(companies, orgs).union(matching.met(companies, said)).distinct()
    named = pairs.join(companies.select("company_id", "name", "domain"), "company_id").join(text, F.col("candidate_id") == F.col("l"))
    scored = named.withColumn("score", matching.org_score(F.col("candidate_id"), F.col("shown"), F.col("about"), F.col("name"), F.col("domain"))).where(F.col("score") >= rules.MINIMUM)
    best = matching.best_match(scored, "company_id", "score", "candidate_id").select("company_id", F.col("candidate_id").alias("entity_id"), "score")
    out = companies.select("company_id").join(best, "company_id", "left").join(known.drop("description"), "entity_id", "left")
    return out.select("company_id", "entity_id", "entity_name", F.coalesce("score", F.lit(0.0)).alias("confidence"), F.when(F.col("score") >= rules.ACCEPT, "pending").otherwise("review").alias("status"), F.when(F.col("score").isNull(), "no match").when(F.col("score") < rules.ACCEPT, "weak match").otherwise("name").alias("reason"), F.coalesce(F.col("score") >= rules.ACCEPT, F.lit(False)).alias("accepted"))


def directors(records: DataFrame, listed: DataFrame) -> DataFrame:
    """People of accepted registry records, with their company as scope. listed: cin, seq, din, name, designation."""
    rows = records.where("accepted").select("company_id", F.col("entity_id").alias("cin"), "confidence").join(listed, "cin")
    return resolve.people_from_directors(rows, "company_id").withColumnRenamed("company_id", "scope")


def members(records: DataFrame, listed: DataFrame) -> DataFrame:
    """People of accepted organisations, with their company as scope. listed: org_login, seq, login, name, html_url."""
    rows = records.where("accepted").select("company_id", F.col("entity_id").alias("org_login"), "confidence").join(listed, "org_login")
    return resolve.people_from_members(rows, "company_id").withColumnRenamed("company_id", "scope")
