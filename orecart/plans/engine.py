"""The engine's entry points: plan, discover, extract, search, dashboard, report."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions import url as U
from orecart.operators import dedupe, extract, fulltext, links, planning, qualify, relevance, serve
from orecart.sources import tables


class Engine:
    """Composes operators over tables. Nothing is fetched: results, pages and records come in as DataFrames.

    provider answers relevance questions for a batch of domains; without one every candidate is left for review.
    """

    def __init__(self, spark: SparkSession, provider: Callable[[list[dict]], list[dict]] | None = None, target_count: int = 10, limit: int = 200) -> None:
        self.spark, self.provider, self.target_count, self.limit = spark, provider, target_count, limit

    def plan(self, query: str, icp: Mapping | None = None) -> dict:
        return planning.search_plan(planning.validate_query(query), icp)

    def discover(self, results: DataFrame, query: str, icp: Mapping | None = None) -> DataFrame:
        """Decided candidates of the plan's queries; a second round with the fresh supplementary queries if too few are approved."""
        first = self.plan(query, icp)["search_queries"]
        rounds = [first, planning.fresh_queries(first, planning.supplementary(query, icp))]
        out = None
        for queries in rounds:
            if not queries or (out is not None and out.where("status = 'approved'").limit(self.target_count).count() >= self.target_count):
                continue
            found = tables.targets_from_results(results.where(F.col("query").isin(queries)))
            flat = dedupe.dedupe_by_domain(found).withColumn("seq", F.concat_ws("-", F.lpad(F.col("priority").cast("string"), 6, "0"), "domain"))
            flat = flat.orderBy("priority", "domain").limit(self.limit).select("seq", "url", "title", "snippet", "priority", "search_engine")
            decided = relevance.rank_candidates(flat, self.provider).checkpoint()
            if out is not None:  # a domain that was approved before is not approved again
                known = out.where("status = 'approved'").select("domain", F.lit("approved").alias("status")).distinct()
                decided = decided.join(known, ["domain", "status"], "left_anti").select(*decided.columns)
            out = decided if out is None else out.unionByName(decided, allowMissingColumns=True)
        return out

    def frontier(self, pages: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
        """URLs to crawl: seeds and the best links of the pages known so far, breadth first."""
        found = links.anchors(pages.withColumn("title", links.title_of(F.col("html"))))
        best = links.page_links(found.select("page_id", F.col("url").alias("page_url"), "title", F.lit(0).alias("depth"), "seq", "href", "anchor_text"))
        edges = best.where(F.col("rank") <= rules.NEXT_FETCHES).join(pages.select("page_id", F.col("url").alias("src")), "page_id").select(U.normalized(F.col("src")).alias("src"), F.col("url").alias("dst"))
        return links.frontier(edges, seeds.select(U.normalized(F.col("url")).alias("url")), depth)

    def extract(self, pages: DataFrame, plan: Mapping | None = None, icp: Mapping | None = None, run_domains: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(qualified company records, contacts). Domains of the run first, then versions and limits; contacts only of domains whose company is not ruled out."""
        own = pages.withColumn("domain", U.registrable(U.hostname(F.col("url"))))
        if run_domains is not None:
            own = own.join(run_domains.select("domain").distinct(), "domain", "left_semi")
        firms = extract.companies(own).checkpoint()
        verdict = qualify.qualify(F.col("payload"), plan, icp, F.col("domain"))
        records = firms.withColumn("verdict", verdict).select("*", F.col("verdict.status").alias("qualification_status"), F.col("verdict.reasons").alias("qualification_reasons")).drop("verdict")
        gated = extract.contact_gate(own, records) if plan else own
        return records, extract.contacts(gated, F.col("domain"))

    def report(self, records: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
        firms = dedupe.best_company(records.select("domain", "confidence", F.col("page_id").alias("seq"), "payload", "qualification_status"))
        people = contacts.select("domain", "confidence", F.element_at("page_ids", 1).alias("seq"), "role_category", "full_name", "title", "email", "phone")
        return serve.report(firms, people)

    def search(self, records: DataFrame, text: str, product: str | None = None, limit: int = 50) -> DataFrame:
        rows = records.where("record_type = 'company'")
        rows = rows.where(F.col("product_id") == product) if product else rows
        rows = rows.withColumn("ref", F.col("source_ref")).withColumn("body", F.col("payload"))
        return serve.search_index(rows, serve.search_terms(text), U.domain_key(F.col("source_ref")), F.coalesce("product_id", F.lit("")), [F.desc("created_at"), F.desc("id")], limit).drop("ref", "body")

    def index(self, records: DataFrame, path: str) -> fulltext.Index:
        """Add the company records' reference and payload to the full-text index at path."""
        rows = records.where("record_type = 'company'").withColumn("payload", F.col("payload").cast("string"))
        return fulltext.Index(self.spark, path).add(fulltext.postings(rows, "id", {"source_ref": "A", "payload": "B"}))

    def search_indexed(self, index: fulltext.Index, records: DataFrame, text: str, product: str | None = None, limit: int = 50) -> DataFrame:
        """The best record of each domain and product by rank in a stored index, which is read for the asked terms alone."""
        rows = records.where("record_type = 'company'")
        rows = rows.where(F.col("product_id") == product) if product else rows
        return fulltext.search(index, rows, serve.search_terms(text), "id", [U.domain_key(F.col("source_ref")), F.coalesce("product_id", F.lit(""))], [F.desc("created_at"), F.desc("id")], limit)

    def dashboard(self, records: DataFrame, targets: DataFrame) -> dict[str, DataFrame]:
        return serve.dashboard(records, targets)
