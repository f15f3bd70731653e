"""Extraction of companies and contacts from pages, tier by tier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions import company as M
from orecart.functions import contact as C
from orecart.functions import html as H
from orecart.functions import url as U
from orecart.functions.text import let
from orecart.operators import links as L
from orecart.operators.resolve import dedupe_contacts


def classify(pages: DataFrame) -> DataFrame:
    kind = L.classify_page(F.col("url"), F.concat_ws(" ", L.title_of(F.col("html")), L.first_heading(F.col("html"))))
    return pages.withColumn("archetype", kind).withColumn("record_type", L.record_type(F.col("archetype")))


def _tier1(d: Column, url: Column) -> Column:
    """Payload of a page's tree."""
    name = F.coalesce(F.nullif(d["site_name"], F.lit("")), F.nullif(M.title_tail(d["title"]), F.lit("")), U.domain_stem(url))
    mails = F.transform(F.filter(d["emails"], C.is_role_email), F.lower)
    phones = F.array_compact(F.transform(d["phones"], C.normalize_phone))
    return M.payload(name, d["description"], None, mails, phones, terms=d["terms"])


def _tier2(d: Column, url: Column) -> Column:
    """Payload of the fields that a page's Markdown has."""
    return M.payload(F.coalesce(F.nullif(M.title_tail(d["md_heading"]), F.lit("")), U.domain_stem(url)), d["md_text"], None, terms=d["md_terms"])


def company_from_markdown(pages: DataFrame) -> DataFrame:
    """Tier 2 from Markdown of another source: payload and confidence from its lines."""
    md = F.col("markdown")
    heading = F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1)
    lines = F.filter(F.split(md, "\n"), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("["))
    text = F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) >= 30), F.lit(0)), F.get(lines, F.lit(0)), F.lit(""))
    name = F.coalesce(F.nullif(M.title_tail(heading), F.lit("")), U.domain_stem(F.col("url")))
    out = pages.withColumn("payload", M.payload(name, text, md))
    return out.withColumn("confidence", M.confidence(F.col("payload")))


def _better(first: Column, second: Column) -> Column:
    """struct(payload, confidence, tier) of two structs of payload and confidence; the second counts only if it is surer."""
    of = lambda x, tier: F.struct(x["payload"].alias("payload"), x["confidence"].alias("confidence"), F.lit(tier).alias("tier"))
    return F.when((first["confidence"] < rules.TIER1) & (second["confidence"] > first["confidence"]), of(second, "markdown")).otherwise(of(first, "deterministic"))


def companies(pages: DataFrame, markdown: Callable[[DataFrame], DataFrame] | None = None, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Company records of company pages. Tier 2 counts only on pages below its bound, tier 3 (a provider that returns payload and confidence) only below the next.

    Each page is parsed once for both tiers. Where a callback gives the Markdown or the provider's answer, pages are split first, so that it sees its own alone.
    """
    sure = lambda p: let(p, lambda v: F.struct(v.alias("payload"), M.confidence(v).alias("confidence")))
    kept = classify(pages).where("record_type = 'company'").withColumn("__d", H.page_udf(M.TERMS)(F.col("html")))
    names = [*pages.columns, "archetype", "record_type"]
    one = sure(_tier1(F.col("__d"), F.col("url")))
    if markdown is None:
        rows = kept.select(*names, _better(one, sure(_tier2(F.col("__d"), F.col("url")))).alias("__r")).select(*names, "__r.*")
    else:
        first = kept.select(*names, one.alias("__1")).checkpoint()
        low = F.col("__1.confidence") < rules.TIER1
        two = company_from_markdown(markdown(first.where(low)))
        picked = two.select(*names, _better(F.col("__1"), F.struct("payload", "confidence")).alias("__r")).select(*names, "__r.*")
        rows = first.where(~low).select(*names, "__1.*", F.lit("deterministic").alias("tier")).unionByName(picked)
    if provider is not None:
        rows = rows.checkpoint()
        asked = provider(rows.where(F.col("confidence") < rules.TIER2)).withColumn("tier", F.lit("llm"))
        rows = rows.where(F.col("confidence") >= rules.TIER2).unionByName(asked)
    return rows.withColumn("status", C.status(F.col("confidence"))).drop("html")


def contacts_from_dom(pages: DataFrame) -> DataFrame:
    people = pages.select("page_id", "url", F.posexplode(H.contacts_udf()(F.col("html"))).alias("pos", "c"))
    mail = F.when(~C.is_role_email(F.col("c.email")), F.col("c.email"))
    return people.select(F.col("page_id"), "pos", C.contact(F.col("c.full_name"), F.col("c.title"), mail, F.col("c.phone"), F.col("url"), F.col("c.profile_urls"), F.col("page_id")).alias("contact")).where("contact.full_name <> ''")


def contacts_from_markdown(pages: DataFrame) -> DataFrame:
    lines = pages.select("page_id", "url", F.posexplode(F.split("markdown", "\n")).alias("pos", "raw")).withColumn("line", F.trim("raw")).where((F.col("line") != "") & ~C.is_nav_line(F.col("line")))
    mail, phone = F.regexp_extract("line", f"(?i){rules.EMAIL}", 0), F.regexp_extract("line", rules.PHONE, 0)
    found = lines.withColumn("nt", C.name_title(F.col("line"))).where("nt IS NOT NULL")
    return found.select("page_id", "pos", C.contact(F.col("nt.name"), F.col("nt.title"), F.when(~C.is_role_email(mail), mail), F.when(~C.is_year_range(phone), phone), F.col("url"), None, F.col("page_id")).alias("contact"))


def contacts(pages: DataFrame, domain: Column | None = None) -> DataFrame:
    """Contacts per company: tier 1 alone where it is sure of one, else both tiers; then first-fit merging within the company."""
    domain = domain if domain is not None else U.registrable(U.hostname(F.col("url")))
    kept = classify(pages).where(L.is_contact_source(F.col("archetype")) | F.col("record_type").eqNullSafe("contact")).withColumn("domain", domain)
    one = contacts_from_dom(kept).checkpoint()
    sure = one.groupBy("page_id").agg(F.max("contact.confidence").alias("best")).where(F.col("best") >= rules.CONTACT_TIER1)
    two = contacts_from_markdown(H.with_markdown(kept.join(sure, "page_id", "left_anti")))
    both = one.withColumn("t", F.lit(1)).unionByName(two.withColumn("t", F.lit(2))).join(kept.select("page_id", "domain"), "page_id")
    return dedupe_contacts(both.select("domain", F.struct("page_id", "t", "pos").alias("seq_key"), "contact.*").withColumn("seq", F.concat_ws("-", F.lpad(F.col("seq_key.page_id").cast("string"), 20, "0"), F.col("seq_key.t").cast("string"), F.lpad(F.col("seq_key.pos").cast("string"), 8, "0"))).drop("seq_key"))


def contact_gate(contact_pages: DataFrame, records: DataFrame) -> DataFrame:
    """Only domains with a company record that is not out of the question."""
    return contact_pages.join(records.where("NOT qualification_status <=> 'not_qualified'").select("domain").distinct(), "domain", "left_semi")
