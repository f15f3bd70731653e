"""Column builders for companies: payload, confidence, legal keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.text import ascii_bounds, literals, scan_keywords


def slug(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def legal_key(value: Column) -> Column:
    return slug(F.regexp_replace(F.coalesce(value, F.lit("")), "(?i)" + ascii_bounds(rules.LEGAL_SUFFIX), ""))


def title_tail(title: Column) -> Column:
    """The last part of 'Page | Company' or 'Page - Company'."""
    return F.element_at(F.split(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " ")), "\\s+\\|\\s+|\\s+[–—-]\\s+"), -1)


#: All words that a payload's lists are made of.
TERMS = list(dict.fromkeys([*rules.TECH_KEYWORDS, *rules.PRODUCT_KEYWORDS, *rules.INDUSTRY_KEYWORDS]))


def payload(name: Column, description: Column, text: Column | None, role_emails: Column | None = None, phones: Column | None = None, terms: Column | None = None) -> Column:
    """Company payload; terms, where given, are those of TERMS that occur, and the text is not read."""
    none = F.array().cast("array<string>")
    scan = lambda words: scan_keywords(text, words) if terms is None else F.filter(literals(words), lambda w: F.array_contains(terms, w))
    signals = F.transform(scan(rules.TECH_KEYWORDS), lambda t: F.struct(t.alias("technology"), F.lit("mentions").alias("relationship"), none.alias("evidence_ids"), F.lit("").alias("explanation")))
    return F.struct(
        F.trim(F.coalesce(name, F.lit(""))).alias("company_name"),
        F.lit("").alias("legal_name"),
        F.lit("").alias("country"),
        F.lit("").alias("headquarters"),
        scan(rules.INDUSTRY_KEYWORDS).alias("industries"),
        scan(rules.PRODUCT_KEYWORDS).alias("products_services"),
        signals.alias("technology_signals"),
        F.trim(F.coalesce(description, F.lit(""))).alias("company_description"),
        F.array_distinct(role_emails if role_emails is not None else none).alias("role_emails"),
        F.array_distinct(phones if phones is not None else none).alias("company_phones"),
    )


def confidence(p: Column) -> Column:
    """Hundredths: 35 name, 30 description of 50 characters (15 if shorter), 20 products, 10 technology, 5 industry."""
    n = F.length(p["company_description"])
    points = F.when(p["company_name"] != "", 35).otherwise(0) + F.when(n >= 50, 30).when(n > 0, 15).otherwise(0)
    points = points + F.when(F.size(p["products_services"]) > 0, 20).otherwise(0) + F.when(F.size(p["technology_signals"]) > 0, 10).otherwise(0) + F.when(F.size(p["industries"]) > 0, 5).otherwise(0)
    return F.least(F.lit(100), points) / F.lit(100.0)


def profile_text(p: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p[c], F.lit("")) for c in ("company_name", "company_description")], p["industries"], p["products_services"], *[F.nullif(p[c], F.lit("")) for c in ("country", "headquarters")])
