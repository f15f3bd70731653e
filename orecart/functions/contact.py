"""Column builders for contacts: mailboxes, phones, roles, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.names import is_plausible, split_name
from orecart.functions.text import ascii_bounds, let, matches


def normalize_email(raw: Column) -> Column:
    value = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(value.rlike(f"^{rules.EMAIL}$"), value)


def is_role_email(raw: Column) -> Column:
    """A shared mailbox: the local part without . _ + - begins with a role word."""
    value = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    local = F.regexp_replace(F.split(value, "@")[0], "[._+-]", "")
    return value.contains("@") & (local != "") & local.rlike(f"^({rules.ROLE_MAILBOX})")


def identity_email(raw: Column) -> Column:
    return F.when(~is_role_email(raw), normalize_email(raw))


def normalize_phone(raw: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(raw, F.lit("")), "[^0-9+]", "")
    return F.when(F.length(digits) >= 7, digits)


def normalize_role(title: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(title, F.lit(""))))
    out = F.when(text == "", F.lit(None).cast("string"))
    for category, pattern in rules.ROLE_RULES:
        out = out.when(text.rlike(ascii_bounds(pattern)), category)
    return out.otherwise("other")


def confidence(name: Column, email: Column, phone: Column, title: Column) -> Column:
    """Hundredths: 35 for a plausible name, 25 for an own mailbox, 15 for a phone, 20 for a title."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    points = F.when(is_plausible(name), 35).otherwise(0) + F.when(has(email) & ~is_role_email(email), 25).otherwise(0) + F.when(has(phone), 15).otherwise(0) + F.when(has(title), 20).otherwise(0)
    return F.least(F.lit(100), points) / F.lit(100.0)


def status(conf: Column) -> Column:
    return F.when(conf >= rules.PROMOTE, F.lit("pending")).otherwise(F.lit("review"))


def is_year_range(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))).rlike("^(19|20)\\d{2}\\s*[-–—]\\s*(19|20)\\d{2}$")


def is_nav_line(line: Column) -> Column:
    label = F.regexp_extract(line, r"^\[([^\]]*)\]\([^)]*\)$", 1)
    return line.rlike(f"(?i)^({rules.NAV_LINE})$") | (F.regexp_count(line, F.lit(r"\[[^\]]*\]\([^)]*\)")) >= 2) | F.trim(label).rlike(f"(?i)^({rules.NAV_LINE})$")


def name_title(line: Column) -> Column:
    """struct(name, title) of a 'Name | Title', 'Name - Title' (long dashes) or 'Name, Title' line, else null."""
    cleaned = F.trim(F.regexp_replace(F.coalesce(line, F.lit("")), "^[#>*\\s•·-]+", ""))
    parts = F.split(cleaned, "\\s+\\|\\s+|\\s+[–—]\\s+|\\s*,\\s*")
    name, title = F.trim(parts[0]), F.trim(F.array_join(F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - 1)), " "))
    return F.when((F.size(parts) >= 2) & (name != "") & (title != "") & matches(title, rules.ROLE_HINT) & is_plausible(name), F.struct(name.alias("name"), title.alias("title")))


def contact(full_name: Column, title: Column, email: Column, phone: Column, source_url: Column, profile_urls: Column | None = None, page_id: Column | None = None) -> Column:
    """A normalised contact struct."""
    given = F.struct(F.when(is_plausible(full_name), F.trim(full_name)).otherwise(F.lit("")).alias("name"), normalize_email(email).alias("mail"), normalize_phone(phone).alias("tel"), F.trim(F.coalesce(title, F.lit(""))).alias("job"), F.coalesce(source_url, F.lit("")).alias("source"))
    urls = F.array_distinct(F.filter(profile_urls, lambda u: u != "")) if profile_urls is not None else F.array().cast("array<string>")
    pages = F.array_compact(F.array(page_id.cast("long"))) if page_id is not None else F.array().cast("array<bigint>")

    def fill(v: Column) -> Column:
        names = split_name(v["name"])
        return F.struct(
            v["name"].alias("full_name"),
            names["first_name"].alias("first_name"),
            names["last_name"].alias("last_name"),
            v["job"].alias("title"),
            normalize_role(v["job"]).alias("role_category"),
            v["mail"].alias("email"),
            v["tel"].alias("phone"),
            urls.alias("profile_urls"),
            v["source"].alias("source_url"),
            F.filter(F.array(v["source"]), lambda u: u != "").alias("source_urls"),
            pages.alias("page_ids"),
            confidence(v["name"], v["mail"], v["tel"], v["job"]).alias("confidence"),
        )

    return let(given, fill)
