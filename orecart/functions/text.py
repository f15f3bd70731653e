"""Column builders for text: ASCII word bounds, keyword scans, tokens, hashes, backoff."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value worked out once, where fn names it many times."""
    return F.transform(F.array(value), lambda v: fn(v))[0]


def ascii_bounds(pattern: str) -> str:
    r"""Java's \b knows all letters; the rules mean the ASCII bound, as RE2 and browsers have it."""
    return pattern.replace(r"\b", r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))")


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Whether the pattern occurs; null text counts as empty."""
    return F.coalesce(text, F.lit("")).rlike(("(?i)" if ignore_case else "") + ascii_bounds(pattern))


def guarded(text: Column, literals_: Sequence[str], pattern: str) -> Column:
    """matches(text, pattern) for lower-case text, tried only where one of the literals that any match holds stands in the text."""
    some = text.contains(literals_[0])
    for x in literals_[1:]:
        some = some | text.contains(x)
    return some & matches(text, pattern)


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def scan_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords that occur as substrings, in list order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(lower.contains(k), F.lit(k)) for k in keywords])) if keywords else literals(keywords)


def tokens(text: Column, split_hyphen: bool = False, least: int = 3) -> Column:
    """Lower-case words of a-z, 0-9 and hyphen, of a least length."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), r"[\s-]+" if split_hyphen else r"\s+")
    return F.filter(words, lambda w: F.length(w) >= least)


def list_values(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")


def truncate(text: Column, limit: int = 8000, marker: str = "\n[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(marker))).otherwise(text)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def backoff_ms(attempt: Column, base: int = 2000, most: int = 30000) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2), F.greatest(F.lit(0), attempt - 1)), F.lit(most)).cast("long")


def backoff_jitter_ms(attempt: Column, base: int = 2000, most: int = 30000, seed: int = 0) -> Column:
    full = backoff_ms(attempt, base, most)
    return (full / 2 + F.rand(seed) * full / 2).cast("long")


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("::", *[F.nullif(p, F.lit("")) for p in parts])


def error_category(status: Column, name: Column) -> Column:
    """Category of a failed call by status code, then by error name."""
    return (
        F.when(status.isin(401, 403), "auth")
        .when(status == 429, "rate_limit")
        .when(status.isin(408, 500, 502, 503, 504), "transient")
        .when(F.lower(name).rlike("timeout|abort"), "timeout")
        .when(status.between(400, 499), "bad_request")
        .otherwise("unknown")
    )
