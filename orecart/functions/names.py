"""Column builders for person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.text import let, literals, squeeze


def name_key(name: Column) -> Column:
    lower = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "['’]", "")
    return F.trim(F.regexp_replace(lower, "[^a-z0-9]+", " "))


def name_tokens(name: Column) -> Column:
    return F.filter(F.split(name_key(name), " "), lambda t: F.length(t) >= 2)


def is_plausible(raw: Column) -> Column:
    """Whether a fragment reads as a person's name rather than a label, a title, an address or prose."""
    return let(squeeze(raw), _is_plausible)


def _is_plausible(name: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(name, ",", " "), r"\s+"), lambda p: p != "")
    bare = F.transform(parts, lambda p: F.lower(F.regexp_replace(F.regexp_replace(p, "^[\"'’(\\[{]+|[\"'’)\\]}]+$", ""), "[.,]$", "")))
    stop, small = literals(rules.NAME_STOP_WORDS), literals(rules.NAME_PARTICLES + rules.NAME_SUFFIXES)
    capital = F.filter(F.arrays_zip(parts.alias("part"), bare.alias("word")), lambda x: ~F.array_contains(small, x["word"]) & x["part"].rlike("^[A-Z]"))
    words = F.filter(name_tokens(name), lambda t: ~F.array_contains(stop, t))
    role_only = (F.size(words) > 0) & F.forall(words, lambda t: F.array_contains(literals(rules.ROLE_WORDS), t))
    return (
        (name != "")
        & ~F.lower(name).isin(rules.NAV_LABELS)
        & (F.length(name) <= 60)
        & ~name.rlike(r"[@:/\\.!?;]")
        & F.size(parts).between(2, 5)
        & ~F.exists(bare, lambda w: F.array_contains(stop, w))
        & F.forall(parts, lambda p: p.rlike("^[A-Za-z][A-Za-z'’.-]*$"))
        & (F.size(capital) >= 2)
        & ~role_only
        & (F.size(F.filter(words, lambda t: ~F.array_contains(small, t))) >= 2)
    )


def split_name(full: Column) -> Column:
    """struct(first_name, last_name)."""
    return let(squeeze(full), _split_name)


def _split_name(name: Column) -> Column:
    comma, parts = F.split(name, ","), F.split(name, " ")
    first = F.when(name.contains(","), F.trim(F.coalesce(F.get(comma, F.lit(1)), F.lit("")))).when(F.size(parts) == 1, name).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1)), " "))
    last = F.when(name.contains(","), F.trim(comma[0])).when(F.size(parts) == 1, F.lit("")).otherwise(F.element_at(parts, -1))
    return F.struct(first.alias("first_name"), last.alias("last_name"))


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal keys, one token set within the other, or an edit distance of at most a fifth of the longer key."""
    ka, kb, ta, tb = name_key(a), name_key(b), name_tokens(a), name_tokens(b)
    within = (F.size(ta) >= 2) & (F.size(tb) >= 2) & F.when(F.size(ta) <= F.size(tb), F.size(F.array_except(ta, tb)) == 0).otherwise(F.size(F.array_except(tb, ta)) == 0)
    near = F.levenshtein(ka, kb) * 5 <= F.greatest(F.length(ka), F.length(kb))
    return (ka != "") & (kb != "") & ((ka == kb) | within | near)
