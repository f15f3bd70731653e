"""Column builders for URLs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions.text import any_match, let, matches

PARTS = r"^(?i:(https?))://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), PARTS, group)


def hostname(url: Column) -> Column:
    """Lower-case host without user, port and leading www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), "^.*@", ""), r":\d*$", ""), r"^www\.", "")


def path(url: Column) -> Column:
    """Path without trailing slashes, at least one slash."""
    cut = F.regexp_replace(_part(url, 3), "/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def query(url: Column) -> Column:
    """Query without tracking parameters, with its question mark, or empty."""
    tracked = "(?i)^(" + "|".join(rules.TRACKING_PARAMETERS) + ")$"
    kept = F.filter(F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&"), lambda p: (p != "") & ~F.split(p, "=")[0].rlike(tracked))
    return F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))


def port(url: Column) -> Column:
    given = F.regexp_extract(_part(url, 2), r"(:\d+)$", 1)
    standard = ((F.lower(_part(url, 1)) == "http") & (given == ":80")) | ((F.lower(_part(url, 1)) == "https") & (given == ":443"))
    return F.when(standard, F.lit("")).otherwise(given)


def suffix_patterns(suffixes: Sequence[str]) -> tuple[str, str]:
    """Of a short list of public-suffix rules: a pattern of the suffixes, and one that finds a host's suffix with one label more."""
    back = "|".join(re.escape(x[1:]) for x in suffixes if x.startswith("!")) or "(?!)"
    below = [rf"(?!(?:{back})$)[^.]+{re.escape(x[1:])}" for x in suffixes if x.startswith("*.")]
    ends = "|".join([*below, *(re.escape(x) for x in suffixes if x[0] not in "!*")]) or "(?!)"
    # The leftmost place from which the rest matches has the longest suffix; what an exception names is a domain by itself.
    return rf"^(?:{ends})$", rf"(?:^|(?<=\.))(?:(?:{back})|[^.]+\.(?:{ends}|[^.]+))$"


def registrable(host: Column, suffixes: Sequence[str] = rules.SUFFIX_RULES) -> Column:
    """The host's registrable domain by a short list of public-suffix rules; addresses, suffixes and single labels stay as they are.

    For whole lists there is operators.domains, which joins.
    """
    suffix, domain = suffix_patterns(suffixes)
    found = F.regexp_extract(host, domain, 0)
    return F.when(host.rlike(r"^\d+(\.\d+){3}$|^\[|:") | host.rlike(suffix) | (found == ""), host).otherwise(found)


def is_valid(url: Column) -> Column:
    return F.trim(F.coalesce(url, F.lit(""))).rlike(PARTS) & (hostname(url) != "")


def base(url: Column) -> Column:
    return F.concat(F.lower(_part(url, 1)), F.lit("://"), hostname(url), port(url))


def normalized(url: Column) -> Column:
    """The normal form, null for anything but http(s)."""
    return F.when(is_valid(url), F.concat(base(url), path(url), query(url)))


def normalize(url: Column) -> Column:
    """struct(normalized_url, base_url, hostname, domain), null if invalid."""

    def parts(v: Column) -> Column:
        start = F.concat(v["scheme"], F.lit("://"), v["host"], v["port"])
        return let(start, lambda b: F.struct(F.concat(b, path(v["url"]), query(v["url"])).alias("normalized_url"), b.alias("base_url"), v["host"].alias("hostname"), registrable(v["host"]).alias("domain")))

    known = F.struct(url.alias("url"), F.lower(_part(url, 1)).alias("scheme"), hostname(url).alias("host"), port(url).alias("port"))
    return F.when(is_valid(url), let(known, parts))


def domain_key(ref: Column) -> Column:
    """Host of a reference as the serving queries key it."""
    return F.regexp_replace(F.lower(F.split_part(F.regexp_replace(ref, "(?i)^https?://", ""), F.lit("/"), F.lit(1))), r"^www\.", "")


def domain_stem(value: Column) -> Column:
    host = F.split(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "^https?://", ""), r"^www\.", ""), "/")[0]
    return F.regexp_replace(host, r"\.[a-z]{2,}$", "")


def profile_url(url: Column) -> Column:
    out = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    for pattern in ("^https?://", r"^www\.", r"[?#].*$", "/+$"):
        out = F.regexp_replace(out, pattern, "")
    return out


def path_segments(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda x: x != ""))


def is_blocked(host: Column) -> Column:
    """Host or a parent is on the deny list, or ends in an institutional suffix."""
    h = F.regexp_replace(F.regexp_replace(F.split(F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), "^https?://", ""), "/")[0], r"^www\.", ""), r"\.$", "")
    names = "|".join(d.replace(".", r"\.") for d in rules.BLOCKED_DOMAINS)
    suffixes = "|".join(s[1:].replace(".", r"\.") for s in rules.BLOCKED_SUFFIXES)
    return h.rlike(rf"(^|\.)({names}|{suffixes})$")


def is_listicle(title: Column) -> Column:
    return any_match(F.trim(F.coalesce(title, F.lit(""))), rules.LISTICLE_TITLES)


def is_search_result(url: Column) -> Column:
    return any_match(url, rules.SEARCH_RESULT_URLS)


def is_asset(url: Column) -> Column:
    """A candidate's whole URL ends in a file extension."""
    return matches(url, rf"\.({rules.CANDIDATE_EXTENSIONS})$")


def is_dropped(url: Column) -> Column:
    """Links that are no pages: assets, pagination, shop and system pages, unparsable URLs."""
    p = F.lower(_part(url, 3))
    return ~is_valid(url) | matches(p, rf"\.({rules.ASSET_EXTENSIONS})$") | any_match(p, [rules.PAGINATION_PATH, rules.USELESS_BRANCH, rules.USELESS_PAGE]) | matches(_part(url, 4), rules.PAGINATION_QUERY)


def is_public_host(host: Column) -> Column:
    """False for local names and private addresses of either version."""
    h = F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^\[|\]$", "")
    local = (h == "") | (h == "localhost") | h.rlike(r"\.(localhost|local|internal)$")
    private = h.rlike(r"^(0|10|127)(\.\d{1,3}){3}$|^169\.254(\.\d{1,3}){2}$|^172\.(1[6-9]|2\d|3[01])(\.\d{1,3}){2}$|^192\.168(\.\d{1,3}){2}$")
    return ~(local | private | (h == "::1") | (h.contains(":") & h.rlike("^(fc|fd|fe80:)")))


def resolve(href: Column, page_url: Column) -> Column:
    """An absolute URL for a link; null for fragments and other schemes. Dot segments are left as they are."""
    h = F.trim(F.coalesce(href, F.lit("")))
    root = F.concat(F.lower(_part(page_url, 1)), F.lit("://"), F.lower(_part(page_url, 2)))
    folder = F.regexp_replace(F.when(_part(page_url, 3) == "", F.lit("/")).otherwise(_part(page_url, 3)), "[^/]*$", "")
    return (
        F.when((h == "") | h.startswith("#") | h.rlike("(?i)^(mailto|tel|javascript|data):"), F.lit(None).cast("string"))
        .when(h.rlike("(?i)^https?://"), h)
        .when(h.startswith("//"), F.concat(F.lower(_part(page_url, 1)), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(root, h))
        .when(h.startswith("?"), F.concat(root, _part(page_url, 3), h))
        .otherwise(F.concat(root, folder, h))
    )
