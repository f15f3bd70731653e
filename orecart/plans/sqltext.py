"""SQL text of the oracles, written for another engine from the same rule data."""

from __future__ import annotations

import re

from orecart import rules

PARTS = r"^(?i:(https?))://([^/?#\s]+)([^?#]*)(\?[^#]*)?(#.*)?$"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(x: str, n: int) -> str:
    return f"regexp_extract(trim(coalesce({x}, '')), {q(PARTS)}, {n})"


def host(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({part(x, 2)}), '^.*@', ''), ':\d*$', ''), '^www\.', '')"


def valid(x: str) -> str:
    return f"(regexp_matches(trim(coalesce({x}, '')), {q(PARTS)}) AND {host(x)} <> '')"


def path(x: str) -> str:
    return f"(CASE WHEN regexp_replace({part(x, 3)}, '/+$', '') = '' THEN '/' ELSE regexp_replace({part(x, 3)}, '/+$', '') END)"


def query(x: str) -> str:
    tracked = "(?i)^(" + "|".join(rules.TRACKING_PARAMETERS) + ")$"
    kept = rf"list_filter(string_split(regexp_replace({part(x, 4)}, '^\?', ''), '&'), lambda p: p <> '' AND NOT regexp_matches(string_split(p, '=')[1], {q(tracked)}))"
    return f"(CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def base(x: str) -> str:
    port = rf"regexp_extract({part(x, 2)}, '(:\d+)$', 1)"
    return f"(lower({part(x, 1)}) || '://' || {host(x)} || CASE WHEN lower({part(x, 1)}) || {port} IN ('http:80', 'https:443') THEN '' ELSE {port} END)"


def normalized(x: str) -> str:
    return f"(CASE WHEN {valid(x)} THEN {base(x)} || {path(x)} || {query(x)} END)"


def registrable(h: str) -> str:
    two = f"array_to_string(string_split({h}, '.')[-2:], '.')"
    suffix = q(rf"^({'|'.join(rules.SECOND_LEVELS)})\.[a-z][a-z]$")
    return rf"(CASE WHEN regexp_matches({h}, '^\d+(\.\d+){{3}}$') THEN {h} WHEN regexp_matches({two}, {suffix}) THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE {two} END)"


def has(x: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches(coalesce({x}, ''), {q(('(?i)' if ignore_case else '') + pattern)})"


def any_of(x: str, patterns: list[str]) -> str:
    return has(x, "|".join(f"(?:{p})" for p in patterns))


def blocked(h: str) -> str:
    names = "|".join(re.escape(d).replace(r"\-", "-") for d in rules.BLOCKED_DOMAINS) + "|" + "|".join(re.escape(s[1:]) for s in rules.BLOCKED_SUFFIXES)
    return f"regexp_matches({h}, {q(rf'(^|\.)({names})$')})"


def role(x: str) -> str:
    t = f"lower(trim(coalesce({x}, '')))"
    return f"(CASE WHEN {t} = '' THEN NULL " + " ".join(f"WHEN regexp_matches({t}, {q(p)}) THEN {q(c)}" for c, p in rules.ROLE_RULES) + " ELSE 'other' END)"


def role_mailbox(x: str) -> str:
    return f"(contains({x}, '@') AND regexp_matches(regexp_replace(split_part(lower(trim({x})), '@', 1), '[._+-]', '', 'g'), {q(f'^({rules.ROLE_MAILBOX})')}))"


def scanned(x: str, words: list[str]) -> str:
    return "list_filter([" + ", ".join(q(w) for w in words) + f"], lambda k: contains(lower(coalesce({x}, '')), k))"


def page_kind(url: str, text: str) -> str:
    rows = []
    for i, (kind, urls, texts) in enumerate(rules.PAGE_RULES):
        score = " + ".join([f"(CASE WHEN {has(f'lower({url})', p)} THEN 2 ELSE 0 END)" for p in urls] + [f"(CASE WHEN {has(f'lower({text})', p)} THEN 1 ELSE 0 END)" for p in texts])
        rows.append(f"{{'s': {score}, 'o': {-i}, 'k': {q(kind)}}}")
    best = f"list_sort([{', '.join(rows)}], 'DESC')[1]"
    return f"(CASE WHEN ({best}).s > 0 THEN ({best}).k ELSE 'homepage' END)"


def archetype(p: str, anchor: str, title: str) -> str:
    """List of matching archetypes, best first, as structs."""
    rows = []
    for i, (kind, words) in enumerate(rules.ARCHETYPE_KEYWORDS.items()):
        hit = lambda x, w: has(x, rf"\b{re.escape(w).replace(chr(92) + '-', '-')}\b")
        total = lambda x: " + ".join(f"CAST({hit(x, w)} AS INTEGER)" for w in words)  # noqa: E731, B023
        longest = "greatest(" + ", ".join(f"CASE WHEN {hit(p, w)} OR {hit(anchor, w)} OR {hit(title, w)} THEN {len(w)} ELSE 0 END" for w in words) + ", 0)"
        rows.append(f"{{'pr': {rules.PRECEDENCE[kind]}, 'n': {longest}, 'u': {total(p)}, 'a': {total(anchor)}, 'o': {-i}, 't': {total(title)}, 'k': {q(kind)}}}")
    return f"list_sort(list_filter([{', '.join(rows)}], lambda r: r.n > 0), 'DESC')"


def legal_key(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace(coalesce({x}, ''), {q('(?i)' + rules.LEGAL_SUFFIX)}, '', 'g')), '[^a-z0-9]', '', 'g')"


def slug(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\s-]', ' ', 'g'), '[\s-]+'), lambda t: length(t) >= 3)"


def name_key(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
