"""Links of pages: archetypes, scores, selection, page kinds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.functions import url as U
from orecart.functions.text import ascii_bounds, let, matches, squeeze

ANCHOR = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'


def title_of(html: Column) -> Column:
    return squeeze(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<title[^>]*>(.*?)</title>", 1))


def first_heading(html: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))


def classify_page(url: Column, text: Column) -> Column:
    """The page rule with the highest score: 2 per url pattern, 1 per text pattern; the earlier rule wins ties; homepage if none."""

    def best(v: Column) -> Column:
        scored = []
        for i, (kind, urls, texts) in enumerate(rules.PAGE_RULES):
            score = F.lit(0)
            for p in urls:
                score = score + F.when(matches(v["url"], p), 2).otherwise(0)
            for p in texts:
                score = score + F.when(matches(v["text"], p), 1).otherwise(0)
            scored.append(F.struct(score.alias("score"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")))
        return let(F.array_max(F.array(*scored)), lambda x: F.when(x["score"] > 0, x["kind"]).otherwise("homepage"))

    # Named by every rule: without let, a filter searches the whole page for its title and heading once a rule.
    return let(F.struct(F.lower(F.coalesce(url, F.lit(""))).alias("url"), F.lower(F.coalesce(text, F.lit(""))).alias("text")), best)


def record_type(kind: Column) -> Column:
    return F.when(kind.isin(rules.CONTACT_ARCHETYPES), "contact").otherwise("company")


def is_contact_source(kind: Column) -> Column:
    return kind.isin(rules.CONTACT_SOURCES)


def tier(archetype: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, members in rules.TIERS.items():
        out = out.when(archetype.isin(members), name)
    return out.otherwise("generic")


def tier_priority(tier_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in rules.TIER_RANK.items() for x in kv]), tier_)


#: Every keyword: its archetype's precedence and place, its own place and length.
_KEYWORD = "precedence int, kind int, place int, n int, word string, pattern string"


def _keywords() -> Column:
    rows = []
    for i, (kind, words) in enumerate(rules.ARCHETYPE_KEYWORDS.items()):
        for j, word in enumerate(words):
            values = (rules.PRECEDENCE[kind], -i, -j, len(word), word, ascii_bounds(rf"\b{re.escape(word)}\b"))
            rows.append(F.struct(*[F.lit(v).alias(c.split()[0]) for v, c in zip(values, _KEYWORD.split(", "), strict=True)]))
    return F.array(*rows)


def infer_archetype(url: Column, anchor: Column, title: Column) -> Column:
    """struct(archetype, tier, url_hits, anchor_hits, title_hits, keyword): the match of highest precedence, then longest keyword, then most hits.

    A plain substring test over the keyword table leaves few words for the patterns.
    """
    texts = F.struct(F.lower(U._part(url, 3)).alias("url"), F.lower(F.coalesce(anchor, F.lit(""))).alias("anchor"), F.lower(F.coalesce(title, F.lit(""))).alias("title"))
    return let(texts, _infer)


def _infer(texts: Column) -> Column:
    where = ("url", "anchor", "title")
    near = F.filter(_keywords(), lambda k: texts["url"].contains(k["word"]) | texts["anchor"].contains(k["word"]) | texts["title"].contains(k["word"]))
    tested = F.transform(near, lambda k: F.struct(k.alias("k"), *[F.regexp_like(texts[c], k["pattern"]).cast("int").alias(c) for c in where]))
    hits = F.filter(tested, lambda h: h["url"] + h["anchor"] + h["title"] > 0)
    total = lambda own, c: F.aggregate(own, F.lit(0), lambda a, h: a + h[c])
    names = F.array(*[F.lit(kind) for kind in rules.ARCHETYPE_KEYWORDS])

    def summed(hits: Column, kind: Column) -> Column:
        own = F.filter(hits, lambda h: h["k"]["kind"] == kind)
        word = F.array_max(F.transform(own, lambda h: F.struct(h["k"]["n"].alias("n"), h["k"]["place"].alias("place"), h["k"]["word"].alias("word"))))
        return F.struct(own[0]["k"]["precedence"].alias("precedence"), word["n"].alias("n"), total(own, "url").alias("url_hits"), total(own, "anchor").alias("anchor_hits"), kind.alias("kind"), total(own, "title").alias("title_hits"), word["word"].alias("keyword"))

    best = let(hits, lambda found: F.array_max(F.transform(F.array_distinct(F.transform(found, lambda h: h["k"]["kind"])), lambda kind: summed(found, kind))))

    def close(b: Column) -> Column:
        kind = F.when(b.isNull(), F.lit("generic")).otherwise(F.element_at(names, F.lit(1) - b["kind"]))
        zero = lambda c: F.coalesce(c, F.lit(0))
        return F.struct(kind.alias("archetype"), tier(kind).alias("tier"), zero(b["url_hits"]).alias("url_hits"), zero(b["anchor_hits"]).alias("anchor_hits"), zero(b["title_hits"]).alias("title_hits"), F.coalesce(b["keyword"], F.lit("")).alias("keyword"))

    return let(best, close)


def reason(found: Column) -> Column:
    parts = F.array_compact(F.array(F.when(found["url_hits"] > 0, "url"), F.when(found["anchor_hits"] > 0, "anchor"), F.when(found["title_hits"] > 0, "title")))
    return F.when(found["archetype"] == "generic", "no semantic keyword matched").otherwise(F.concat(found["archetype"], F.lit(": keyword '"), found["keyword"], F.lit("' matched in "), F.array_join(parts, "+")))


def score(found: Column, depth: Column, segments: Column) -> Column:
    tiers = F.create_map(*[F.lit(x) for kv in rules.TIER_SCORE.items() for x in kv])
    hits = found["url_hits"] * rules.HIT_BONUS["url"] + found["anchor_hits"] * rules.HIT_BONUS["anchor"] + found["title_hits"] * rules.HIT_BONUS["title"]
    return F.element_at(tiers, found["tier"]) + hits - depth * rules.DEPTH_PENALTY - F.greatest(F.lit(0), segments - 2) * rules.SEGMENT_PENALTY


def anchors(pages: DataFrame) -> DataFrame:
    """One row per link with an href, in document order: page columns but html, seq, href, anchor_text."""
    rest = [c for c in pages.columns if c != "html"]
    out = pages.select(*rest, F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("seq", "a"))
    return out.select(*rest, "seq", F.regexp_extract("a", ANCHOR, 1).alias("href"), squeeze(F.regexp_replace(F.regexp_extract("a", ANCHOR, 2), "<[^>]*>", "")).alias("anchor_text"))


def page_links(links: DataFrame, limit: int = rules.LINKS_PER_PAGE) -> DataFrame:
    """Best links of each page. links: page_id, page_url, title, depth, seq, href, anchor_text.

    Same registrable domain only, dropped URLs removed, one row per URL (one with anchor text before
    one without, then the first), scored, at most `limit` by score and document order.
    """
    full = links.withColumn("target", U.resolve(F.col("href"), F.col("page_url"))).where(F.col("target").isNotNull())
    full = full.withColumn("norm", U.normalize(F.col("target"))).where(F.col("norm").isNotNull() & ~U.is_dropped(F.col("norm.normalized_url")))
    full = full.where(F.col("norm.domain") == U.registrable(U.hostname(F.col("page_url"))))
    one = Window.partitionBy("page_id", "norm.normalized_url").orderBy((F.col("anchor_text") != "").desc(), "seq")
    full = full.withColumn("rn", F.row_number().over(one)).where("rn = 1").withColumn("found", infer_archetype(F.col("norm.normalized_url"), F.col("anchor_text"), F.col("title")))
    full = full.withColumn("score", score(F.col("found"), F.col("depth"), U.path_segments(F.col("norm.normalized_url"))))
    best = Window.partitionBy("page_id").orderBy(F.desc("score"), "seq")
    out = full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return out.select("page_id", "rank", F.col("norm.normalized_url").alias("url"), "anchor_text", F.col("found.archetype").alias("archetype"), F.col("found.tier").alias("tier"), tier_priority(F.col("found.tier")).alias("priority"), "score", reason(F.col("found")).alias("reason"), (F.col("depth") + 1).alias("depth"))


def next_fetches(candidates: DataFrame, limit: int = rules.NEXT_FETCHES) -> DataFrame:
    """The best of links and sitemap entries of each seed page."""
    w = Window.partitionBy("page_id").orderBy(F.desc("score"), "url")
    return candidates.withColumn("fetch_rank", F.row_number().over(w)).where(F.col("fetch_rank") <= limit)


def harvest(links: DataFrame, limit: int = rules.HARVEST_DOMAINS) -> DataFrame:
    """External domains that directory pages link to, per source in first-seen order; the title is that of the first link that has one."""
    full = links.withColumn("norm", U.normalize(U.resolve(F.col("href"), F.col("page_url")))).where("norm IS NOT NULL")
    excluded = "|".join(d.replace(".", r"\.") for d in rules.HARVEST_EXCLUDED)
    external = (F.col("norm.hostname") != U.hostname(F.col("page_url"))) & ~F.col("norm.domain").rlike(rf"(^|\.)({excluded})$") & U.is_public_host(F.col("norm.hostname"))
    full = full.where(external & ~matches(F.col("norm.normalized_url"), rules.HARVEST_SKIPPED))
    place = F.struct("page_id", "seq")
    per = full.groupBy("source_id", F.col("norm.domain").alias("domain")).agg(F.min(place).alias("at"), F.min_by(F.col("norm.base_url"), place).alias("url"), F.coalesce(F.min_by("anchor_text", F.when(F.col("anchor_text") != "", place)), F.lit("")).alias("title"))
    w = Window.partitionBy("source_id").orderBy("at")
    return per.withColumn("seen", F.row_number().over(w)).where(F.col("seen") <= limit).select("source_id", "domain", "url", "title", "seen")


def directory_pages(links: DataFrame, limit: int = rules.HARVEST_PAGES) -> DataFrame:
    """Further pages of a directory to read: links of its first page to the same host whose path or query hints at a listing, first ones per source."""
    full = links.withColumn("target", U.resolve(F.col("href"), F.col("page_url"))).withColumn("url", U.normalized(F.col("target"))).where("url IS NOT NULL")
    full = full.where((U.hostname(F.col("target")) == U.hostname(F.col("page_url"))) & U.is_public_host(U.hostname(F.col("target"))))
    full = full.where(matches(F.concat(U._part(F.col("target"), 3), U._part(F.col("target"), 4)), rules.HARVEST_INTERNAL) & ~matches(U._part(F.col("target"), 3), rules.HARVEST_SKIPPED))
    w = Window.partitionBy("source_id").orderBy("page_id", "seq")
    return full.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).select("source_id", "url", "nth")


def frontier(edges: DataFrame, seeds: DataFrame, max_depth: int = 1) -> DataFrame:
    """(url, depth) reachable from seeds within max_depth steps, each at its least depth; a depth-bounded loop of joins."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    newest = seen
    for d in range(1, max_depth + 1):
        step = newest.join(edges, newest["url"] == edges["src"]).select(F.col("dst").alias("url")).distinct()
        newest = step.join(seen, "url", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(newest)
    return seen
