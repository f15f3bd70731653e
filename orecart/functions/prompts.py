"""Prompts for a text provider, by what a page is; and the evidence text they quote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orecart import rules
from orecart.operators.links import title_of
from orecart.operators.serve import evidence_score

#: This engine's own wording.
PROMPTS = {
    "company": "Read the evidence below and describe the company it belongs to. Use nothing that the evidence does not say; leave unknown fields empty. Name the evidence numbers for every technology.",
    "contact": "List the people named on the page below with title, mail and phone as printed. Leave out role mailboxes and names that are labels.",
}


def prompt_key(archetype: Column) -> Column:
    """contact for pages that name people, company for all others."""
    return F.when(archetype.isin(rules.CONTACT_ARCHETYPES), "contact").otherwise("company")


def prompt(archetype: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROMPTS.items() for x in kv]), prompt_key(archetype))


def evidence(pages: DataFrame, terms: Sequence[str], top: int = 5, most: int | None = 8000) -> DataFrame:
    """Per domain the text of its best pages in order: number, URL, title and the first `most` characters of each (None: all). pages: domain, page_id, url, html, text."""
    title = title_of(F.col("html"))
    text = F.coalesce("text", F.lit(""))
    text = text if most is None else F.substring(text, 1, most)
    rows = pages.withColumn("title", title).withColumn("score", evidence_score(F.col("title"), F.lit(""), F.col("url"), F.col("text"), terms))
    w = Window.partitionBy("domain").orderBy(F.desc("score"), "page_id")
    best = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top)
    part = F.concat(F.lit("[EVIDENCE "), "n", F.lit("]\nURL: "), "url", F.lit("\nTITLE: "), "title", F.lit("\n\n"), text)
    parts = best.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("n", part.alias("t")))).alias("p"), F.array_sort(F.collect_list(F.struct("n", "page_id"))).alias("i"))
    return parts.select("domain", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n---\n\n").alias("evidence"), F.transform("i", lambda x: x["page_id"]).alias("page_ids"))
