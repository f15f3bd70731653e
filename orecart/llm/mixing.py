"""Mixing sources to target weights by iterative proportional fitting, DataFrame functions only.

One scan of the texts leaves a narrow table: id, source, language, topic, token count. Token sums per
(source, lang, topic) cell are raked: round by round, and in each round dimension by dimension, cell
weights are scaled so that the dimension's marginal meets its target. Default targets flatten the
observed shares (share to a power below one, made to sum to one); given targets replace them. A
document's inclusion probability is its cell's raked-to-observed ratio times a constant that makes
the expected kept tokens the asked share of all tokens, cut at one; the constant is found by a fixed
number of fixed-point steps. A document is sampled if a uniform number from a digest of its id is below.

Defined cases: null or blank texts have 0 tokens; a cell without tokens gets ratio 1; a null source or
language is the empty string; a null id hashes as an empty string; rows that repeat an id share its
fate; categories missing from a given target get target zero; an empty table gives an empty result.
The cell table holds one row per (source, lang, topic) that occurs, never one per document.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orecart.llm.common import documents, stash

DIMENSIONS = ("source", "lang", "topic")
#: Exponents of the default targets.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
ROUNDS, SCALE_STEPS, KEEP_SHARE = 6, 6, 0.7
# Topics by the first pattern found in the text.
TOPICS = (("legal", r"[Ll]icen[sc]e|[Cc]opyright"), ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]"), ("web", r"https?://"))


def topic_of(text: Column) -> Column:
    out = F.lit("general")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(doc_id: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, tokens: all that mixing needs of a document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic_of(text).alias("topic"), F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")).cast("double").alias("tokens"))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """cells with column weight: token sums raked to the marginals; the total stays."""
    out = cells
    for d in DIMENSIONS:
        if targets and d in targets:
            goal = F.lit(0.0)
            for value, share in targets[d].items():
                goal = F.when(F.col(d) == value, F.lit(float(share))).otherwise(goal)
            shares = cells.groupBy(d).agg(F.sum("t").alias("have")).withColumn(f"raw_{d}", goal)
        else:
            shares = cells.groupBy(d).agg(F.sum("t").alias("have")).withColumn(f"raw_{d}", F.pow("have", F.lit(FLATTEN[d])))
        total = shares.agg(F.sum(f"raw_{d}"), F.sum("have")).first()
        scale = (total[1] or 0.0) / total[0] if total[0] else 0.0
        out = out.join(shares.select(d, (F.col(f"raw_{d}") * F.lit(scale)).alias(f"goal_{d}")), d)
    out = out.withColumn("weight", F.col("t"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            have = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"goal_{d}") / have).otherwise(F.lit(0.0)))
    return out.select(*DIMENSIONS, "t", "weight")


def probabilities(rows: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep_share: float = KEEP_SHARE, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, weight, probability) per cell for described rows."""
    cells = stash(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("t")))
    raked = stash(rake(cells, targets, rounds)).withColumn("ratio", F.when(F.col("t") > 0, F.col("weight") / F.col("t")).otherwise(F.lit(1.0)))
    budget, full = (x or 0.0 for x in raked.agg(F.sum(F.col("t") * keep_share), F.sum(F.col("ratio") * F.col("t"))).first())
    scale = budget / full if full else 1.0
    for _ in range(SCALE_STEPS):
        reached = raked.agg(F.sum(F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)) * F.col("t"))).first()[0]
        scale = scale * budget / reached if reached else scale
    return raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)).alias("probability"))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep_share: float = KEEP_SHARE, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability, sampled for every row."""
    rows = stash(describe(docs))
    out = rows.join(probabilities(rows, targets, keep_share, rounds), list(DIMENSIONS))
    return out.select("doc_id", *DIMENSIONS, F.col("tokens").cast("long").alias("n_tokens"), "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, keep_share: float = KEEP_SHARE, seed: int = 0) -> DataFrame:
    """The sampled rows of docs, all columns. Texts are not shuffled: the cell is worked out again beside the small cell table."""
    cells = stash(probabilities(describe(docs), targets, keep_share))
    hidden = {f"__{d}": c for d, c in (("source", F.coalesce("source", F.lit(""))), ("lang", F.coalesce("lang", F.lit(""))), ("topic", topic_of(F.coalesce("text", F.lit("")))))}
    renamed = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("probability").alias("__p"))
    return docs.withColumns(hidden).join(renamed, [f"__{d}" for d in DIMENSIONS]).where(uniform(F.col("doc_id"), seed) < F.col("__p")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).withColumn("probability", F.round("probability", 9))


def _oracle() -> str:
    """The same raking as a chain of common table expressions."""
    case = " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [
        "d0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x FROM documents)",
        rf"d AS (SELECT doc_id, source, lang, CASE {case} ELSE 'general' END AS topic, len(regexp_extract_all(x, '[^ \t\n\r\f\x0B]+'))::DOUBLE AS tokens FROM d0)",
        "cells AS (SELECT source, lang, topic, sum(tokens) AS t FROM d GROUP BY ALL)",
    ]
    for k in DIMENSIONS:
        parts.append(f"g_{k} AS (SELECT {k}, pow(h, {FLATTEN[k]}) * sum(h) OVER () / sum(pow(h, {FLATTEN[k]})) OVER () AS goal_{k} FROM (SELECT {k}, sum(t) AS h FROM cells GROUP BY {k}))")
    parts.append("r0 AS (SELECT *, t AS weight FROM cells JOIN g_source USING (source) JOIN g_lang USING (lang) JOIN g_topic USING (topic))")
    n = 0
    for _ in range(ROUNDS):
        for k in DIMENSIONS:
            parts.append(f"r{n + 1} AS (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {k}) > 0 THEN weight * goal_{k} / sum(weight) OVER (PARTITION BY {k}) ELSE 0 END AS weight) FROM r{n})")
            n += 1
    parts.append(f"q AS (SELECT *, CASE WHEN t > 0 THEN weight / t ELSE 1 END AS ratio FROM r{n})")
    parts.append(f"s0 AS (SELECT sum(t * {KEEP_SHARE}) / sum(ratio * t) AS c FROM q)")
    for i in range(SCALE_STEPS):
        parts.append(f"s{i + 1} AS (SELECT (SELECT c FROM s{i}) * sum(t * {KEEP_SHARE}) / sum(least(1, ratio * (SELECT c FROM s{i})) * t) AS c FROM q)")
    parts.append(f"p AS (SELECT source, lang, topic, least(1, ratio * (SELECT c FROM s{SCALE_STEPS})) AS probability FROM q)")
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens::BIGINT AS n_tokens, round(probability, 9) AS probability, ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < probability AS sampled FROM d JOIN p USING (source, lang, topic)"


ORACLE_SQL = _oracle()
