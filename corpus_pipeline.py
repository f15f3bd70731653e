"""Corpus pipeline: language ID, line dedup, near-dedup, mixing, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in shared storage and reads it back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm import bpe, langid, linededup, mixing, neardup
from orecart.llm.common import documents, shared_dir, stash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter in their text go; lang becomes the predicted language."""
    found = langid.identify(docs.select(*COLUMNS)).where(F.col("lang_pred") != "und")
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go; a document that loses all its words goes with them."""
    out = linededup.deduplicate(docs.select(*COLUMNS)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more link.

    The SimHash operator's deletion-variant signatures give the first links, which are verified; an
    exact set-similarity join gives those of that similarity which no SimHash distance can reach.
    """
    return neardup.keep_first(docs.select(*COLUMNS), words=5, threshold=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that rake tokens to the target marginals."""
    return mixing.sample(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their digests, and the digest of what they decode to."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("byte-level BPE", encode)]

#: Language ID and near-dedup have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), shared_dir(spark))
    return docs
