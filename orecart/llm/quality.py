"""Quality selection by importance resampling.

Two generative models over hashed unigrams and bigrams of words: one of the target text (documents
labelled as good), one of all raw text. Counts cover every document; the tables have BUCKETS cells
whatever the input. A document's importance is the log-likelihood ratio of its n-grams. Gumbel noise
from a digest of its id turns the ratios into keys; the k highest keys are a sample without
replacement in proportion to the ratios. The k-th key is found by refining histograms, so no more
than a histogram of keys ever reaches the driver.

Defined cases: a null or blank text has ratio 0; a null id draws its noise as an empty string; equal
keys go to the smaller id; rows that repeat an id share key and fate as equal texts do; without any
target document all ratios are 0; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents, stash
from orecart.llm.linededup import BITMAP, bitmap, lowered, marked, planes, text_buffer, unplaned, word_hashes

BUCKETS = 1 << 15
#: Share of the rows that resampling selects.
SELECT_SHARE = 0.85
_PART = 1 << 12


def features(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first row, number of rows, and (row, bucket) of every word and word pair."""
    data, offsets = text_buffer(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        at = offsets[lo : hi + 1].astype(np.int64) - offsets[lo]
        buf = lowered(data[offsets[lo] : offsets[hi]])
        low = buf[: at[-1]]
        full = np.flatnonzero(np.diff(at))
        word = ~((low == 32) | ((low - np.uint8(9)) < 5))
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        opens[at[:-1][full]] |= word[at[:-1][full]]
        closes[:-1] &= ~word[1:]
        closes[at[1:][full] - 1] |= word[at[1:][full] - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        row = full[np.cumsum(np.bincount(np.searchsorted(a, at[:-1][full]), minlength=len(a) + 1))[: len(a)] - 1] if len(a) else np.zeros(0, np.int64)
        h = word_hashes(buf, a, b)
        with np.errstate(over="ignore"):
            pair = (h[:-1] * np.uint64(31) + h[1:]) * np.uint64(0x9E3779B97F4A7C15)
        same = row[1:] == row[:-1]
        bucket = np.concatenate((h, pair[same])) >> np.uint64(49)
        yield lo, hi - lo, np.concatenate((row, row[:-1][same])), bucket.astype(np.int64)
        lo = hi


def counts(texts: DataFrame) -> np.ndarray:
    """Numbers of all n-grams of a table of texts by bucket. Every task sends its table in a few packed slices, which are added up slice by slice."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, bucket in features(batch.column(0)):
                table += np.bincount(bucket, minlength=BUCKETS)
        if table.any():
            parts = table.reshape(-1, _PART)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([zlib.compress(planes(x), 1) for x in parts], pa.binary())], ["slice", "cells"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(unplaned(zlib.decompress(x), "<i8") for x in group["cells"])
        return pd.DataFrame({"slice": [int(group["slice"].iloc[0])], "cells": [total.tobytes()]})

    out = np.zeros(BUCKETS, np.int64)
    for at, cells in arrow_map(texts, count, "slice int, cells binary").groupBy("slice").applyInPandas(add, "slice int, cells binary").collect():
        out[at * _PART : (at + 1) * _PART] = np.frombuffer(cells, np.int64)
    return out


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """Log ratio per bucket. target: one column doc_id. All texts are counted where they lie; a bitmap of the target's ids, of fixed size, lets only texts go on that may be the target's, and a join settles which are."""
    wanted = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP))
    held = bitmap(wanted.select(bit(F.col("doc_id")).alias("v")), "v")

    @F.pandas_udf("boolean")
    def listed(bits: pd.Series) -> pd.Series:
        return pd.Series(marked(held, bits.to_numpy()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = rows.where(F.col("doc_id").isNotNull()).where(listed(bit(F.col("doc_id")))).join(wanted.hint("shuffle_hash"), "doc_id").select("text")
    table = np.stack((counts(rows.select("text")), counts(near))).astype(np.float64)
    if not table[1].any():
        return np.zeros(BUCKETS)
    table += 0.5
    return np.log(table[1] / table[1].sum()) - np.log(table[0] / table[0].sum())


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, bucket in features(batch.column(1)):
                total = np.bincount(row, weights=model[bucket], minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.bincount(row, minlength=n)), pa.array(total)], ["doc_id", "n_grams", "log_ratio"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_grams long, log_ratio double")


def gumbel(seed: int):
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.log(-F.log(u))


def threshold(keys: DataFrame, k: int, bins: int = 2048) -> tuple[float, int]:
    """(t, rest): every key above t is in, and rest of the rows whose key equals t."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    left = k
    while low < high:
        width = (high - low) / bins
        cell = F.least(F.lit(bins - 1), F.floor((F.col("key") - F.lit(low)) / F.lit(width)).cast("int")) if width > 0 else F.lit(0)
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high)).withColumn("cell", cell)
        found = sorted(inside.groupBy("cell").agg(F.count("*"), F.min("key"), F.max("key")).collect(), reverse=True)
        for _, n, a, b in found:
            if n >= left:
                if (a, b) == (low, high):  # one cell holds all that is left: the keys differ by less than a cell can tell
                    return a, left
                low, high = a, b
                break
            left -= n
    return low, left


def resample(docs: DataFrame, target: DataFrame, share: float = SELECT_SHARE, seed: int = 0) -> DataFrame:
    """doc_id, n_grams, log_ratio, quality (0 to 1, the ratio per n-gram through a logistic curve), key, selected."""
    rows = stash(score(docs, fit(docs, target)).withColumn("key", F.col("log_ratio") + gumbel(seed)))
    total = rows.count()
    k = round(total * share)
    quality = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("log_ratio") / F.greatest(F.lit(1), F.col("n_grams")) * 4))
    out = rows.withColumn("quality", quality)
    if not total or k <= 0:
        return out.withColumn("selected", F.lit(False))
    at, rest = threshold(rows, k)
    ties = rows.where(F.col("key") == at).select("doc_id").orderBy(F.col("doc_id").asc_nulls_first())
    last = ties.limit(rest).agg(F.max("doc_id")).first()[0]
    chosen = (F.col("key") > at) | ((F.col("key") == at) & (F.col("doc_id").isNull() | (F.col("doc_id") <= (F.lit(last) if last is not None else F.lit(-(2**63))))))
    return out.withColumn("selected", chosen)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return resample(documents(spark, sf_dir), labels)
