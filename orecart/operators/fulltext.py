"""Full-text search over a positional, weighted inverted index.

A posting is a term, a record's key and places: where the term stands in the record, each place a number
of 16 bits that holds the position and the class of its field. Fields follow one another, so a later field's positions go on behind the earlier ones. The
index lies in folders by the term's hash, sorted by term within a file, and a search reads the folders
of its terms alone. A record matches if it holds all terms. Its rank is, for one term, the sum of its
weights over the squares of their numbers, the largest counted first; for more terms, one minus the
product, over every two terms and every two of their places, of 1 - sqrt(w1 w2 / distance), with the
distance damped exponentially. Words are runs of letters and digits in lower case; there are no stop words.

Defined cases: null fields are empty; a term that no record holds gives no row; no terms give none;
words from position 16,383 on share that position, and a term keeps its first 256 places in a record,
as the ranking that this one equals does: both bear on the rank only, all words are searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Weights of the field classes, the last position, places kept of a term.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
LAST, MOST = 16_383, 256
#: Sum of 1 / n**2, to which a single term's rank is related.
SQUARES = 1.64493406685
FAR, FAR_SHARE, NONE = 100, 1e-30, 1e-20
#: Records whose postings of one term share a row.
AT_ONCE = 2048
POSTING = "term string, first long, steps binary, wide boolean, sizes binary, places binary"
PLACES = "term string, key long, places array<int>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(rows: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """Postings of all rows. fields: column -> weight class, in their order; keys must differ, rows of a null key are left out.

    A row's words are grouped where the row is read, so nothing is shuffled; the postings of a term in up to AT_ONCE rows lie together,
    as steps from key to key, numbers of places, and places of 16 bits.
    """
    kinds = [list(WEIGHTS).index(letter) for letter in fields.values()]
    own = rows.select(F.col(key).cast("long").alias("key"), *[words(F.col(c)).alias(f"words_{i}") for i, c in enumerate(fields)]).where("key IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                yield _grouped(batch.slice(at, AT_ONCE), kinds)

    return own.mapInArrow(run, POSTING)


def _grouped(batch: pa.RecordBatch, kinds: Sequence[int]) -> pa.RecordBatch:
    """Postings of some records: four times a word's position, plus the number of its class, in lists by term and record."""
    before, terms, row, place = np.zeros(len(batch), np.int64), [], [], []
    for i, kind in enumerate(kinds):
        own = batch.column(i + 1)
        sizes = np.diff(own.offsets.to_numpy())
        at = np.repeat(np.arange(len(batch)), sizes)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        terms.append(own.flatten())
        row.append(at)
        place.append(np.minimum(nth + np.minimum(before, LAST)[at], LAST) * 4 + kind)
        before += sizes
    coded = pa.concat_arrays(terms).dictionary_encode()
    code, key, place = coded.indices.to_numpy(), batch.column(0).to_numpy()[np.concatenate(row)], np.concatenate(place)
    order = np.lexsort((place, key, code))
    code, key, place = code[order], key[order], place[order]
    new = np.concatenate((np.ones(min(1, len(key)), bool), (key[1:] != key[:-1]) | (code[1:] != code[:-1])))
    # Of words that share the last position the heaviest counts.
    kept = new | np.concatenate((np.ones(min(1, len(key)), bool), place[1:] >> 2 != place[:-1] >> 2))
    code, key, place, new = code[kept], key[kept], place[kept], new[kept]
    start = np.flatnonzero(new)
    sizes = np.diff(np.append(start, len(new)))
    first = np.arange(len(new)) - np.repeat(start, sizes) < MOST
    sizes = np.minimum(sizes, MOST)
    code, key = code[start], key[start]
    terms, at, counts = np.unique(code, return_index=True, return_counts=True)
    steps = np.diff(key, prepend=0)
    steps[at] = 0
    wide = bool(((steps < 0) | (steps >= 1 << 16)).any())  # a step over half the numbers' range wraps, and wraps back
    ends = np.cumsum(np.append(0, sizes))[np.append(at, len(key))]
    columns = [coded.dictionary.take(pa.array(terms)), pa.array(key[at]), _bytes(steps.astype("<i8" if wide else "<u2"), np.append(at, len(key))), pa.array(np.full(len(at), wide)), _bytes((sizes - 1).astype(np.uint8), np.append(at, len(key))), _bytes(place[first].astype("<u2"), ends)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in POSTING.split(", ")])


def _bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the numbers from each of ends to the next."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, key, places of stored postings."""
    for batch in batches:
        for term, first, steps, wide, sizes, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            keys = first + np.cumsum(np.frombuffer(steps, "<i8" if wide else "<u2").astype(np.int64))
            ends = np.append(0, np.cumsum(np.frombuffer(sizes, np.uint8).astype(np.int32) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(places, "<u2").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([term] * len(keys), pa.string()), pa.array(keys), lists], ["term", "key", "places"])


def folder(term: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders)).cast("int")


class Index:
    """An index at a path. folders: number of term folders; splits: files that a folder's postings are dealt over, as a common term has one for every record."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 64, splits: int = 4) -> None:
        self.spark, self.path, self.folders, self.splits = spark, path, folders, splits

    def add(self, found: DataFrame) -> Index:
        """Append postings of records that the index does not hold yet."""
        placed = found.withColumn("folder", folder(F.col("term"), self.folders)).repartition("folder", F.pmod(F.xxhash64("first"), F.lit(self.splits)))
        placed.sortWithinPartitions("folder", "term").write.mode("append").partitionBy("folder").parquet(self.path)
        return self

    def stored(self, terms: Sequence[str]) -> DataFrame:
        """The terms' rows as they are stored; other terms' folders are not read."""
        rows = self.spark.read.schema(f"{POSTING}, folder int").parquet(self.path)
        return rows.where(F.col("folder").isin([folder(F.lit(t), self.folders) for t in terms]) & F.col("term").isin(list(terms))).drop("folder")

    def postings(self, terms: Sequence[str]) -> DataFrame:
        """term, key, places of the terms."""
        return self.stored(terms).mapInArrow(_opened, PLACES)

    def ranked(self, terms: Sequence[str]) -> DataFrame:
        """key, rank of the records that hold all terms. The rarest term's records come first, so that a common term's need no shuffle where few remain."""
        terms = list(dict.fromkeys(terms))
        if not terms:
            return self.spark.createDataFrame([], "key long, rank double")
        found = self.postings(terms)
        counts = {r.term: r["count"] for r in found.groupBy("term").count().collect()} if len(terms) > 1 else {}  # a row a term
        order = sorted(range(len(terms)), key=lambda i: counts.get(terms[i], 0))
        of = lambda i: found.where(F.col("term") == terms[i]).select("key", F.col("places").alias(f"p{i}"))
        joined = reduce(lambda a, b: a.join(b, "key"), [of(i) for i in order])
        return joined.select("key", rank([F.col(f"p{i}") for i in range(len(terms))]).alias("rank"))


def rank(places: Sequence[Column]) -> Column:
    """The rank of a record from its places of each term."""

    @F.pandas_udf("double")
    def of(*columns: pd.Series) -> pd.Series:
        return pd.Series([_single(*own) if len(own) == 1 else _together(own) for own in zip(*columns, strict=True)], dtype="float64")

    return of(*places)


_WEIGHT = np.array(list(WEIGHTS.values()))
#: Square root of the damping of each distance; none at distance 0, which takes no part, and the last one for all beyond.
_SHARE = np.sqrt(np.array([0.0, *(1.0 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) for d in range(1, FAR + 1)), FAR_SHARE]))


def _single(places: np.ndarray) -> float:
    """The heaviest place counts whole, the others by the squares of their numbers."""
    w = _WEIGHT[places & 3]
    at = int(w.argmax())
    return float(((w / np.arange(1, len(w) + 1) ** 2).sum() + w[at] - w[at] / (at + 1) ** 2) / SQUARES)


def _together(terms: Sequence[np.ndarray]) -> float:
    left = 1.0
    for k, x in enumerate(terms):
        for y in terms[:k]:
            share = _SHARE[np.minimum(np.abs((x >> 2)[:, None] - (y >> 2)[None, :]), FAR + 1)]
            left *= float(np.prod(1.0 - np.sqrt(_WEIGHT[x & 3])[:, None] * np.sqrt(_WEIGHT[y & 3])[None, :] * share))
    return NONE if left == 1.0 else 1.0 - left


def search(index: Index, records: DataFrame, terms: Sequence[str], key: str, group: Sequence[Column], order: Sequence[Column], limit: int = 50, digits: int = 6) -> DataFrame:
    """Records with their relevance, one of each group: the most relevant, then by order; at most limit rows, 100 at most.

    The rank is rounded, so that records equal but for the rounding of products are told apart by order.
    """
    hit = records.join(index.ranked(terms).withColumnsRenamed({"key": key, "rank": "relevance"}), key).withColumn("relevance", F.round("relevance", digits))
    w = Window.partitionBy(*group).orderBy(F.desc("relevance"), *order)
    return hit.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").orderBy(F.desc("relevance"), *order).limit(min(max(limit, 1), 100)).drop("__rn")
