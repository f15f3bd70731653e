"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. If two fingerprints differ in at most four bits, one
segment differs in at most one, so both share that segment with one bit position masked out. Every
distinct fingerprint is indexed under its 64 (position, masked segment) keys; equal keys meet in one
sorted run, and every distance is verified. A run yields the links of a spanning forest, not all
pairs. Components over distinct fingerprints give each document the smallest doc_id it can reach.

Defined cases: a null or blank text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle of all words; repeated rows and equal texts share a fingerprint and link;
rows with a null id take part, but a component of null ids only has a null component_id; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents, stash
from orecart.llm.components import components

WORDS, DISTANCE, SEED = 4, 4, 42
#: First bits of the segments and the end.
SEGMENTS = (0, 22, 43, 64)


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    from xxhash import xxh64_intdigest

    parts = raw.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.array([len(x) for x in parts]) + 1) - 1
    if len(parts) <= words:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        stops = ends[words - 1 :].tolist()
        starts = [0, *(ends[: len(parts) - words] + 1).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    for lo in range(0, n, 1 << 14):
        part = np.array(hashes[lo : lo + (1 << 14)], dtype="<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, th, fp): a digest of the text tells rows of one id apart; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t or "").encode(), words) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, fp long")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph 'distance bits or fewer differ', by breadth-first search."""
    left, right, rest = [], [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, fps.dtype)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Spanning links (a, b) between distinct fp values; three segments fit at most five bits."""
    if distance > 2 * (len(SEGMENTS) - 1) - 1:
        raise ValueError("these segments find distances of at most five bits")
    low, size = F.lit(None), F.lit(None)
    for first, stop in pairwise(SEGMENTS):
        inside = (F.col("bit") >= first) & (F.col("bit") < stop)
        low, size = F.when(inside, F.lit(first)).otherwise(low), F.when(inside, F.lit((1 << (stop - first)) - 1)).otherwise(size)
    part = F.expr("shiftrightunsigned(fp, low)").bitwiseAND(F.col("size"))
    mask = F.bitwise_not(F.expr("shiftleft(1L, bit - low)"))
    keyed = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).withColumns({"low": low.cast("int"), "size": size.cast("long")})
    keyed = keyed.select(F.expr("shiftleft(cast(bit AS long), 24)").bitwiseOR(part.bitwiseAND(mask)).alias("key"), "fp")
    ordered = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
            n = np.diff(cut)
            two = cut[:-1][n == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= distance] if len(two) else two
            left, right = [fps[near]], [fps[near + 1]]
            for lo, k in zip(cut[:-1][n > 2], n[n > 2], strict=True):
                a, b = forest(fps[lo : lo + k], distance)
                left.append(a)
                right.append(b)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (left, right)], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_key, batch.column(0).to_numpy()))
            fps = np.concatenate((held_fp, batch.column(1).to_numpy().view(np.uint64)))
            if not len(keys):
                continue
            tail = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if tail:
                yield out(keys[:tail], fps[:tail])
            held_key, held_fp = keys[tail:], fps[tail:]
        if len(held_key):
            yield out(held_key, held_fp)

    return arrow_map(ordered, run, "a long, b long", 65536)


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, th, fp, root (the component's least label), component_id for every row.

    A fingerprint's label is its least doc_id, so that a component's least label is its id and no
    table is grouped or joined by component; fingerprints without any id have labels above all ids.
    """
    rows = stash(fingerprints(docs, words))
    nodes = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).select("fp", label_of(F.col("first_id"), F.col("fp")).alias("label")))
    edges = links(nodes.select("fp"), distance).where("a <> b").distinct()
    for end in "ab":
        edges = edges.join(nodes.withColumnRenamed("fp", end), end).drop(end).withColumnRenamed("label", f"{end}{end}")
    roots = components(stash(edges.select(F.col("aa").alias("a"), F.col("bb").alias("b"))))
    named = nodes.join(roots, nodes["label"] == roots["node"], "left").select("fp", F.coalesce("root", "label").alias("root"))
    return rows.join(named, "fp").select("doc_id", "th", "fp", "root", id_of(F.col("root")).alias("component_id"))


def label_of(first_id: Column, key: Column) -> Column:
    """A number that is first_id, or where that is null one above all ids that depends on key (a long)."""
    return F.coalesce(first_id.cast("decimal(20,0)"), (key.cast("decimal(20,0)") + F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)"))


def id_of(label: Column) -> Column:
    return F.when(label < F.lit(str(2**63)).cast("decimal(20,0)"), label.cast("long"))


def first_rows(docs: DataFrame, found: DataFrame, one_nameless: bool = False) -> DataFrame:
    """One document of each component of found (doc_id, th, root, component_id): the row with the smallest doc_id; of rows that repeat that id one stays. Rows without an id go only if their component has one with an id; with one_nameless, a component without any id keeps only one row, of the smallest text digest."""
    first = found.where("doc_id = component_id").groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("k"), F.count("*").alias("rows")).select("k.*", "rows")
    alone = found.where("component_id IS NULL")
    if one_nameless:
        alone = alone.groupBy("root").agg(F.lit(None).cast("long").alias("doc_id"), F.min("th").alias("th"), F.count("*").alias("rows")).drop("root")
    else:
        alone = alone.groupBy("doc_id", "th").agg(F.lit(0).cast("long").alias("rows"))
    kept = stash(first.union(alone))
    wanted = kept.select(F.col("doc_id").alias("__kept"), F.col("th").alias("__th")).hint("shuffle_hash")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__kept")) & (F.xxhash64(docs["text"]) == F.col("__th"))
    out = docs.join(wanted, same).drop("__kept")
    if not kept.where("rows > 1").limit(1).count():
        return out.drop("__th")
    if one_nameless:
        return out.dropDuplicates(["doc_id", "__th"]).drop("__th")
    named = out.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "__th"])
    return named.unionByName(out.where(F.col("doc_id").isNull())).drop("__th")


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One document of each component."""
    return first_rows(docs, near_duplicates(docs, words, distance))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
