"""Near-duplicate documents: SimHash links first, then an exact set-similarity join for what they cannot reach.

A document is the set of its shingles of five words (ASCII lower case, split at ASCII white space;
fewer words than a shingle make one shingle of all words). Two documents link if their sets' Jaccard
similarity is THRESHOLD or more. Shingles are told apart by 64-bit hashes, sets by a 64-bit sum of
them. Steps:

1. One pass notes every document's set key and 64-bit SimHash fingerprint and counts shingles in
   hashed cells, whose classes give the global order of shingles: rare first.
2. The SimHash operator links fingerprints at DISTANCE bits or fewer by its deletion-variant
   signatures; links are verified by Jaccard. They join copies and slight variants in one step.
3. At a Jaccard similarity of 0.8 fingerprints differ in ten bits in the mean, too many for any
   signature that still selects. So a second pass sends the prefix of every distinct set, the
   n - ceil(t n) + 1 shingles of which a similar set must share one; sets that meet at a shingle are
   held against each other by size, position and parity bitmap (see linededup). Every set gives its
   closest TRIES candidates at a shingle; those not yet linked to it are verified.
4. Where a set has more candidates, those of other components go on, ever more at once, until none
   is left. A large group of copies is one component by then and gives no more pairs.

Defined cases: texts without words (null too) link with each other; rows with a null id take part;
a component of null ids only has a null component_id; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orecart.llm import simhash
from orecart.llm.common import arrow_map, mix64, stash
from orecart.llm.components import components
from orecart.llm.linededup import BITMAP, PART_ROWS, WIDER, Join, bitmap, _classes, _log2, marked, _packed, planes, _slices, _unpacked, candidates, distinct_rows, lowered, parity, text_buffer, word_hashes

WORDS, THRESHOLD, DISTANCE, TRIES = 5, 0.8, 4, 2
_SLICE = 1 << 18
_U = np.uint64


class Sets:
    """Shingle sets of some rows, shingles in the order of their classes: sizes, keys, parity bitmaps."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first_row: int, words: int, rank: np.ndarray | None = None) -> None:
        buf = lowered(data)
        low = buf[: len(data)]
        word = ~((low == 32) | ((low - np.uint8(9)) < 5))
        full = np.flatnonzero(np.diff(at))
        starts, stops = at[:-1][full], at[1:][full]
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        opens[starts] |= word[starts]
        closes[:-1] &= ~word[1:]
        closes[stops - 1] |= word[stops - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = full[np.cumsum(np.bincount(np.searchsorted(a, starts), minlength=len(a) + 1))[: len(a)] - 1] if len(a) else np.zeros(0, np.int64)
        hashes, n = word_hashes(buf, a, b), np.bincount(of, minlength=len(at) - 1)
        i = np.arange(len(of)) - (np.cumsum(n) - n)[of]
        head = np.flatnonzero(i <= np.maximum(0, n[of] - words))
        h = np.zeros(len(head), _U)
        with np.errstate(over="ignore"):
            for k in range(words):
                more = i[head] + k < n[of[head]]
                h[more] = mix64(h[more] * _U(0x9E3779B97F4A7C15) + hashes[head[more] + k] + _U(k + 1))
        line = of[head]
        place = np.zeros(len(h), np.uint8) if rank is None else rank[(h >> _U(64 - _log2(len(rank)))).astype(np.int64)]
        order = np.lexsort((h, place, line))
        line, h = line[order], h[order]
        new = np.append(True, (line[1:] != line[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        line, self.token = line[new], h[new]
        size = np.bincount(line, minlength=len(at) - 1).astype(np.int64)
        used = np.flatnonzero(size)
        self.n, self.row, self.number = size[used], first_row + used, np.zeros(len(used), np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.line = np.repeat(np.arange(len(used)), self.n)
        with np.errstate(over="ignore"):
            mixed = mix64(self.token + _U(1))
            self.key = (np.add.reduceat(mixed, self.first) if len(used) else np.zeros(0, _U)) ^ self.n.astype(_U)
        self.bits, self.bits2 = parity(mixed, self.first)

    def fingerprints(self) -> np.ndarray:
        """A bit is 1 if it is set in over half of the shingles' hashes."""
        out = np.zeros(len(self.n), _U)
        for lo in range(0, len(self.n), 64):
            hi = min(len(self.n), lo + 64)
            a, b = int(self.first[lo]), int(self.first[hi - 1] + self.n[hi - 1])
            ones = np.unpackbits(self.token[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            total = np.add.reduceat(ones, self.first[lo:hi] - a, axis=0, dtype=np.int32)
            out[lo:hi] = np.packbits(total * 2 > self.n[lo:hi, None], axis=1, bitorder="little").view("<u8").ravel()
        return out


def sets_of(column: pa.Array, words: int, rank: np.ndarray | None = None) -> Iterator[Sets]:
    data, offsets = text_buffer(column)
    for lo, hi in _slices(offsets, _SLICE):
        yield Sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1].astype(np.int64) - offsets[lo], lo, words, rank)


def similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _noted(source: DataFrame, words: int, bits: int) -> DataFrame:
    """(id, th, line, key, fp) of every row (key 0: no words); rows with line -1 hold counts of shingles by cell."""
    names = ["id", "th", "line", "key", "fp", "cells"]

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, np.int64)
        for batch in batches:
            key, fp, held = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), []
            for own in sets_of(batch.column(2), words):
                key[own.row], fp[own.row] = own.key.view(np.int64), own.fingerprints().view(np.int64)
                held.append((own.token >> _U(64 - bits)).astype(np.uint32))
            if held:
                cells += np.bincount(np.concatenate(held), minlength=1 << bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(key), np.int32)), pa.array(key), pa.array(fp), pa.nulls(len(key), pa.binary())], names)
        if cells.any():
            parts = cells.reshape(-1, 1 << 14)
            zero = pa.array(np.zeros(len(parts), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), zero, pa.array(np.full(len(parts), -1, np.int32)), zero, zero, pa.array([zlib.compress(planes(x), 1) for x in parts], pa.binary())], names)

    return stash(arrow_map(source, note, "id long, th long, line int, key long, fp long, cells binary"))


def _verified(source: DataFrame, pairs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Those of (a, b) whose sets are similar. A bitmap lets only wanted sets leave the scan."""
    pairs = stash(pairs.distinct())
    wanted = stash(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    places = bitmap(wanted.select(F.pmod(F.col("key"), F.lit(BITMAP)).alias("v")), "v")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for own in sets_of(batch.column(0), words):
                rows = []
                for k in np.flatnonzero(marked(places, own.key.view(np.int64) % BITMAP)).tolist():
                    if (key := int(own.key[k])) not in seen:
                        seen.add(key)
                        rows.append(k)
                if len(seen) > 100_000:  # a set that recurs is sent again once in a while
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(own.key[rows].view(np.int64)), pa.array([own.token[own.first[k] : own.first[k] + own.n[k]].tobytes() for k in rows], pa.binary())], ["key", "hashes"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            good = [similar(np.frombuffer(p.as_py(), _U), np.frombuffer(q.as_py(), _U), threshold) for p, q in zip(x, y, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    texts = stash(arrow_map(source.select("text"), fetch, "key long, hashes binary").join(wanted, "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes")))
    both = pairs.join(texts.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a").join(texts.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    return stash(arrow_map(both, check, "a long, b long", 64))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    for end in "ab":
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _by_simhash(noted: DataFrame, distance: int) -> DataFrame:
    """Candidate pairs of keys whose fingerprints link."""
    sets = noted.where("line = 0 AND key <> 0").select("fp", "key").distinct()
    heads = stash(sets.groupBy("fp").agg(F.min("key").alias("head")))
    equal = sets.join(heads, "fp").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = simhash.links(heads.select("fp"), distance).where("a <> b").distinct()
    for end in "ab":
        near = near.join(heads.withColumnsRenamed({"fp": end, "head": f"{end}{end}"}), end).drop(end)
    return equal.union(near.select(F.least("aa", "bb"), F.greatest("aa", "bb")))


_FOUND = "part int, rows binary, a long, b long, more boolean"


def _frame(size: int, **columns: object) -> pd.DataFrame:
    kinds = {"part": "Int32", "rows": object, "a": "Int64", "b": "Int64", "more": "boolean"}
    return pd.DataFrame({name: pd.Series(columns.get(name, [None] * size), dtype=kind) for name, kind in kinds.items()})


def _pairs(base: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> pd.DataFrame:
    a, b = base[3][x], base[3][y]
    return _frame(len(x), a=np.minimum(a, b), b=np.maximum(a, b)).drop_duplicates(ignore_index=True)


def links(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, distance: int = DISTANCE, tries: int = TRIES, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(id, th, key) of every row, and (node, root) for the keys in a component of more than one set."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    bits = 20 + min(4, max(0, (source.rdd.getNumPartitions() // 128).bit_length()))
    noted = _noted(source, words, bits)
    rank, total = _classes(noted, bits)
    join = Join(rank, total, threshold, 1 << 62, part_rows)
    linked = _verified(source, _by_simhash(noted, distance), words, threshold)
    roots = components(linked)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = list(join.dealt([np.concatenate(x) for x in zip(*held, strict=True)]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "rows"])

        for batch in batches:
            for own in sets_of(batch.column(0), words, rank):
                fresh = np.zeros(len(own.key), bool)
                for k, key in enumerate(own.key.tolist()):
                    if key not in seen:
                        fresh[k] = True
                        seen.add(key)
                if len(seen) > 100_000:
                    seen.clear()
                ids = np.zeros(int(own.row[-1]) + 1 if len(own.row) else 0, np.int64)
                ids[own.row] = own.key.view(np.int64)
                held.append(join.prefixes(own, ids, fresh))
                size += len(held[-1][0])
                if size > 200_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        base = distinct_rows(_unpacked(list(group["rows"])))
        x, y, _, many = candidates(base, threshold, tries)
        frames = [_pairs(base, x, y)] if len(x) else []
        if (many > tries).any():
            stays = np.isin(base[0], np.unique(base[0][many > tries]))
            frames.append(_frame(1, part=[int(group["part"].iloc[0])], rows=[_packed([c[stays] for c in base])]))
            keys = np.unique(base[3][stays])
            frames.append(_frame(len(keys), part=np.full(len(keys), int(group["part"].iloc[0])), a=keys, more=np.ones(len(keys), bool)))
        return pd.concat(frames) if frames else _frame(0)

    found = stash(arrow_map(source.select("text"), send, "part int, rows binary").groupBy("part").applyInPandas(meet, _FOUND))
    kept = found.where("rows IS NOT NULL").select("part", "rows").groupBy("part")
    members = found.where("more").select("part", "a")
    pairs = found.where("b IS NOT NULL").select("a", "b")
    while True:
        linked = linked.union(_verified(source, _apart(pairs.distinct(), roots), words, threshold))
        roots = components(linked)
        if not members.limit(1).count():
            return noted.where("line = 0").select("id", "th", "key"), roots
        tries *= WIDER
        labelled = members.join(roots, members["a"] == roots["node"], "left").select(F.col("part").alias("home"), "a", F.coalesce("root", "a").alias("root"))
        more = stash(kept.cogroup(labelled.groupBy("home")).applyInPandas(_across(threshold, tries), _FOUND))
        members = more.where("more").select("part", "a")
        pairs = more.where("b IS NOT NULL").select("a", "b")


def _across(threshold: float, tries: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Candidates in different components among the rows of a part, given its keys' components."""

    def again(rows: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(labels):
            return _frame(0)
        base = distinct_rows(_unpacked(list(rows["rows"])))
        root = dict(zip(labels["a"].tolist(), labels["root"].tolist(), strict=True))
        x, y, _, many = candidates(base, threshold, tries, label=np.array([root.get(k, k) for k in base[3].tolist()], np.int64))
        frames = [_pairs(base, x, y)] if len(x) else []
        if (many > tries).any():
            keys = np.unique(base[3])
            frames.append(_frame(len(keys), part=np.full(len(keys), int(rows["part"].iloc[0])), a=keys, more=np.ones(len(keys), bool)))
        return pd.concat(frames) if frames else _frame(0)

    return again


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tries: int = TRIES, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, th, root (the component's least label, see simhash), component_id (its least doc_id) for every row."""
    rows, roots = links(docs, words, threshold, tries=tries, part_rows=part_rows)
    heads = rows.groupBy("key").agg(F.min("id").alias("first_id")).join(roots.withColumnRenamed("node", "key"), "key", "left")
    heads = stash(heads.select("key", F.coalesce("root", "key").alias("root"), simhash.label_of(F.col("first_id"), F.col("key")).alias("label")))
    named = heads.join(heads.groupBy("root").agg(F.min("label").alias("least")), "root").select("key", "least")
    return rows.join(named, "key").select(F.col("id").alias("doc_id"), "th", F.col("least").alias("root"), simhash.id_of(F.col("least")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each component, chosen as simhash.first_rows does; a component without any id keeps one row too."""
    return simhash.first_rows(docs, near_duplicates(docs, words, threshold), one_nameless=True)
