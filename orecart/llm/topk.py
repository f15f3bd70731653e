"""Exact top-k inner-product search: one ball tree per shard, branch and bound, a shared kth score.

Vectors are quantised in the JVM and go to the nearest of at most 64 pivots of their dimension, which
come from a bounded sample; a pivot's cell is hashed into shards of bounded size, and each shard
becomes one serialised ball tree. Queries first search their own shard, which gives every query a valid
lower bound of its global kth score. A query then leaves out every cell whose ball cannot reach that
score; blocks of those that remain meet the root balls of the cell's shards, and only the queries of a
block that a root ball can serve travel to its tree. The task that handles a shard raises the kth scores
from block to block. A node is opened only if `q.c + |q| r` can still reach the kth score.

Defined cases: a null id, a null vector, and a vector with a null or non-finite component take no
part. Only vectors of one dimension, which may be zero, are compared with each other, and a query's
ranks count among them. Rows count, not ids: rows that
repeat an id are candidates each, also of one another, and a query row of its own each; only the
query's own row is no candidate of it. Equal scores go to the smaller id. Fewer than k candidates: all
are returned. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orecart.llm.common import stash

LEAF_ROWS = 96
#: Bounds of the sample that pivots come from, of the pivots of a dimension, and of the dimensions that get any. They bear on speed only.
SAMPLE_ROWS, PIVOTS, DIMENSIONS = 4096, 64, 16


def quantise(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def reach(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of every query with every ball, with room for rounding."""
    norm = np.sqrt((queries * queries).sum(axis=1))
    bound = queries @ centres.T + norm[:, None] * radii[None, :]
    return bound + 1e-9 * (np.abs(bound) + norm[:, None] * (radii + np.sqrt((centres**2).sum(axis=1)))[None, :]) + 1e-6


class BallTree:
    """Arrays of nodes: centre, radius, and either two children or a run of rows."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        """marks: a number for every row, in all trees of the dimension."""
        points = rows.astype(np.float64)
        order, self.spans, self.children = np.arange(len(ids)), [], []
        centres, radii = [], []

        def build(lo: int, hi: int) -> int:
            own = points[order[lo:hi]]
            centre = own.mean(axis=0)
            node = len(self.spans)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            self.spans.append((lo, hi))
            self.children.append(None)
            if hi - lo > leaf:
                a = own[((own - centre) ** 2).sum(axis=1).argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                mid = (hi - lo) // 2
                part = np.argpartition(own @ (b - a), mid)
                order[lo:hi] = order[lo:hi][part]
                self.children[node] = (build(lo, lo + mid), build(lo + mid, hi))
            return node

        build(0, len(ids))
        self.ids, self.marks, self.rows = ids[order], marks[order], rows[order]
        self.centres, self.radii = np.array(centres), np.array(radii)
        # Products stay exact in doubles below 2**53; else integers are multiplied.
        self.reach = float(np.abs(points).max(initial=0.0))

    def search(self, queries: np.ndarray, query_marks: np.ndarray, best: list[list[tuple[int, int, int]]], k: int) -> None:
        """Merge this tree's rows into best: per query a list of (-score, id, mark), sorted, k at most."""
        q = queries.astype(np.float64)
        exact = self.reach * float(np.abs(q).max(initial=0.0)) * max(1, q.shape[1]) < 2**52
        rows = self.rows.astype(np.float64) if exact else self.rows
        bound = reach(q, self.centres, self.radii)
        for i, own in enumerate(query_marks):
            kept, limits = best[i], bound[i]
            vector = q[i] if exact else queries[i]
            heap = [(-limits[0], 0)]
            while heap:
                upper, node = heapq.heappop(heap)
                if len(kept) == k and -upper < -kept[-1][0]:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        if len(kept) < k or limits[child] >= -kept[-1][0]:
                            heapq.heappush(heap, (-limits[child], child))
                    continue
                lo, hi = self.spans[node]
                scores = rows[lo:hi] @ vector
                ids, marks = self.ids[lo:hi], self.marks[lo:hi]
                take = marks != own
                if len(kept) == k:
                    take &= scores >= -kept[-1][0]
                found = np.flatnonzero(take)
                if len(found) > k:
                    found = found[np.lexsort((marks[found], ids[found], -scores[found]))[:k]]
                if len(found):
                    kept.extend((-int(scores[j]), int(ids[j]), int(marks[j])) for j in found)
                    kept.sort()
                    del kept[k:]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), dim)


def pivots(base: DataFrame) -> dict[int, np.ndarray]:
    """Centres of the leaves of a ball tree over a bounded sample, for the sample's most frequent dimensions."""
    taken = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("dim", "v").collect()
    by: dict[int, list] = {}
    for row in taken:
        by.setdefault(row.dim, []).append(row.v)
    out = {}
    for dim, rows in sorted(by.items(), key=lambda x: -len(x[1]))[:DIMENSIONS]:
        if dim and len(rows) > 1:
            tree = BallTree(np.arange(len(rows)), np.arange(len(rows)), np.array(rows, np.int64).reshape(len(rows), dim), max(1, -(-len(rows) // (PIVOTS // 2))))
            out[dim] = tree.centres[[not c for c in tree.children]][:PIVOTS]
    return out


def _nearest(known: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, far = np.zeros(len(pdf), np.int32), np.zeros(len(pdf))
            for dim, at in pdf.groupby("dim").indices.items():
                x = _matrix(pdf["v"].iloc[at], dim).astype(np.float64)
                own = known.get(dim, np.zeros((1, dim)))
                cell[at] = ((own * own).sum(axis=1)[None, :] - 2 * x @ own.T).argmin(axis=1)
                far[at] = np.sqrt(((x - own[cell[at]]) ** 2).sum(axis=1))
            yield pdf.assign(cell=cell, far=far)

    return run


def shards(base: DataFrame, known: dict[int, np.ndarray], shard_rows: int) -> DataFrame:
    """Adds cell, the distance from its pivot, and the shard within the cell."""
    placed = stash(base.mapInPandas(_nearest(known), f"{', '.join(f'{n} {t}' for n, t in base.dtypes)}, cell int, far double"))
    parts = placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("parts"))
    # Rows of one id may be many; they are told apart by their vectors.
    return placed.join(parts, ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")).drop("parts")


def _plant(k: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        dim, cell, shard = (int(group[c].iloc[0]) for c in ("dim", "cell", "shard"))
        ids, rows = group["vec_id"].to_numpy(np.int64), _matrix(group["v"], dim)
        # Of the rows of a dimension: 6 bits for the cell, 29 for the shard, 28 for the place. The table written below keeps them.
        marks = (np.int64(cell) << 57) + (np.int64(shard) << 28) + np.arange(len(ids))
        tree = BallTree(ids, marks, rows)
        mine = np.flatnonzero(group["is_query"].to_numpy(bool))
        best: list[list[tuple[int, int, int]]] = [[] for _ in mine]
        tree.search(rows[mine], marks[mine], best, k)
        home = pickle.dumps((ids[mine], marks[mine], rows[mine], best), 5)
        return pd.DataFrame({"dim": [dim], "cell": [cell], "shard": [shard], "centre": [tree.centres[0].tobytes()], "radius": [tree.radii[0]], "tree": [pickle.dumps(tree, 5)], "home": [home]})

    return run


def _kth(best: list[tuple[int, int, int]], k: int) -> float:
    return float(-best[-1][0]) if len(best) == k else -np.inf


_ASKED = "dim int, cell int, query_id long, mark long, one binary"


def _ask(known: dict[int, np.ndarray], far: dict[tuple[int, int], float], k: int):
    """Every query once for each cell whose ball reaches its kth score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, home in zip(pdf["dim"], pdf["home"], strict=True):
                ids, marks, rows, best = pickle.loads(home)
                if not len(ids):
                    continue
                if dim in known:
                    bound = reach(rows.astype(np.float64), known[dim], np.array([far.get((dim, c), -np.inf) for c in range(len(known[dim]))]))
                    met = np.argwhere(bound >= np.array([_kth(b, k) for b in best])[:, None])
                else:
                    met = np.array([(i, 0) for i in range(len(ids))])
                if len(met):
                    at = met[:, 0]
                    ones = [pickle.dumps((r, b), 5) for r, b in zip(rows, best, strict=True)]
                    yield pd.DataFrame({"dim": dim, "cell": met[:, 1].astype(np.int32), "query_id": ids[at], "mark": marks[at], "one": [ones[i] for i in at]})

    return run


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    ones = [pickle.loads(x) for x in group["one"]]
    block = (group["query_id"].to_numpy(np.int64), group["mark"].to_numpy(np.int64), np.array([r for r, _ in ones]), [b for _, b in ones])
    return pd.DataFrame({"dim": [int(group["dim"].iloc[0])], "cell": [int(group["cell"].iloc[0])], "block": [int(group["block"].iloc[0])], "queries": [pickle.dumps(block, 5)]})


def _sift(k: int):
    """Of every block and shard, the queries that the root ball can serve; queries have searched their own shard already."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, block, out = None, None, []
            for dim, cell, shard, centre, radius, number, raw in zip(*(pdf[c] for c in ("dim", "cell", "shard", "centre", "radius", "block", "queries")), strict=True):
                if last != (dim, cell, number):
                    last, block = (dim, cell, number), pickle.loads(raw)
                ids, marks, rows, best = block
                bound = reach(rows.astype(np.float64), np.frombuffer(centre, np.float64)[None, :], np.array([radius]))[:, 0]
                at = np.flatnonzero((bound >= np.array([_kth(b, k) for b in best])) & (marks >> 28 != (cell << 29) + shard))
                if len(at):
                    out.append((dim, cell, shard, pickle.dumps((ids[at], marks[at], rows[at], [best[i] for i in at]), 5)))
            if out:
                yield pd.DataFrame(out, columns=["dim", "cell", "shard", "queries"])

    return run


_FOUND = "dim int, query_id long, query_mark long, vec_id long, mark long, score long"


def _meet(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kth: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        last, tree = None, None
        for pdf in batches:
            for dim, cell, shard, raw, queries in zip(*(pdf[c] for c in ("dim", "cell", "shard", "tree", "queries")), strict=True):
                if last != (dim, cell, shard):
                    last, tree = (dim, cell, shard), pickle.loads(raw)
                ids, marks, rows, best = pickle.loads(queries)
                if len(kth) > 100_000:
                    kth.clear()
                best = [kth.get((dim, int(m)), b) for m, b in zip(marks, best, strict=True)]
                tree.search(rows, marks, best, k)
                kth.update(((dim, int(m)), b) for m, b in zip(marks, best, strict=True))
                out = [(dim, int(i), int(m), y, z, -x) for i, m, b in zip(ids, marks, best, strict=True) for x, y, z in b]
                if out:
                    yield pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def _homes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What queries have found in their own shards."""
    for pdf in batches:
        out = [(dim, int(i), int(m), y, z, -x) for dim, home in zip(pdf["dim"], pdf["home"], strict=True) for i, m, _, b in [*zip(*pickle.loads(home), strict=True)] for x, y, z in b]
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _FOUND.split(", ")])


def met(planted: DataFrame, known: dict[int, np.ndarray], far: dict[tuple[int, int], float], blocks: int, k: int) -> DataFrame:
    """dim, cell, shard, queries: the shards that some query of a block may still gain from, with those queries."""
    asked = planted.select("dim", "home").mapInPandas(_ask(known, far, k), _ASKED)
    packed = stash(asked.withColumn("block", F.pmod(F.xxhash64("mark"), F.lit(blocks)).cast("int")).groupBy("dim", "cell", "block").applyInPandas(_pack, "dim int, cell int, block int, queries binary"))
    roots = planted.select("dim", "cell", "shard", "centre", "radius")
    return packed.join(roots, ["dim", "cell"]).select("dim", "cell", "shard", "centre", "radius", "block", "queries").mapInPandas(_sift(k), "dim int, cell int, shard int, queries binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 4096, block_rows: int = 512, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row."""
    base = vectors.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), quantise(F.col(vec_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query")).withColumn("dim", F.size("v"))
    known = pivots(base)
    own = shards(base, known, shard_rows)
    planted = stash(own.groupBy("dim", "cell", "shard").applyInPandas(_plant(k), "dim int, cell int, shard int, centre binary, radius double, tree binary, home binary"))
    sizes = own.where(F.col("dim").isin(list(known))).groupBy("dim", "cell").agg(F.max("far").alias("far")).collect() if known else []  # a row for each pivot at most
    blocks = max(1, -(-base.where("is_query").count() // block_rows))
    pairs = met(planted, known, {(r.dim, r.cell): r.far for r in sizes}, blocks, k)
    away = pairs.join(planted.select("dim", "cell", "shard", "tree"), ["dim", "cell", "shard"]).select("dim", "cell", "shard", "tree", "queries").mapInPandas(_meet(k), _FOUND)
    found = planted.select("dim", "home").mapInPandas(_homes, _FOUND).unionByName(away).distinct()
    w = Window.partitionBy("dim", "query_mark").orderBy(F.desc("score"), F.asc("vec_id"), F.asc("mark"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
