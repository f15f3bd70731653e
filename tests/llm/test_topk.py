"""op1 through the registered query: mixed, zero and repeated dimensions against a full scan, and shards that are left out."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orecart.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>"


def full_scan(rows, every, k=5):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (i, x) in enumerate(good):
        if i % every == 0:
            others = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), j, b) for b, (j, y) in enumerate(good) if b != a and len(y) == len(x))
            out.update((i, n + 1, j, -s) for n, (s, j, _) in enumerate(others[:k]))
    return out


def held(df):
    return Counter((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def mixed(rnd):
    rows = [(i, [rnd.choice([-1.0, -0.25, 0.0, 0.5, 1.0]) for _ in range(d)]) for d in (1, 4, 8, 3) for i in range(120)]
    rows += [(i, []) for i in range(45, 58)] + [(50, [9.0] * 4)] * 40 + [(100, [1.0] * 8)] * 9 + [(200, [0.5])]
    return rows + [(50, None), (None, [1.0] * 4), (0, [float("nan")] * 4), (0, [1.0, None]), (0, [float("inf")]), (0, [7.0, 7.0])]


def test_registered_query_of_mixed_dimensions(spark, tmp_path):
    rows = mixed(random.Random(4))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert held(queries.QUERIES["op1_topk_ball_tree"](spark, str(tmp_path))) == full_scan(rows, 50)


def test_mixed_dimensions_in_many_shards_and_blocks(spark):
    rows = mixed(random.Random(6))
    assert held(topk.top_k(spark.createDataFrame(rows, SCHEMA).repartition(2), F.col("vec_id") % 10 == 0, shard_rows=16, block_rows=7)) == full_scan(rows, 10)


def test_clustered_vectors_leave_shards_out(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 8)) * 40
    rows = [(i, [float(x) for x in centres[i % 12] + rnd.normal(size=8)]) for i in range(1200)]
    seen = []
    real = topk.met
    monkeypatch.setattr(topk, "met", lambda planted, *a: seen.append((planted, *a)) or real(planted, *a))
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 40 == 0, shard_rows=25, block_rows=1)
    assert held(got) == full_scan(rows, 40)
    planted, known, far, blocks, k = seen[0]
    assert real(planted, known, far, blocks, k).count() < planted.count() * 30 / 4  # of 30 queries and all shards
