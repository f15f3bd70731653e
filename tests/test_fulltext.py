"""Ranks against a plain evaluation of the formula, the stored index, and what a search reads."""

import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from orecart.operators import fulltext as T
from orecart.session import shared_folder


def slow_places(fields):
    out, at = {}, 0
    for text, weight in fields:
        words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
        for i, w in enumerate(words):
            p = min(at + i + 1, 16383)
            own = out.setdefault(w, {})
            own[p] = max(own.get(p, 0), weight)
        at = min(at + len(words), 16383)
    return {w: sorted(p.items())[:256] for w, p in out.items()}


def slow_rank(places, terms):
    if any(t not in places for t in terms):
        return None
    if len(terms) == 1:
        weights = [w for _, w in places[terms[0]]]
        best = max(weights)
        at = weights.index(best) + 1
        return (sum(w / (i + 1) ** 2 for i, w in enumerate(weights)) + best - best / at**2) / 1.64493406685
    res, seen = 1.0, False
    for a, b in combinations(terms, 2):
        for p, v in places[a]:
            for q, w in places[b]:
                if d := abs(p - q):
                    seen = True
                    res *= 1 - math.sqrt(v * w * (1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))))
    return 1 - res if seen and res != 1 else 1e-20


@pytest.fixture(scope="module")
def built(spark):
    rnd = random.Random(1)
    vocabulary = ["alpha", "beta", "gamma", "delta", "épsilon", "x1"]
    text = lambda n: " ".join(rnd.choice(vocabulary + ["fill"] * 8) for _ in range(n))
    rows = [(i, text(3), text(rnd.randint(0, 60))) for i in range(60)]
    rows += [(100, None, None), (101, "Alpha-beta_GAMMA", ""), (102, "", "alpha " * 400 + "beta"), (103, "beta", "fill " * 16_500 + "alpha gamma alpha"), (104, "", "alpha" + " fill" * 200 + " beta")]
    df = spark.createDataFrame(rows, "id long, ref string, body string").repartition(3)
    path = shared_folder(spark)
    index = T.Index(spark, path, folders=8, splits=2).add(T.postings(df.where("id % 2 = 0"), "id", {"ref": "A", "body": "B"}))
    index.add(T.postings(df.where("id % 2 = 1"), "id", {"ref": "A", "body": "B"}))
    return index, rows, df


@pytest.mark.parametrize("terms", [["alpha"], ["beta"], ["alpha", "beta"], ["gamma", "alpha", "x1"], ["épsilon"], ["alpha", "nowhere"], ["alpha", "gamma"], []])
def test_ranks_equal_the_formula(built, terms):
    index, rows, _ = built
    want = {i: r for i, a, b in rows if terms and (r := slow_rank(slow_places([(a, 1.0), (b, 0.4)]), terms)) is not None}
    got = {r.key: r["rank"] for r in index.ranked(terms).collect()}
    assert set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9, abs=1e-12) for i in want)


def test_two_adjacent_words_have_the_published_rank(spark):
    df = spark.createDataFrame([(1, "one two")], "id long, body string")
    index = T.Index(spark, shared_folder(spark), 2, 1).add(T.postings(df, "id", {"body": "D"}))
    assert index.ranked(["one", "two"]).first()["rank"] == pytest.approx(0.09910322, abs=1e-7)


def test_a_search_reads_its_terms_folders_only(built):
    index, _, _ = built
    plan = index.stored(["alpha", "beta"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*folder#\d+ IN \(\d", plan) or re.search(r"PartitionFilters: \[.*folder#\d+ = \d", plan)
    assert "PushedFilters: [In(term" in plan
    files = index.stored(["alpha"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({re.search(r"folder=(\d+)", r.f)[1] for r in files}) == 1


def test_search_keeps_the_best_of_a_group(built):
    index, rows, df = built
    rank = {i: slow_rank(slow_places([(a, 1.0), (b, 0.4)]), ["alpha"]) for i, a, b in rows}
    got = [(r.id, r.relevance) for r in T.search(index, df, ["alpha"], "id", [F.col("id") % 7], [F.desc("id")], 4).collect()]
    best = {}
    for i, r in rank.items():
        if r is not None:
            best[i % 7] = max(best.get(i % 7, (0, 0)), (round(r, 6), i))
    assert got == [(i, pytest.approx(r)) for r, i in sorted(best.values(), reverse=True)[:4]]


def test_an_empty_table(spark):
    none = spark.createDataFrame([], "id long, body string")
    assert T.postings(none, "id", {"body": "B"}).count() == 0


def test_keys_far_apart_and_null(spark):
    df = spark.createDataFrame([(-(1 << 62), "a b"), (5, "b a"), (1 << 61, "a"), (None, "a")], "id long, body string").coalesce(1)
    index = T.Index(spark, shared_folder(spark), 2, 1).add(T.postings(df, "id", {"body": "B"}))
    assert {r.key for r in index.ranked(["a"]).collect()} == {-(1 << 62), 5, 1 << 61}
    assert {r.key for r in index.ranked(["a", "b"]).collect()} == {-(1 << 62), 5}
