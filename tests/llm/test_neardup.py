"""The near-dedup stage against brute-force Jaccard of five-word shingles."""

import random
from itertools import combinations

import pytest

from orecart.llm import neardup
from tests.llm.test_operators import corpus, rows_of, words

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, `lines` int"


def slow_groups(texts):
    """Least row of each row's component; exact copies and pairs of Jaccard 0.8 or more link."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def edited(rnd, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10**6)}"
    return " ".join(w)


def test_stage_equals_brute_force(spark):
    rnd = random.Random(4)
    texts = corpus()
    for _ in range(60):
        base = words(rnd, rnd.randrange(60, 300), 400)
        texts += [base, edited(rnd, base, len(base.split(" ")) // rnd.choice([40, 50, 60, 80]))]
    want = slow_groups(texts)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows_of(texts), SCHEMA).repartition(5), "")
    assert got.columns == corpus_pipeline.COLUMNS
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_long_runs_lose_no_link(spark):
    rnd = random.Random(6)
    texts = []
    for _ in range(4):
        base = words(rnd, 120, 400)
        texts += [edited(rnd, base, rnd.randrange(1, 4)) for _ in range(60)]
    want = slow_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, tries=1, part_rows=200).collect()}
    assert got == want and 4 < len(set(want.values())) < len(texts)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.keep_first(empty).count() == 0


def test_components_without_an_id_keep_one_row(spark):
    near = words(random.Random(2), 80, 400)
    rows = [(None, "z y x w v u"), (None, "z y x w v u"), (None, near), (None, near + " end"), (None, None), (None, " "), (1, "a b c d e"), (None, "a b c d e"), (1, "a b c d e")]
    kept = [(r.doc_id, r.text) for r in neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(i or 0 for i, _ in kept) == [0, 0, 0, 1]
    assert {t for _, t in kept} - {near, near + " end", None, " "} == {"z y x w v u", "a b c d e"}
