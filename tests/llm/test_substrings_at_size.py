"""What the suffix step sends between tasks: copies of a text cost no windows, and the bitmaps grow with the texts."""

import random

from orecart.llm import substrings
from tests.llm.test_operators import slow_strip


def _prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))


def _sent(spark):
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_copies_send_no_windows(spark, tmp_path):
    rnd = random.Random(21)
    texts = [_prose(rnd, 400) for _ in range(60)]
    sent, rows = [], []
    for copies in (1, 20):
        path = str(tmp_path / str(copies))
        spark.createDataFrame([(60 * c + i, t) for c in range(copies) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(path)
        df = spark.read.parquet(path)
        before = _sent(spark)
        rows.append(substrings.covered(df).count())
        sent.append(_sent(spark) - before)
    assert rows == [0, 60 * 19]
    # Before, every window of every copy was sent.
    assert sent[1] < 3 * sent[0], sent


def test_larger_cells_and_bitmaps_give_the_same(spark, monkeypatch):
    rnd = random.Random(22)
    passage = _prose(rnd, 40)
    rows = [(i, f"{_prose(rnd, 20)} {passage[i : i + 70 + i]} {_prose(rnd, 9)}") for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(20)] + [(5, rows[30][1]), (None, rows[7][1]), (None, None), (200, "a" * 49), (201, "a" * 49), (202, "é" * 25), (203, "é" * 25), (203, "é" * 25)]
    monkeypatch.setattr(substrings, "GROWTH", sum(len((t or "").encode()) for t in {t for _, t in rows}) // 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = substrings.strip(df).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == set(slow_strip(rows)) and len(got) == len(rows)
