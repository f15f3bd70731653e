"""Versions on storage: folds over parts, two writers, a crash before publishing, compaction."""

import threading

import pytest
from pyspark.sql import functions as F

from orecart.session import shared_folder
from orecart.sources import state
from orecart.streaming import targets


def log(spark, rows):
    df = spark.createDataFrame(rows, "url string, seq long, priority long, title string")
    none = F.lit(None).cast("string")
    return df.select("*", F.lit(1).alias("depth"), F.lit(1.0).alias("priority_score"), F.lit(1).alias("occurrences"), F.array("title").alias("matched_queries"), *[F.col("title").alias(c) for c in ("domain", "source_type", "discovered_by", "state")], *[none.alias(c) for c in ("anchor_text", "archetype", "base_url", "parent_url", "priority_reason", "product_id", "product_name")], F.col("seq").cast("int").alias("attempts"), F.lit(None).cast("timestamp").alias("next_attempt_at"))


def seen(df):
    return {r.url: (r.priority, r.title, r.state, r.attempts, r.occurrences) for r in df.collect()}


def changes(spark, rows):
    return spark.createDataFrame(rows, "url string, seq long, name string, value string")


def test_versions_compaction_and_patches(spark):
    t = state.Targets(spark, shared_folder(spark))
    assert t.read() is None and t.latest() == 0
    assert t.upsert(log(spark, [("a", 1, 5, "x"), ("b", 2, 7, "y"), ("a", 3, 4, "z")])) == 1
    assert t.patch(changes(spark, [("a", 1, "state", "done"), ("b", 1, "attempts", "9")])) == 2
    assert t.upsert(log(spark, [("a", 1, 9, "w"), ("c", 1, 1, "n")])) == 3
    want = {"a": (4, "w", "done", 1, 3), "b": (7, "y", "y", 9, 1), "c": (1, "n", "n", 1, 1)}
    assert seen(t.read()) == want
    assert seen(t.read(1)) == {"a": (4, "z", "x", 1, 2), "b": (7, "y", "y", 2, 1)}
    assert t.compact() == 4 and len(t.parts(4)) == 1 and seen(t.read()) == want
    t.upsert(log(spark, [("a", 0, 2, "v")]))
    t.patch(changes(spark, [("a", 0, "state", None)]))
    assert seen(t.read())["a"] == (2, "v", None, 1, 4)
    assert seen(t.read(2))["a"] == (4, "z", "done", 1, 2)


def test_two_writers_both_commit_and_expected_versions_conflict(spark):
    t = state.Targets(spark, shared_folder(spark))
    jobs = [threading.Thread(target=t.upsert, args=(log(spark, [(f"u{i}", i, i, "t")]),)) for i in range(4)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert t.latest() == 4 and set(seen(t.read())) == {"u0", "u1", "u2", "u3"}
    with pytest.raises(state.ConflictError):
        t.upsert(log(spark, [("late", 1, 1, "t")]), expected=3)
    assert t.upsert(log(spark, [("next", 1, 1, "t")]), expected=4) == 5 and "late" not in seen(t.read())


def test_a_crash_before_publishing_leaves_the_version_before(spark, monkeypatch):
    t = state.Targets(spark, shared_folder(spark))
    t.upsert(log(spark, [("a", 1, 1, "t")]))

    def crash(*_):
        raise OSError("gone")

    for where in ("publish", "parts"):
        with monkeypatch.context() as m:
            m.setattr(t, where, crash)
            with pytest.raises(OSError):
                t.upsert(log(spark, [("b", 1, 1, "t")]))
        assert t.latest() == 1 and set(seen(t.read())) == {"a"}
    t.upsert(log(spark, [("b", 1, 1, "t")]))
    assert set(seen(t.read())) == {"a", "b"}


def test_the_fold_does_not_depend_on_the_cut(spark):
    rows = [(f"u{i % 7}", i, (i * 5) % 11, f"t{i}") for i in range(60)]
    one = targets.fold_upserts(log(spark, rows))
    t = state.Targets(spark, shared_folder(spark))
    for at in range(0, 60, 20):
        t.upsert(log(spark, rows[at : at + 20]))
        t.compact()
    assert seen(t.read()) == seen(one)
