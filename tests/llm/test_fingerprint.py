"""op11: edited texts and order against plain Python; sums, insertion and deletion; likeness against exact window counts."""

import hashlib
import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from orecart.llm import fingerprint as fp
from tests.llm.test_operators import SCHEMA, corpus, rows_of, words


def split(text):
    return (text or "").encode().split(b"\n")


def exact(a, b):
    """Cosine of the counts of windows."""
    count = lambda t: Counter(p.ljust(12, b"\0")[i : i + 12] for p in split(t) for i in range(max(1, len(p) - 11)))
    x, y = count(a), count(b)
    return sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def in_order(rows):
    tie = lambda t: (v := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (1 << 64) * (v >> 63)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))


def want(rows):
    order, out = in_order(rows), Counter()
    for (i, t), (_, after) in zip(order, [*order[1:], *order[:1]], strict=True):
        t, after = t or "", after or ""
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        out[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp.digest(fp.hashed(split(t))), fp.digest(fp.hashed(split(edited))), round(fp.likeness(fp.hashed(split(t)), fp.hashed(split(edited))), 9), round(fp.likeness(fp.hashed(split(t)), fp.hashed(split(after))), 9)] += 1
    return out


def held(df):
    return Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


@pytest.mark.parametrize("parts", ["1", "7"])
def test_neighbours_and_edits(spark, parts):
    rnd = random.Random(3)
    texts = [*corpus()[:70], None, "", "x", "ab", "\n", "a\nb\n", "\U0001f642" * 7, "ßé\n" * 40, words(rnd, 9000, 900)]
    rows = [(i * 3 - 9, t) for i, t in enumerate(texts)] + [(None, "n"), (None, None), (0, "zero"), (0, "again"), (0, "zero")]
    rnd.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert held(fp.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == want(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_registered_query_and_small_tables(spark, tmp_path):
    texts = corpus()[:50]
    spark.createDataFrame(rows_of(texts, 2), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert held(fp.op11_document_fingerprints(spark, str(tmp_path))) == want(list(enumerate(texts, 2)))
    assert fp.edit_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fp.edit_likeness(spark.createDataFrame([(5, "abcd", 1, 2)], "doc_id long, text string, TIE long, part long")).first()
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"abab").hexdigest())


def test_order_does_not_matter_and_copies_do(spark):
    a, b = fp.hashed([b"one", b"two", b"two"]), fp.hashed([b"two", b"one", b"two"])
    assert fp.digest(a) == fp.digest(b) and fp.likeness(a, b) == 1.0
    assert fp.digest(a) != fp.digest(fp.hashed([b"one", b"two"])) != fp.digest(fp.hashed([b"one", b"two", b""]))
    assert fp.digest(fp.minus(a, fp.hashed([b"two"]))) == fp.digest(fp.hashed([b"two", b"one"]))
    wrapped = fp.zero()
    for _ in range(1 << 4):
        wrapped = fp.plus(wrapped, fp.hashed([b"x"] * 4096))
    assert fp.digest(wrapped) == fp.digest(fp.zero())  # lanes are modulo 2**16


def test_likeness_follows_window_counts():
    rnd = random.Random(8)
    for n in (60, 400, 3000):
        a, b = words(rnd, n, 5000), words(rnd, n, 5000)
        edited = a[: len(a) // 2] + b[: len(a) // 2]
        for x, y in ((a, edited), (a, b), (a, a + " more")):
            assert fp.likeness(fp.hashed(split(x)), fp.hashed(split(y))) == pytest.approx(exact(x, y), abs=0.1)


def test_long_texts_are_cut_at_any_place(monkeypatch):
    text = "\n".join(words(random.Random(1), 30, 50) for _ in range(40))
    whole = fp.hashed(split(text))
    monkeypatch.setattr(fp, "_AT_ONCE", 37)
    assert (fp.hashed(split(text))[1] == whole[1]).all()


def test_stored_fingerprints_take_insertions_and_deletions(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, "x"), (3, None), (None, "n\nm")], "doc_id long, text string")
    changes = spark.createDataFrame([(1, "b", -1), (1, "d", 1), (1, "d", 1), (2, "y", 1), (2, "y", -1), (4, "new", 1), (None, "m", -1), (3, None, 1), (3, "z", None)], "doc_id long, paragraph string, sign int").repartition(5)
    got = {r.doc_id: r.fingerprint for r in fp.changed(fp.fingerprints(docs), changes).collect()}
    new = {1: "d\na\nc\nd", 2: "x", 3: "", 4: "new", None: "n"}
    assert got == {i: fp.digest(fp.hashed(split(t))) for i, t in new.items()}
    assert fp.changed(fp.fingerprints(docs), changes.where(F.lit(False))).count() == 4
