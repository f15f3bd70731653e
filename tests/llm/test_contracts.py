"""The registered queries on a small table of odd rows against brute force, op4 and op8 against independent models, clashing column names, empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orecart.llm import bpe, langid, linededup, media, quality, queries, simhash, substrings, tokencount
from tests.llm.test_operators import SCHEMA, classes, corpus, rows_of, slow_features, slow_fingerprint, slow_lines, slow_strip, texts_by_id, words


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("sf")
    rnd = random.Random(17)
    texts = [*corpus(), words(rnd, 20_000, 3000), "one\n" * 3000, "ß" * 5000]
    spark.createDataFrame(rows_of(texts, -3), SCHEMA).repartition(4).write.parquet(str(out / "documents.parquet"))
    ids = list(range(-3, len(texts) - 3))
    spark.createDataFrame([(i, i % 2, 0) for i in ids[::2]], "doc_id long, quality int, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


@pytest.fixture(scope="module")
def texts(spark, sf):
    return texts_by_id(spark.read.parquet(f"{sf}/documents.parquet"))


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf).collect()


def test_op6_columns(spark, sf, texts):
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    want = classes(fps)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in run(spark, sf, "op6_simhash")} == {(i, f"{f:016x}", want[i]) for i, f in fps.items()}


def test_op10_columns(spark, sf, texts):
    kept = slow_lines(sorted(texts.items()))
    want = {(i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept[i]), hashlib.sha256(("" if t is None else "\n".join(kept[i])).encode()).hexdigest()) for i, t in texts.items()}
    assert {(r.doc_id, max(1, r.n_lines), r.n_removed, r.kept_sha256) for r in run(spark, sf, "op10_line_dedup")} == want


def test_op9_columns(spark, sf, texts):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, sf, "op9_suffix_dedup"))
    assert got == slow_strip(sorted(texts.items()))


def test_op2_op5_op7_columns(spark, sf, texts):
    two, five, seven = ({r.doc_id: r for r in run(spark, sf, n)} for n in ("op2_byte_bpe", "op5_token_counts", "op7_media_columns"))
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.vocabulary(bpe.VOCABULARY)) if t}, special_tokens={})
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert set(two) == set(five) == set(seven) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        ids, n = enc.encode_ordinary(t or ""), len(own.encode(t or "", add_special_tokens=False))
        assert (two[i].n_tokens, two[i].ids_sha256, two[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest())
        assert (five[i].n_bytes, five[i].n_tokens, five[i].over_limit) == (len(raw), n, n > 1024)
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (seven[i].payload_bytes, seven[i].payload_sha256, seven[i].tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


# --- op4 against sums of its own ---


def test_op4_ratio_and_draw(spark, sf, texts):
    rows = {r.doc_id: r for r in run(spark, sf, "op4_quality")}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    bucket: dict = {}

    def cell(gram):
        if gram not in bucket:
            text = (gram if isinstance(gram, bytes) else b" ".join(gram)).decode()
            ((_, _, _, found),) = quality.features(pa.array([text]))
            bucket[gram] = int(found[-1])
        return bucket[gram]

    counts = {i: Counter() for i in texts}
    for i, t in texts.items():
        for gram, n in slow_features(t).items():
            counts[i][cell(gram)] += n
    raw = sum(counts.values(), Counter())
    own = sum((counts[i] for i in good), Counter())
    size = quality.BUCKETS
    ratio = lambda c: math.log((own[c] + 0.5) / (own.total() + size / 2)) - math.log((raw[c] + 0.5) / (raw.total() + size / 2))
    keys = {}
    for i, c in counts.items():
        want = sum(n * ratio(b) for b, n in c.items())
        assert rows[i].log_ratio == pytest.approx(want, rel=1e-9, abs=1e-6)
        u = (int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        keys[i] = want - math.log(-math.log(u))
        assert rows[i].key == pytest.approx(keys[i], rel=1e-9, abs=1e-6)
    best = sorted(keys, key=lambda i: (-keys[i], i))[: round(len(keys) * quality.SELECT_SHARE)]
    assert {i for i, r in rows.items() if r.selected} == set(best)


def test_op4_prefers_the_target_and_takes_null_ids(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["good", "fine", "well"] if i % 2 else ["bad", "poor", "ill"]) for _ in range(60))) for i in range(200)] + [(None, "good fine well"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.resample(docs, docs.where("doc_id % 4 = 1").select("doc_id"), 0.5).collect()
    assert len(out) == len(rows)
    chosen = [r.doc_id for r in out if r.selected and r.doc_id is not None]
    assert sum(i % 2 for i in chosen) > 0.95 * len(chosen)


# --- op8 against an estimation of its own ---

STOCK = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["zor", "wex", "quy", "vib"], "cc": ["one", "the", "ing", "ent"]}


def say(rnd, lang, n):
    return " ".join("".join(rnd.choice(STOCK[lang]) for _ in range(3)) for _ in range(n))


def grams(text):
    raw = b" " + text.encode().lower() + b" "
    return Counter(raw[i : i + 3] for i in range(len(raw) - 2))


def estimate(tables, counts, langs):
    n, pi = counts.total(), {x: 1 / len(langs) for x in langs}
    for _ in range(5000):
        new = dict.fromkeys(langs, 0.0)
        for g, c in counts.items():
            each = {x: pi[x] * tables[x](g) for x in langs}
            for x in langs:
                new[x] += c * each[x] / sum(each.values()) / n
        done = max(abs(new[x] - pi[x]) for x in langs) < 1e-4
        pi = new
        if done:
            break
    return pi, sum(c * math.log(sum(pi[x] * tables[x](g) for x in langs)) for g, c in counts.items())


def test_op8_equals_an_independent_mixture(spark):
    rnd = random.Random(6)
    rows = [(i, say(rnd, x, 30), x) for i, x in enumerate(rnd.choice(list(STOCK)) for _ in range(80))]
    rows += [(100 + i, say(rnd, "aa", a) + " " + say(rnd, "cc", b) + " " + say(rnd, "bb", c), None) for i, (a, b, c) in enumerate([(30, 20, 0), (10, 40, 25), (5, 60, 0), (33, 33, 33), (1, 1, 0)])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    cell = lambda g: int(langid.trigram_buckets(g)[1])  # noqa: E731  the middle one of the padded three
    total = {x: Counter() for x in STOCK}
    for _, t, x in learned:
        for g, n in grams(t).items():
            total[x][cell(g)] += n
    tables = {x: (lambda g, own=own: (own[cell(g)] + 0.5) / (own.total() + langid.BUCKETS / 2)) for x, own in total.items()}
    for i, t, _ in rows:
        counts, langs = grams(t), sorted(STOCK)
        pi, _ = estimate(tables, counts, langs)
        order = sorted(langs, key=lambda x: -pi[x])
        chosen = order[:1]
        share, best = estimate(tables, counts, chosen)
        for x in order[1:]:
            wider, more = estimate(tables, counts, [*chosen, x])
            if pi[x] < 0.02 or more - best <= langid.PENALTY * math.log(max(2, counts.total())):
                break
            chosen, share, best = [*chosen, x], wider, more
        assert set(got[i].lang_set) == set(chosen)
        assert got[i].lang_pred == max(chosen, key=lambda x: share[x]) and got[i].score == pytest.approx(max(share.values()), abs=2e-3)


def test_op8_learns_nothing_from_held_out_rows(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, say(rnd, x, 20), x) for i, x in enumerate(rnd.choice(list(STOCK)) for _ in range(120))]
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    for name, change in (("a", lambda x: x), ("b", lambda x: "zz")):
        spark.createDataFrame([(i, t, change(x) if out(i) else x) for i, t, x in rows], "doc_id long, text string, lang string").write.parquet(str(tmp_path / name / "documents.parquet"))
    a, b = (sorted(queries.QUERIES["op8_language_id"](spark, str(tmp_path / n)).collect()) for n in "ab")
    assert a == b and all(r.held_out == out(r.doc_id) for r in a)
    right = [r.lang_pred == rows[r.doc_id][2] for r in a if r.held_out]
    assert sum(right) >= 0.95 * len(right) > 0


def test_op8_of_a_tie(spark):
    df = spark.createDataFrame([(0, "abc abc", "y"), (1, "abc abc", "x"), (5, "abc", None)], "doc_id long, text string, lang string")
    langs, table = langid.learn(df.where("lang IS NOT NULL"))
    assert {r.lang_pred for r in langid.predict(df, langs, table).collect()} == {"x"}


# --- names and empty tables ---


def test_columns_of_clashing_names(spark):
    df = spark.createDataFrame([(1, "abc def", "en", 5, "x", bytearray(b"BM"))], "doc_id long, text string, lang string, score int, lang_pred string, blob binary")
    out = langid.identify(df.withColumn("lang_set", F.lit(1)))
    assert len(set(out.columns)) == len(out.columns) and out.select("lang_pred", "score", "blob").count() == 1
    out = linededup.deduplicate(df.withColumns({"n_lines": F.lit(9), "n_removed": F.lit("z"), "id": F.lit(1), "key": F.lit(2), "lines": F.lit(3)}))
    assert len(set(out.columns)) == len(out.columns) and out.select("n_lines", "n_removed", "key").first() == (1, 0, 2)
    blobs = df.withColumns({"media_type": F.lit("image/png"), "embedded": F.lit(1), "corrected": F.lit(2)})
    out = media.media_columns(blobs, "blob", "media_type")
    assert len(set(out.columns)) == len(out.columns) and out.select("media_type", "corrected").first() == ("application/octet-stream", True)


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_decode(empty).count() == tokencount.token_counts(empty, str(tmp_path / "c")).count() == media.text_media(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == substrings.strip(empty).count() == linededup.deduplicate(empty).count() == langid.identify(empty).count() == 0


def test_gzip_that_inflates_without_end_is_refused(monkeypatch):
    monkeypatch.setattr(media, "INFLATED", 1 << 20)
    assert media.sniff(media.pack_gzip(b"a" * 1000))[0] == "application/gzip"
    assert media.sniff(media.pack_gzip(b"a" * (8 << 20)))[0] == "application/octet-stream"
    pdf = b"%PDF-1.4 a startxref 1 %%EOF\nb startxref 2 %%EOF"
    assert media.sniff(pdf + b"\n")[0] == "application/pdf" and media.carve(b"x" + pdf + b" end") == [pdf]


def test_batches_are_cut_and_joined_and_the_session_keeps_its_bound(spark):
    from orecart.llm.common import arrow_map, regrouped

    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array([None if i % 3 == 0 else str(i) for i in range(a, b)])], ["a", "b"])
    for rows in (1, 4, 7, 100):
        out = list(regrouped(iter([batch(0, 5), batch(5, 5), batch(5, 6), batch(6, 20)]), rows))
        assert [x for o in out for x in o.column(0).to_pylist()] == list(range(20)) and [len(o) for o in out[:-1]] == [rows] * (len(out) - 1)
        assert [x for o in out for x in o.column(1).to_pylist()] == batch(0, 20).column(1).to_pylist()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "77")
        assert arrow_map(spark.range(200), lambda bs: bs, "id long", 50).count() == 200 and spark.conf.get(name) == "77"
    finally:
        spark.conf.set(name, before)
