"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orecart.llm import bpe, components, langid, linededup, media, mixing, quality, simhash, substrings, tokencount, topk
from orecart.llm.suffix import suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, `lines` int"


def rows_of(texts, start=0):
    return [(start + i, t, ["en", "fr", None][i % 3], f"s{i % 4}" if i % 5 else None, None, "x", 1, 2) for i, t in enumerate(texts)]


def words(rnd, n, stock=40):
    return " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(stock)) for _ in range(n))


def corpus():
    rnd = random.Random(11)
    base = [words(rnd, rnd.randrange(1, 80)) for _ in range(30)]
    out = [None, "", " \n\t", "é日本 – ok", "x" * 400, "a b c", "a b c", *base]
    for t in base[:10]:
        w = t.split(" ")
        w[rnd.randrange(len(w))] = "edited"
        out += [t, " ".join(w), t + "\n" + rnd.choice(base), "intro " + t.upper()]
    out.append("\n".join(base[:12]) + "\n\n" + words(rnd, 3000))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(corpus()), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_by_id(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


# --- op1 ---


def test_topk_equals_full_scan_with_ties_and_bad_vectors(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], "e") for i in range(400)]
    rows += [(1000, None, "e"), (1001, [1.0, None, 0.0, 0.0], "e"), (1002, [float("nan"), 0.0, 0.0, 0.0], "e"), (None, [1.0] * 4, "e"), (1003, [float("inf")] * 4, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=60, block_rows=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: [int(np.floor(256 * x)) for x in v] for i, v, _ in rows[:400]}
    for i in range(0, 400, 50):
        want = sorted(((-sum(a * b for a, b in zip(good[i], v, strict=True)), j) for j, v in good.items() if j != i))[:5]
        assert got[i] == [(j, -s) for s, j in want]
    assert set(got) == set(range(0, 400, 50))


def test_topk_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(df, F.lit(True)).orderBy("query_id").collect()] == [(0, 1), (1, 0)]
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_of_repeated_ids(spark):
    """Every row but the query's own row is a candidate; every query row has a ranking of its own."""
    rnd = random.Random(9)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(70, [9.0] * 4)] * 5 + [(71, [8.0] * 4), (71, [-8.0] * 4), (71, [7.0, 8.0, 8.0, 9.0])] + [(0, [1.0, 1.0, 1.0, 1.0]), rows[10], rows[10]]
    want = []
    for a, (i, x) in enumerate(rows):
        if i % 10 == 0:
            others = sorted((-sum(int(256 * p) * int(256 * q) for p, q in zip(x, y, strict=True)), j) for b, (j, y) in enumerate(rows) if b != a)
            want.append((i, tuple((j, -s) for s, j in others[:5])))
    for shard_rows in (4096, 8):
        got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=3).collect()
        assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in got) == Counter((i, n + 1, j, s) for i, found in want for n, (j, s) in enumerate(found))


# --- op2 and op5 ---


def test_bpe_equals_the_library(spark, docs):
    import public_tokenizers as P
    import tiktoken

    tokens = bpe.vocabulary(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    texts = texts_by_id(docs)
    for r in bpe.encode_decode(docs, with_ids=True).collect():
        text = texts[r.doc_id] or ""
        want = enc.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(struct.pack("<I", x) for x in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_of_odd_strings():
    import public_tokenizers as P
    import tiktoken

    rnd, own = random.Random(1), bpe.codec(bpe.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(own.tokens) if t}, special_tokens={})
    alphabet = "ab e'stdlvr  \n\t  \x1c\x85é日0123!?$　Ⅷ²"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(50))) for _ in range(600)] + ["", "a" * 300, "ab" * 200, "thethethe" * 30, "<|endoftext|>", "".join(rnd.choice("abcdethis") for _ in range(900))]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == [enc.encode_ordinary(t) for t in texts]
    assert own.decode(ids) == [t.encode() for t in texts]
    with pytest.raises(ValueError, match="vocabulary"):
        own.decode([np.array([10**6])])


def test_token_counts_and_cache(spark, docs, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame(rows_of(["x <|endoftext|> y", "a b c"], 900), SCHEMA)
    all_docs, cache = docs.union(extra), str(tmp_path / "cache")
    texts = texts_by_id(all_docs)
    for r in tokencount.token_counts(all_docs, cache, limit=20).collect():
        n = len(own.encode(texts[r.doc_id] or "", add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 20)
    held = spark.read.parquet(cache).count()
    assert held == len({t or "" for t in texts.values()})
    more = all_docs.union(spark.createDataFrame(rows_of(["quite new"], 990), SCHEMA))
    assert tokencount.token_counts(more, cache).count() == more.count()
    assert spark.read.parquet(cache).count() == held + 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_tokenizers(name):
    got = tokencount.counter(name).count(["Hello world", "", "two  words"])
    assert got[1] == 0 and min(got[0], got[2]) >= 2


# --- op3 ---


def test_mixing_meets_targets(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, 5 + i % 30), rnd.choice(["en", "fr"]), rnd.choice(["a", "b", "c"]) if i > 300 else "a", 0, "", 0, 0) for i in range(900)]
    rows += [(None, None, None, None, 0, "", 0, 0), (901, "", "en", "a", 0, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    cells = mixing.describe(df).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("t"))
    targets = {"source": {"a": 0.2, "b": 0.5, "c": 0.3}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {"general": 1.0}}
    got = mixing.rake(cells, targets, rounds=25).groupBy("source").agg(F.sum("weight").alias("w")).collect()
    total = sum(r.w for r in got)
    assert all(abs(r.w / total - targets["source"].get(r.source, 0)) < 1e-6 for r in got)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    kept = sum(r.n_tokens * r.probability for r in out) / sum(r.n_tokens for r in out)
    assert abs(kept - mixing.KEEP_SHARE) < 0.02
    assert {r.doc_id for r in out if r.sampled} == {r.doc_id for r in mixing.sample(df).collect()}


def test_mixing_of_nothing(empty):
    assert mixing.mix(empty).count() == 0 and mixing.sample(empty).columns == empty.columns


# --- op4 ---


def slow_features(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").lower().encode()) if (text or "").isascii() else (text or "").encode().lower().split()
    return Counter(w) + Counter(zip(w, w[1:], strict=False))


def test_quality_ratio_selection_and_ties(spark, docs):
    texts = texts_by_id(docs)
    good = spark.createDataFrame([(i,) for i in list(texts)[::3]] + [(10**9,)], "doc_id long")
    model = quality.fit(docs, good)
    total = sum(sum(slow_features(t).values()) for t in texts.values())
    rows = {r.doc_id: r for r in quality.resample(docs, good, 0.5).collect()}
    assert sum(r.n_grams for r in rows.values()) == total
    assert all(rows[i].n_grams == sum(slow_features(t).values()) for i, t in texts.items())
    assert rows[0].log_ratio == 0 and len(model) == quality.BUCKETS
    k = round(len(rows) * 0.5)
    best = sorted(rows.values(), key=lambda r: (-r.key, r.doc_id))[:k]
    assert {r.doc_id for r in best} == {i for i, r in rows.items() if r.selected}


def test_threshold_among_equal_keys(spark):
    keys = spark.createDataFrame([(i, float(i // 10)) for i in range(100)], "doc_id long, key double")
    assert quality.threshold(keys, 25, 7) == (7.0, 5)
    same = spark.createDataFrame([(i, 1.5) for i in range(9)], "doc_id long, key double")
    assert quality.threshold(same, 4) == (1.5, 4)


def test_quality_without_rows_or_targets(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long")
    assert quality.resample(empty, none).count() == 0
    assert {r.log_ratio for r in quality.resample(docs, none).collect()} == {0.0}


# --- op6 ---


def slow_fingerprint(text):
    import xxhash

    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, distance=4):
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(docs):
    fps = {i: slow_fingerprint(t) for i, t in texts_by_id(docs).items()}
    want = classes(fps)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == want
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_links_lose_nothing_in_dense_groups(spark):
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    fps = sorted({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(5))) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    edges = simhash.links(df).where("a <> b")
    n = edges.distinct().count()
    roots = {r.node % 2**64: r.root for r in components.components(edges).collect()}
    want = classes(dict(enumerate(fps)))
    groups = defaultdict(set)
    for i, c in want.items():
        groups[c].add(fps[i])
    big = [g for g in groups.values() if len(g) > 1]
    assert all(len({roots[x] for x in g}) == 1 for g in big) and len({roots[next(iter(g))] for g in big}) == len(big)
    assert n < 64 * len(fps)


def test_simhash_of_repeated_and_null_ids(spark, empty):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "z y x w v u"), (None, "z y x w v u")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_first(df).orderBy("doc_id").collect()] == [None, None, 1]
    assert simhash.keep_first(empty).count() == 0


# --- op7 ---


def test_text_media_round_trip(docs):
    texts = texts_by_id(docs)
    for r in media.text_media(docs).collect():
        raw = (texts[r.doc_id] or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes == len(padded) + 44 and r.feature.startswith("audio/wav;declared=image/png;corrected=true")


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_and_carving(spark):
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x11\xff\x00\x22\xff\xd9"
    pdf = b"%PDF-1.4 x startxref 9 %%EOF"
    au = b".snd" + struct.pack(">IIIII", 24, 4, 1, 8000, 1) + b"abcd"
    for blob, kind in ((png(), "image/png"), (gif, "image/gif"), (bmp, "image/bmp"), (jpeg, "image/jpeg"), (pdf, "application/pdf"), (au, "audio/basic"), (media.pack_gzip(b"x"), "application/gzip"), (media.to_wav(b"ab"), "audio/wav")):
        assert media.sniff(blob)[0] == kind
        inside = b"text BM and GIF89a " + blob + b" tail"
        assert media.carve(inside) == [blob]
        assert media.sniff(blob[: len(blob) // 2])[0] == "application/octet-stream"
    df = spark.createDataFrame([(bytearray(png()), "image/png", 1), (bytearray(gif), "image/png", 2), (None, None, 3)], "blob binary, said string, media int")
    assert [(r.media_type, r.corrected) for r in media.media_columns(df, "blob", "said").orderBy("media").collect()] == [("image/png", False), ("image/gif", True), ("application/octet-stream", True)]


# --- op8 ---


def test_language_mixture(spark):
    rnd = random.Random(6)
    stock = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["zor", "wex", "quy", "vib"], "cc": ["one", "the", "ing", "ent"]}
    say = lambda lang, n: " ".join("".join(rnd.choice(stock[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, say(lang, 40), lang) for i, lang in enumerate(rnd.choice(list(stock)) for _ in range(240))]
    rows += [(500, None, "aa"), (501, "123 !!", "bb"), (502, say("aa", 60) + " " + say("bb", 40), None), (None, say("cc", 30), "cc")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:240])
    assert got[500].lang_pred == got[501].lang_pred == "und" and got[500].score == 0
    assert got[502].lang_pred == "aa" and set(got[502].lang_set) == {"aa", "bb"} and 0.45 < got[502].score < 0.75


def test_language_with_nothing_learned(spark, empty):
    assert langid.identify(empty).count() == 0
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]


# --- op9 ---


def test_suffix_array_equals_sorting():
    rnd = random.Random(3)
    for _ in range(500):
        n, k = rnd.randrange(0, 40), rnd.choice([1, 2, 3, 26])
        x = bytes(rnd.randrange(k) for _ in range(n)) * rnd.choice([1, 1, 3])
        assert suffix_array(np.frombuffer(x, np.uint8)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def slow_strip(texts):
    first = {}
    for i, t in sorted(texts, key=lambda x: -1 if x[0] is None else x[0]):
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], -1 if i is None else i)
    out = Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (-1 if i is None else i):
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[(i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    return out


def test_substrings_equal_brute_force(spark, docs, empty):
    rnd = random.Random(12)
    passage = words(rnd, 40)
    more = [f"{words(rnd, 6)} {passage[a : a + 70 + a]} {words(rnd, 4)}" for a in range(0, 60, 3)] + ["ab" * 80, "ab" * 60 + "c", "a" * 120, "a" * 49, "a" * 50]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(2000 - i, t) for i, t in enumerate(more)] + [(3, words(rnd, 30)), (2000, more[0]), (None, more[1]), (None, more[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.strip(df).collect())
    assert got == slow_strip(rows)
    assert substrings.strip(empty).count() == 0


def test_long_texts_are_cut_with_overlap():
    import pyarrow as pa

    rnd = random.Random(5)
    text = words(rnd, 4000)
    whole = {(int(c.lo[k]), int(c.windows[k]), int(c.form[k])) for c in substrings.contexts_of(pa.array([text])) for k in range(len(c.lo))}
    parts = [(int(c.lo[k]), int(c.windows[k])) for c in substrings.contexts_of(pa.array([text]), piecewise=1000) for k in range(len(c.lo))]
    assert sum(n for _, n in parts) == sum(n for _, n, _ in whole) == len(text) - 49
    assert len({p for lo, n in parts for p in range(lo, lo + n)}) == len(text) - 49


# --- op10 ---


def slow_lines(rows, t=0.8):
    order = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0]))
    sets = []
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in order:
        for n, line in enumerate((text or "").split("\n")):
            sets.append((-1 if i is None else i, n, frozenset(x for x in re.split("[\x20\x09-\x0d]+", line.translate(low)) if x)))
    out = {}
    for i, text in order:
        kept = []
        for n, line in enumerate((text or "").split("\n")):
            own = frozenset(x for x in re.split("[\x20\x09-\x0d]+", line.translate(low)) if x)
            at = (-1 if i is None else i, n)
            if not own or not any((a, b) < at and s and len(s & own) >= t * len(s | own) - 1e-9 for a, b, s in sets):
                kept.append(line)
        out[i] = kept
    return out


def test_line_dedup_equals_brute_force(spark, docs, empty):
    rnd = random.Random(21)
    family = words(rnd, 24, 400).split(" ")
    variants = []
    for _ in range(120):  # one word in many lines, and candidates that fail
        v = list(family)
        for _ in range(rnd.randrange(1, 5)):
            v[rnd.randrange(len(v))] = words(rnd, 1, 5000)
        variants.append(" ".join(v))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 - i, "\n".join(variants[i * 4 : i * 4 + 4]) + "\n") for i in range(30)] + [(None, variants[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumn("x", F.lit(1)).withColumn("place", F.lit(2))
    got = linededup.deduplicate(df).collect()
    # Frequent words over several salts, more rounds, more parts: the same lines go.
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in linededup.deduplicate(df, salt_rows=8, part_rows=50, tries=3).collect()}
    want = slow_lines(rows)
    for r in got:
        text = dict(rows)[r.doc_id]
        assert r.text == (None if text is None else "\n".join(want[r.doc_id])), r.doc_id
        assert r.n_removed == len((text or "").split("\n")) - len(want[r.doc_id])
    assert linededup.deduplicate(empty).count() == 0


def test_rows_of_one_id_do_not_remove_each_other(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in linededup.deduplicate(df).collect()) == [(1, 0), (1, 0), (2, 1)]
