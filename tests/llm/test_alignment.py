"""op13 against a slow alignment of whole texts, token by token."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from orecart.llm import alignment
from tests.llm.test_operators import SCHEMA, corpus, rows_of, words


def tokens(text):
    """Ids and bytes of both tokenizers, from whole texts."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        tokens.a = Tokenizer.from_file(P.path(alignment.A_FILE))
        tokens.a.encode_special_tokens = True
        tokens.b = sentencepiece.SentencePieceProcessor(model_file=P.path(alignment.B_FILE))
        back = {c: b for c, b in alignment.byte_alphabet().items()}
        tokens.raw = {i: bytes(back[c] for c in t) for t, i in tokens.a.get_vocab().items() if all(c in back for c in t)}
    a = tokens.a.encode(" " + text, add_special_tokens=False).ids
    b = tokens.b.encode(text)
    piece = lambda i: bytes([int(tokens.b.id_to_piece(i)[3:5], 16)]) if tokens.b.is_byte(i) else tokens.b.id_to_piece(i).replace("▁", " ").encode()
    return [(i, tokens.raw[i]) for i in a], [(i, piece(i)) for i in b]


def slow_groups(text):
    a, b = tokens(text)
    if b"".join(x for _, x in a) != (" " + text).encode() or b"".join(x for _, x in b) != (" " + text).encode():
        return None
    groups, i, j, x, y, left, right = [], 0, 0, 0, 0, [], []
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            left.append(a[i][0])
            x += len(a[i][1])
            i += 1
        else:
            right.append(b[j][0])
            y += len(b[j][1])
            j += 1
        if x == y:
            groups.append((left, right))
            left, right = [], []
    return groups


def slow_align(rows):
    found = [slow_groups(t) if t else None for _, t in rows]
    links = [[(p, q) for left, right in g or [] for p in left for q in right] for g in found]
    count = Counter(x for own in links for x in set(own))
    top = defaultdict(int)
    for (p, _), n in count.items():
        top[p] = max(top[p], n)
    out = Counter()
    for (i, _), g, own in zip(rows, found, links, strict=True):
        text = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g or [])
        out[i, sum(len(p) for p, _ in g or []), sum(len(q) for _, q in g or []), len(g or []), len(own), sum(count[x] == top[x[0]] for x in own), sum(count[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if g else ""] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [" lead", "trail ", "two  spaces", "a \n b", "a\nb\n\nc d", "\tx\ty z", "nbsp x y", "\x1c q", "mark ▁ here", "it's <|endoftext|> <s> <0x41> ok", "日本語のテキスト 🙂🙂 x", "a" * 3000, "zq" * 900 + " end", "  u", "é é ﬁ", "0 12 3456,7", " ", "\n", "nul\0 x", "don't  'll"]


def held(spark, rows, entries=alignment.BLOCK_ENTRIES):
    out = alignment.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), entries=entries)
    return Counter(tuple(r[c] for c in COLUMNS) for r in out.collect())


@pytest.mark.parametrize("entries", [1, alignment.BLOCK_ENTRIES])
def test_alignment_equals_a_slow_one(spark, monkeypatch, entries):
    rnd = random.Random(5)
    texts = [*corpus()[:60], *ODD, words(rnd, 2000, 300), None, ""]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 3
    assert held(spark, rows, entries) == slow_align(rows)


def test_registered_query(spark, tmp_path):
    texts = [*corpus()[:40], *ODD]
    spark.createDataFrame(rows_of(texts, 5), SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = alignment.op13_token_alignment(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == slow_align(list(enumerate(texts, 5)))


def test_words_are_forgotten_without_a_trace(monkeypatch):
    monkeypatch.setattr(alignment, "WORDS_HELD", 5)
    own = alignment.Aligner(alignment.A_FILE, alignment.B_FILE)
    rnd = random.Random(9)
    for _ in range(6):
        text = words(rnd, 50, 40)
        (x,) = own.words([text])
        want = slow_groups(text)
        assert own.sizes[x].sum(axis=0).tolist() == [sum(len(p) for p, _ in want), sum(len(q) for _, q in want), len(want), sum(len(p) * len(q) for p, q in want)]


def test_large_groups_count_without_their_links(monkeypatch):
    monkeypatch.setattr(alignment, "_LINKS_AT_ONCE", 6)
    a, b, n_a, n_b, word = (np.array(x) for x in ([1, 1, 2, 5, 1], [7, 7, 8, 9, 9], [3, 2], [3, 2], [0, 1]))
    keys, times = alignment.linked(a, b, n_a, n_b, word, 10, 10)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == {17: 4, 18: 2, 27: 2, 28: 1, 159: 2, 119: 2}


def test_empty_table_and_more_columns(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, n long, BLOCK long")
    assert alignment.align(rows).first().n_groups == 2
