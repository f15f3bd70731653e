"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers read a space before the text. Each token's end is its cumulative byte length; the two
sorted runs of ends are merged, and an end that both have closes a group. A link is a pair of tokens
that share a group. Spark counts, for every id pair, the documents that hold it linked, takes the
highest count of every id on either side, and joins both back.

Both tokenizers always cut before a single space between two other characters (a space starts a word
of the first one's pattern, and no piece of the second has a space marker after another character), so
groups never cross such a place. A text is the sequence of its words, and a worker keeps the alignment
of words it has met, up to a bound. Documents are numbered in blocks: within a block an id pair is one
row with the number of its documents, and a document is the list of its pairs' places in the block, so
a pair that all documents hold is one row a block, not one a document.

Defined cases: a text that is null, empty, or that either tokenizer does not give back byte by byte, has
no tokens and zeros, and an empty groups_sha256; every row is a document, repeated ones too; null ids
stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents, stash

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bounds of what a worker keeps (words, their characters) and of a block (pairs of documents). They cost time only.
WORDS_HELD, CHARS_HELD, BLOCK_ENTRIES = 250_000, 24_000_000, 2_500_000
_LINKS_AT_ONCE = 1 << 21
_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level BPE files: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def aligner(a_file: str = A_FILE, b_file: str = B_FILE) -> Aligner:
    return Aligner(a_file, b_file)


class Aligner:
    """Both tokenizers, and the alignment of words met so far. A word stands for a space and its characters."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import os

        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(public_tokenizers.path(a_file))
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        with open(public_tokenizers.path(a_file), encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError(f"{a_file} is no byte-level tokenizer without normalizer and prefix space")
        alphabet = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces) or self.b.encode("  a  b ", out_type=str)[0][:1] != _MARK:
            raise ValueError(f"{b_file} has pieces that go on behind a space, or adds none before the text")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.width = len(self.b_bytes)
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.chars, self.groups = 0, []
        self.sizes = np.zeros((0, 4), np.int64)  # tokens of either side, groups, links
        self.sound = self.loose = np.zeros(0, bool)
        self.pairs = self.times = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        a_lists = [x.ids for x in self.a.encode_batch([f" {w}" for w in words], add_special_tokens=False)]
        b_lists = self.b.encode(words, num_threads=1)
        raw = [f" {w}".encode("utf-8", "surrogatepass") for w in words]
        sound = np.array([b"".join(map(self.a_bytes.__getitem__, a)) == r == b"".join(map(self.b_bytes.__getitem__, b)) for a, b, r in zip(a_lists, b_lists, raw, strict=True)], bool)
        fine = np.flatnonzero(sound)
        sizes = np.zeros((len(words), 4), np.int64)
        texts, per_word, keys, times = [""] * len(words), np.zeros(len(words), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(fine):
            a, b = (np.concatenate([np.array(x[i], np.int64) for i in fine]) for x in (a_lists, b_lists))
            stop = np.cumsum([len(raw[i]) for i in fine])
            a_group, b_group, ends = merge(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
            word = np.searchsorted(stop, ends)  # of each group, among the sound ones
            n_a, n_b = (np.bincount(g, minlength=len(ends)) for g in (a_group, b_group))
            for k, x in enumerate((n_a, n_b, np.ones(len(ends), np.int64), n_a * n_b)):
                sizes[fine, k] = np.bincount(word, weights=x, minlength=len(fine)).astype(np.int64)
            texts_of = self._written(a, b, n_a, n_b)
            first = np.concatenate(([0], np.cumsum(sizes[fine, 2]))).tolist()
            for k, i in enumerate(fine.tolist()):
                texts[i] = ";".join(texts_of[first[k] : first[k + 1]])
            counted, times = linked(a, b, n_a, n_b, word, self.width, len(self.a_bytes))
            span = len(self.a_bytes) * self.width
            keys, per_word[fine] = counted % span, np.bincount(counted // span, minlength=len(fine))
        self.slot.update(zip(words, range(len(self.slot), len(self.slot) + len(words)), strict=True))
        self.chars += sum(map(len, words)) + sum(map(len, texts))
        self.groups += texts
        self.sizes, self.sound = np.concatenate((self.sizes, sizes)), np.concatenate((self.sound, sound))
        self.loose = np.concatenate((self.loose, np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)))
        self.pairs, self.times = np.concatenate((self.pairs, keys)), np.concatenate((self.times, times))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(per_word)))

    def _written(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        out, i, j = [], 0, 0
        left, right = [self.a_text[x] for x in a.tolist()], [self.b_text[x] for x in b.tolist()]
        for m, n in zip(n_a.tolist(), n_b.tolist(), strict=True):
            out.append(f"{','.join(left[i : i + m])}|{','.join(right[j : j + n])}")
            i, j = i + m, j + n
        return out

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Word numbers of every text. All words of the call are kept at once, so that none is forgotten meanwhile."""
        if len(self.slot) > WORDS_HELD or self.chars > CHARS_HELD:
            self.forget()
        cut = [t.split(" ") for t in texts]
        self._know(cut)
        out, again = [self._numbers(x) for x in cut], []
        for i, x in enumerate(out):
            if self.loose[x].any():  # white space beside a space: no cut there
                again.append(i)
        if again:
            cut = [[u[1:] for u in _CUT.split(f" {texts[i]}")] for i in again]
            self._know(cut)
            for i, x in zip(again, cut, strict=True):
                out[i] = self._numbers(x)
        return out

    def _know(self, cut: list[list[str]]) -> None:
        new = list(dict.fromkeys(w for x in cut for w in x if w not in self.slot))
        for at in range(0, len(new), 50_000):
            self.learn(new[at : at + 50_000])

    def _numbers(self, words: list[str]) -> np.ndarray:
        return np.array([self.slot[w] for w in words], np.int64)


def merge(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group of each token of either side and the ends of the groups; both runs of ends rise to the same last end.

    The two pointers are a stable sort of two sorted runs, which merges them in one walk; an end that both have stands twice.
    """
    both = np.concatenate((a_ends, b_ends))
    order = both.argsort(kind="stable")
    walked = both[order]
    twice = np.flatnonzero(walked[1:] == walked[:-1])
    closed = np.zeros(len(walked), np.int64)
    closed[twice[:-1] + 2] = 1
    group = np.empty(len(walked), np.int64)
    group[order] = np.cumsum(closed)
    return group[: len(a_ends)], group[len(a_ends) :], walked[twice]


def linked(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, word: np.ndarray, width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (word, a, b) as (word * height + a) * width + b, rising, and how many links each has."""
    a_at, b_at, links = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b, n_a * n_b
    found: list[tuple[np.ndarray, np.ndarray]] = []
    edge = np.cumsum(links)
    at = 0
    while at < len(links):
        to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + _LINKS_AT_ONCE, "right")))
        if to == at + 1 and links[at] > _LINKS_AT_ONCE:  # a very large group: distinct ids of either side with their counts
            x, p = np.unique(a[a_at[at] : a_at[at] + n_a[at]], return_counts=True)
            y, q = np.unique(b[b_at[at] : b_at[at] + n_b[at]], return_counts=True)
            found.append((((word[at] * height + x[:, None]) * width + y[None, :]).ravel(), (p[:, None] * q[None, :]).ravel()))
        else:
            g = np.arange(at, to)
            of = np.repeat(g, n_a[g])  # group of each left token
            left = np.arange(a_at[at], a_at[at] + len(of))
            each = n_b[of]
            row = np.repeat(np.arange(len(of)), each)
            right = b_at[of][row] + np.arange(len(row)) - (np.cumsum(each) - each)[row]
            found.append(np.unique((word[of][row] * height + a[left][row]) * width + b[right], return_counts=True))
        at = to
    return summed(np.concatenate([k for k, _ in found]), np.concatenate([n for _, n in found])) if found else (np.zeros(0, np.int64),) * 2


def summed(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, rising, with the sums of their amounts."""
    if not len(keys):
        return keys, amounts
    order = keys.argsort(kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[start], np.add.reduceat(amounts[order], start)


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ALIGNED = f"block long, slot int, a int, b int, n_docs long, {_DOC}, places binary"
_DONE = f"{_DOC}, n_best long, n_best_b long, count_sum long"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _table(schema: str, n: int, **columns: object) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], _KINDS[k]) if name in columns else pa.nulls(n, _KINDS[k]) for name, k in fields], [name for name, _ in fields])


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, of which the upper ones compress to nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents of one block: result columns, and (document, pair, links) entries."""

    def __init__(self, number: int) -> None:
        self.number, self.rows, self.size = number, [], 0
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []

    def take(self, own: Aligner, ids: list, texts: list[str | None]) -> None:
        """Align a batch of documents."""
        given = [i for i, t in enumerate(texts) if t]
        numbers = own.words([texts[i] for i in given])
        rows, kept = [(i, 0, 0, 0, 0, "") for i in ids], []
        for i, x in zip(given, numbers, strict=True):
            if own.sound[x].all():
                groups = ";".join([own.groups[w] for w in x.tolist()])
                rows[i] = (ids[i], *own.sizes[x].sum(axis=0).tolist(), hashlib.sha256(groups.encode()).hexdigest())
                kept.append((i, x))
        self.rows += rows
        counts = np.zeros(len(ids), np.int64)
        if kept:
            flat = np.concatenate([(np.int64(i) << 40) + x for i, x in kept])
            flat, n = np.unique(flat, return_counts=True)
            doc, word = flat >> 40, flat & ((1 << 40) - 1)
            each = own.starts[word + 1] - own.starts[word]
            row = np.repeat(np.arange(len(word)), each)
            at = own.starts[word][row] + np.arange(len(row)) - (np.cumsum(each) - each)[row]
            keys, times = summed((doc[row] << 40) + own.pairs[at], own.times[at] * n[row])
            counts = np.bincount(keys >> 40, minlength=len(ids))
            self.keys.append(keys & ((1 << 40) - 1))
            self.times.append(times)
            self.size += len(keys)
        self.ends.append(counts)

    def close(self, width: int) -> Iterator[pa.RecordBatch]:
        """Rows of id pairs, then rows of documents."""
        empty = [np.zeros(0, np.int64)]
        pairs, place, n_docs = np.unique(np.concatenate(self.keys or empty), return_inverse=True, return_counts=True)
        times, ends = np.concatenate(self.times or empty), np.concatenate(([0], np.cumsum(np.concatenate(self.ends)))).tolist()
        for at in range(0, len(pairs), 65_536):
            part = pairs[at : at + 65_536]
            yield _table(_ALIGNED, len(part), block=np.full(len(part), self.number), slot=np.arange(at, at + len(part), dtype=np.int32), a=(part // width).astype(np.int32), b=(part % width).astype(np.int32), n_docs=n_docs[at : at + len(part)])
        for at in range(0, len(self.rows), 512):
            part = self.rows[at : at + 512]
            places = [_planes(np.concatenate((np.diff(place[i:j], prepend=0), times[i:j]))) for i, j in zip(ends[at : at + len(part)], ends[at + 1 : at + 1 + len(part)], strict=True)]
            names = [x.split()[0] for x in _DOC.split(", ")]
            yield _table(_ALIGNED, len(part), block=np.full(len(part), self.number), places=places, **dict(zip(names, map(list, zip(*part, strict=True)), strict=True)))


def alignments(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Rows of id pairs (block, slot, a, b, n_docs) and rows of documents (block, their columns, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task = aligner(a_file, b_file), TaskContext.get().partitionId()
        block = _Block(task << 24)
        for batch in batches:
            ids, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            while at < len(ids):
                to, chars = at, 0
                while to < len(ids) and (to == at or chars + len(texts[to] or "") <= 2 << 20):
                    chars += len(texts[to] or "")
                    to += 1
                block.take(own, ids[at:to], texts[at:to])
                at = to
                if block.size >= entries:
                    yield from block.close(own.width)
                    block = _Block(block.number + 1)
        if block.rows:
            yield from block.close(own.width)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _ALIGNED)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, n: documents that hold the pair linked; best_a, best_b: whether no pair of that id has more.

    The maxima have a row for each id of a vocabulary at most, which bounds what is broadcast.
    """
    counts = pairs.groupBy("a", "b").agg(F.sum("n_docs").alias("n"))
    top = lambda c: F.broadcast(counts.groupBy(c).agg(F.max("n").alias(f"top_{c}")))
    return counts.join(top("a"), "a").join(top("b"), "b").select("a", "b", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b"))


def align(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, entries: int = BLOCK_ENTRIES) -> DataFrame:
    """One row per document: its tokens, groups and links, how many links are the most frequent of their A or B id, and the sum of their counts."""
    made = stash(alignments(docs, a_file, b_file, entries))
    pairs = made.where("slot IS NOT NULL").select("block", "slot", "a", "b", "n_docs")
    counts = stash(pair_counts(pairs))
    back = pairs.join(counts, ["a", "b"]).select("block", "slot", "n", (F.col("best_a").cast("int") + 2 * F.col("best_b").cast("int")).alias("best"))
    names = [x.split()[0] for x in _DOC.split(", ")]
    rows = made.where("slot IS NULL").select("block", *names, "places")
    both = back.unionByName(rows, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", F.asc_nulls_last("slot")).select("block", "slot", "n", "best", *names, "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, best = None, [], []
        for batch in batches:
            block, slot = batch.column(0).to_numpy(), batch.column(1)
            edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))).tolist()
            for i, j in zip(edges, edges[1:], strict=False):
                if block[i] != at:
                    at, n, best = block[i], [], []
                part = batch.slice(i, j - i)
                k = len(part) - slot.slice(i, j - i).null_count
                if k:
                    n.append(part.column(2).slice(0, k).to_numpy(zero_copy_only=False).astype(np.int64))
                    best.append(part.column(3).slice(0, k).to_numpy(zero_copy_only=False).astype(np.int64))
                if k < len(part):
                    n, best = ([np.concatenate(x)] if len(x) > 1 else x for x in (n, best))
                    yield _finished(part.slice(k), n[0] if n else np.zeros(0, np.int64), best[0] if best else np.zeros(0, np.int64))

    return arrow_map(both, run, _DONE, 4096)


def _finished(docs: pa.RecordBatch, n: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    sums = []
    for raw in docs.column(docs.num_columns - 1).to_pylist():
        found = _numbers(raw)
        place, times = np.cumsum(found[: len(found) // 2]), found[len(found) // 2 :]
        sums.append(((times * (best[place] & 1)).sum(), (times * (best[place] >> 1)).sum(), (times * n[place]).sum()))
    done = np.array(sums, np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([*docs.columns[4:-1], *(pa.array(done[:, k]) for k in range(3))], [x.split()[0] for x in _DONE.split(", ")])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir))
