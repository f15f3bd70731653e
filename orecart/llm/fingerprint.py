"""Document fingerprints as a homomorphic multiset hash.

A paragraph (what stands between line feeds, the empty one too) is hashed to a wide vector of two parts:
1,024 lanes of SHAKE-128 output modulo 2**16, which tell multisets apart, and 2,048 lanes modulo 2**32
that count its byte windows with signs, for likeness. A document's vector is the sum over its
paragraphs, so their order does not matter, equal texts have equal vectors, and a paragraph is inserted
or deleted by adding or subtracting its vector. `fingerprint` is the SHA-256 of the first part; the
likeness of two vectors is the cosine of the second parts, which estimates that of the window counts
within about 0.02, cut to 0..1, and 1 where the first parts are equal.

Neighbours in order of doc_id are found by one range shuffle: a task streams its sorted documents and
holds two of them. The first and the last document of each task are written beside the results, and
joined by task number afterwards; they are two rows a task.

Defined cases: a null text is empty, which is one empty paragraph; null ids come first, rows of one id
are ordered by Spark's XXH64 of their text; the last document's next is the first, a single document's
itself; equal rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents, mix64, stash

LANES, SKETCH_LANES, WINDOW = 1024, 2048, 12
_AT_ONCE = 1 << 19
_HELD = 2048

Vector = tuple[np.ndarray, np.ndarray]


def zero() -> Vector:
    return np.zeros(LANES, np.uint16), np.zeros(SKETCH_LANES, np.uint32)


def plus(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1]


def _expand(paragraph: bytes) -> bytes:
    return hashlib.shake_128(paragraph).digest(2 * LANES)


_expand_short = lru_cache(maxsize=8192)(_expand)


def hashed(paragraphs: list[bytes]) -> Vector:
    """Sum of the paragraphs' vectors."""
    wide = np.zeros(LANES, np.uint16)
    for at in range(0, len(paragraphs), 256):
        raw = b"".join([(_expand_short if len(p) <= _HELD else _expand)(p) for p in paragraphs[at : at + 256]])
        wide += np.frombuffer(raw, "<u2").reshape(-1, LANES).sum(axis=0, dtype=np.uint16)
    return wide, _sketch(paragraphs)


def _sketch(paragraphs: list[bytes]) -> np.ndarray:
    """Signed counts of the windows of WINDOW bytes within the paragraphs; a shorter paragraph is filled up to one window."""
    out = np.zeros(2 * SKETCH_LANES, np.int64)
    raw = np.frombuffer(b"\n".join([p if len(p) >= WINDOW else p.ljust(WINDOW, b"\0") for p in paragraphs]), np.uint8)
    for at in range(0, max(0, len(raw) - WINDOW + 1), _AT_ONCE):
        part = raw[at : at + _AT_ONCE + WINDOW - 1]
        n = len(part) - WINDOW + 1
        head = np.ndarray((n,), "<u8", part, 0, (1,))
        tail = np.ndarray((n,), "<u4", part, 8, (1,)).astype(np.uint64)
        hashes = mix64(head ^ (tail * np.uint64(0x9E3779B97F4A7C15)))
        ends = np.concatenate(([0], np.cumsum(part == 10)))
        if ends[-1]:
            hashes = hashes[ends[WINDOW:] == ends[:-WINDOW]]
        out += np.bincount((hashes & np.uint64(2 * SKETCH_LANES - 1)).astype(np.int64), minlength=2 * SKETCH_LANES)
    return (out[:SKETCH_LANES] - out[SKETCH_LANES:]).astype(np.uint32)


def likeness(a: Vector, b: Vector) -> float:
    if np.array_equal(a[0], b[0]):
        return 1.0
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / norm)) if norm else 0.0


def digest(v: Vector) -> str:
    return hashlib.sha256(v[0].astype("<u2").tobytes()).hexdigest()


def _paragraphs(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


class _Document:
    """A text with the vector of the paragraphs that its edit keeps whole, and of those that the edit cuts or drops."""

    def __init__(self, doc_id: int | None, text: str | None) -> None:
        self.doc_id, self.text = doc_id, text or ""
        self.gone = len(self.text) // 2
        self.kept = self.text[: len(self.text) - self.gone]
        self.whole = self.kept.rfind("\n") + 1 if self.gone else 0
        tail = hashed(_paragraphs(self.text[self.whole :]))
        self.tail, self.vector = tail, plus(hashed(_paragraphs(self.text[: self.whole - 1])), tail) if self.whole else tail

    def row(self, after: _Document) -> tuple:
        """The result row: the edited text's vector comes from the own one by deletion and insertion."""
        edited, vector = self.text, self.vector
        if self.gone:
            new = after.text[: self.gone]
            edited = self.kept + new
            vector = plus(minus(self.vector, self.tail), hashed(_paragraphs(self.kept[self.whole :] + new)))
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), sha, digest(self.vector), digest(vector), likeness(self.vector, vector), likeness(self.vector, after.vector)


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EDGES = "part int, edge string, text string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def _batches(rows: Iterable[tuple], schema: str, most: int = 512) -> Iterator[pa.RecordBatch]:
    fields, held = [x.split() for x in schema.split(", ")], []
    make = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), _KINDS[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield make()
            held = []
    if held:
        yield make()


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Per document: fingerprints of its text and of its text with the second half replaced from the next document, and their likeness."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def rows() -> Iterator[tuple]:
            held = None
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    now = _Document(doc_id, text)
                    if held is None:
                        yield (doc_id, *[None] * 6, part, "first", text)
                    else:
                        yield (*held.row(now), part, None, None)
                    held = now
            if held is not None:
                yield (held.doc_id, *[None] * 6, part, "last", held.text)

        yield from _batches(rows(), f"{_RESULT}, {_EDGES}")

    done = stash(arrow_map(own.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"), run, f"{_RESULT}, {_EDGES}", 256))
    first = done.where("edge = 'first'").select("part", F.col("text").alias("next_text"))
    after = F.lead("part").over(Window.orderBy("part"))
    lowest = done.where("edge = 'first'").agg(F.min("part").alias("lowest"))
    # As many rows as tasks had documents: numbers only, so one task may order them.
    following = first.select("part", after.alias("after")).crossJoin(lowest).select("part", F.coalesce("after", "lowest").alias("after"))
    pairs = done.where("edge = 'last'").select("doc_id", "text", "part").join(following, "part").join(first.withColumnRenamed("part", "after"), "after").select("doc_id", "text", "next_text")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_Document(i, a).row(_Document(None, b)) for batch in batches for i, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)), _RESULT)

    return done.where("edge IS NULL").select(*[x.split()[0] for x in _RESULT.split(", ")]).unionByName(arrow_map(pairs, resolve, _RESULT, 16))


_STORED = "doc_id long, fingerprint string, wide binary, sketch binary"


def _row(doc_id: int | None, v: Vector) -> tuple:
    return doc_id, digest(v), v[0].astype("<u2").tobytes(), v[1].astype("<u4").tobytes()


def _vector(wide: bytes, sketch: bytes) -> Vector:
    return np.frombuffer(wide, "<u2").astype(np.uint16), np.frombuffer(sketch, "<u4").astype(np.uint32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the vector's two parts as bytes, for later insertion and deletion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_row(i, hashed(_paragraphs(t or ""))) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), _STORED, 128)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _STORED, 256)


def changed(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Fingerprints after changes (doc_id, paragraph, sign: 1 inserts, -1 deletes), without the documents' other paragraphs.

    stored: as fingerprints() gives it, one row an id. Each task sums its own changes of a document first, so at most
    one vector per task and document is shuffled. Documents without changes stay; changes of a document that is not
    stored start from no paragraph at all; null ids are one document; a null paragraph or sign changes nothing.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int | None, Vector] = {}
        for batch in batches:
            for i, p, sign in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v = hashed([p.encode("utf-8", "surrogatepass")])
                held[i] = (plus if sign > 0 else minus)(held.get(i) or zero(), v)
            if len(held) >= 4096:
                yield from _batches((_row(i, v) for i, v in held.items()), _STORED, 128)
                held = {}
        yield from _batches((_row(i, v) for i, v in held.items()), _STORED, 128)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, at = None, None
            for batch in batches:
                for i, _, wide, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if now is not None and i == at:
                        now = plus(now, _vector(wide, sketch))
                        continue
                    if now is not None:
                        yield _row(at, now)
                    now, at = _vector(wide, sketch), i
            if now is not None:
                yield _row(at, now)

        yield from _batches(rows(), _STORED, 128)

    real = changes.where("paragraph IS NOT NULL AND sign IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("paragraph").cast("string").alias("paragraph"), F.col("sign").cast("int").alias("sign"))
    parts = stored.select("doc_id", "fingerprint", "wide", "sketch").unionByName(arrow_map(real, sums, _STORED))
    return arrow_map(parts.repartition("doc_id").sortWithinPartitions("doc_id"), total, _STORED, 128)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(documents(spark, sf_dir))
