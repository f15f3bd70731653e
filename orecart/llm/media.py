"""Media columns by signature sniffing.

One Aho-Corasick pass finds every magic byte string of a blob. A format validator then walks the
structure from that place and returns its exact length or nothing, so a chance match is no hit.
The validated type at offset 0 corrects the declared type; validated hits inside are carved as
embedded media. A blob that no validator accepts keeps type application/octet-stream.

Defined cases: a null text is stored as an empty one; a null blob sniffs as octet-stream with no
embedded media; equal texts give equal values; repeated rows stay; extra columns stay, except that
columns named media_type, embedded or corrected are replaced; a gzip member that inflates to more
than INFLATED bytes is not accepted; an empty table gives an empty one.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents

# Media type by magic bytes.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"RIFF": "audio/wav",
    b".snd": "audio/basic",
    b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf",
}
PAD, UNIT, RATE = b"\x20", 192, 8000
#: Bytes to which a gzip member may inflate; it is read piece by piece, and nothing is kept.
INFLATED = 1 << 28
_PIECE = 1 << 16


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def _png(b: bytes, at: int) -> int | None:
    p, seen = at + 8, False
    while p + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, p)
        end = p + 12 + size
        if end > len(b) or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if not seen and kind != b"IHDR":
            return None
        seen = True
        if kind == b"IEND":
            return end - at
        p = end
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        kind, size = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if size < 2 or not 0xC0 <= kind <= 0xFE:
            return None
        p += 2 + size
        if kind == 0xDA:  # entropy-coded data runs to a marker that is neither stuffing nor a restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7 or b[p + 1] == 0xFF:
                    p += 1 if b[p + 1] == 0xFF else 2
                    continue
                break
            else:
                return None
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    size, reserved, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    sound = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= offset <= size
    return size if sound and at + size <= len(b) else None


def _wav(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    p, end, found = at + 12, at + size, set()
    if end > len(b):
        return None
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, p)
        if p + 8 + n > end:
            return None
        found.add(kind)
        p += 8 + n + (n & 1)
    return size if {b"fmt ", b"data"} <= found and p >= end else None


def _au(b: bytes, at: int) -> int | None:
    if at + 24 > len(b):
        return None
    offset, n, code, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    sound = offset >= 24 and 1 <= code <= 27 and 1 <= channels <= 64 and rate and at + offset + n <= len(b)
    return offset + n if sound else None


def _gz(b: bytes, at: int) -> int | None:
    d, out = zlib.decompressobj(31), 0
    try:
        for p in range(at, len(b), _PIECE):
            rest = b[p : p + _PIECE]
            stop = p + len(rest)
            while rest:
                out += len(d.decompress(rest, 1 << 20))
                if d.eof:
                    return stop - len(d.unused_data) - at
                if out > INFLATED:
                    return None
                rest = d.unconsumed_tail
    except zlib.error:
        pass
    return None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before another file begins: updates are appended after an end mark."""
    after = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, after if after >= 0 else len(b))
    return end + 5 - at if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "audio/basic": _au, "application/gzip": _gz, "application/pdf": _pdf}


def sniff(blob: bytes | None) -> tuple[str, list[tuple[int, int, str]]]:
    """The validated type at offset 0, and (offset, length, type) of the media embedded further in."""
    if not blob:
        return "application/octet-stream", []
    kind, inner, covered = "application/octet-stream", [], 0
    for end, (n, found) in automaton().iter(blob.decode("latin-1")):
        at = end - n + 1
        if at and at < covered:
            continue
        if size := VALIDATORS[found](blob, at):
            if at == 0:
                kind = found
            else:
                inner.append((at, size, found))
                covered = at + size
    return kind, inner


def carve(blob: bytes) -> list[bytes]:
    return [blob[a : a + n] for a, n, _ in sniff(blob)[1]]


def payload_of(text: bytes) -> bytes:
    units = max(1, -(-len(text) // UNIT))
    return text + PAD * (units * UNIT - len(text))


def to_wav(payload: bytes) -> bytes:
    """Payload bytes as unsigned 8-bit mono samples; a multiple of 192 needs no pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def read_wav(blob: bytes) -> tuple[bytes, int]:
    """Samples and rate, found by walking the chunks."""
    p, rate = 12, 0
    while p + 8 <= len(blob):
        kind, n = struct.unpack_from("<4sI", blob, p)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", blob, p + 12)[0]
        if kind == b"data":
            return blob[p + 8 : p + 8 + n], rate
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def pack_gzip(data: bytes) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
        f.write(data)
    return out.getvalue()


def media_columns(blobs: DataFrame, blob_col: str = "blob", declared_col: str | None = None) -> DataFrame:
    """Adds media_type, embedded (offset, length, type) and, given a declared type, corrected (that was wrong) to a table of blobs."""
    fields = "media_type string, embedded array<struct<offset:long,length:long,type:string>>"
    stay = [c for c in blobs.columns if c not in {"media_type", "embedded", *(["corrected"] if declared_col else [])}]
    helpers = {"__blob": F.col(f"`{blob_col}`")} | ({"__said": F.col(f"`{declared_col}`")} if declared_col else {})
    blobs = blobs.select(*[F.col(f"`{c}`") for c in stay], *[c.alias(k) for k, c in helpers.items()])
    taken = blobs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [sniff(x) for x in batch.column(taken.index("__blob")).to_pylist()]
            inner = pa.array([[{"offset": a, "length": n, "type": t} for a, n, t in y] for _, y in seen], pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in seen], pa.string()), inner], [*taken, "media_type", "embedded"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema.fields] + [fields])
    out = arrow_map(blobs, run, schema, 256)
    if declared_col:
        out = out.withColumn("corrected", ~F.col("__said").eqNullSafe(F.col("media_type")))
    return out.drop(*helpers)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def text_media(docs: DataFrame, declared: str = "image/png") -> DataFrame:
    """Stores every text as WAV under a deliberately wrong declared type; sniffing corrects it and the samples are read back."""

    def one(doc_id: int | None, text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        blob = to_wav(payload_of(raw))
        kind, inner = sniff(blob)
        samples, rate = read_wav(blob)
        feature = f"{kind};declared={declared};corrected={str(kind != declared).lower()};rate={rate};frames={len(samples)};embedded={len(inner)}" + "".join(f";{t}@{a}+{n}" for a, n, t in inner)
        return doc_id, len(raw), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(documents(spark, sf_dir))
