"""Exact substring deduplication: bytes covered by a 50-byte string that also starts in a document of smaller id.

Every 50-byte window names an anchor, its 25-byte piece of least hash (the leftmost of equals), so
equal windows have equal anchors at equal offsets. Neighbouring windows of a document that share an
anchor form one context. Of equal texts the first alone is searched; its later copies go whole. Anchors
of one document only cannot remove anything; a pass over compressed anchor cells finds the others, and
a bitmap (false positives cost time only) picks their contexts in the next pass. Cells and bitmap grow
with the bytes of different texts, the bitmap up to 2**29 bits. Equal contexts are collapsed, by a 64-bit digest, to one string with
its earliest document. Where an anchor has one string, the earliest document of the string is that
of each of its windows. Where it has several, the strings of a shard are concatenated and sorted by
linear grouping construction (see suffix.py); windows that begin equally stand side by side in the
suffix order, are compared byte by byte, and get the earliest document of their run. Documents later
than a window's earliest one lose its bytes.

Rows between steps are arrays packed by anchor or by document, so hot groups cost bytes, not tasks.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; a null id sorts first and its
rows remove nothing from each other, nor do rows that repeat an id; equal windows within one document
only do not count; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import _P, _P_INV, arrow_map, documents, mix64, shared_dir, stash
from orecart.llm.linededup import keyed, text_buffer
from orecart.llm.suffix import suffix_array

LENGTH, PIECE = 50, 25
#: Bits of a cell, by which anchors are counted, and of the bitmap, for GROWTH bytes of different texts; each doubling adds a bit.
CELL_BITS, MAP_BITS, GROWTH = 34, 27, 1 << 30
#: Most bits of a cell and of the bitmap; bits of the bitmap of first texts, and of its parts.
MOST_CELL_BITS, MOST_MAP_BITS, TEXT_BITS, TEXT_PARTS = 40, 29, 27, 6
#: Bytes of concatenated contexts sorted at once.
SORT_BYTES = 192 << 10
_SLICE = 1 << 18
_U = np.uint64
_POS = _U((1 << 24) - 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    return np.minimum(x[: -(width - have)], x[width - have :]) if have < width else x


class Contexts:
    """Contexts of some rows: row, start within the row's text, windows, anchor offset, anchor and context digests."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, first_row: int, skip: int = 0) -> None:
        n = len(buf)
        self.buf = buf
        self.row = self.lo = self.windows = self.offset = np.zeros(0, np.int64)
        self.anchor = self.form = np.zeros(0, _U)
        if n < LENGTH:
            return
        with np.errstate(over="ignore"):
            power, back = np.full(n + 1, _P, _U), np.full(n + 1, _P_INV, _U)
            power[0] = back[0] = 1
            np.multiply.accumulate(power, out=power)
            np.multiply.accumulate(back, out=back)
            prefix = np.zeros(n + 1, _U)
            np.cumsum((buf.astype(_U) + _U(1)) * power[:-1], out=prefix[1:])
            piece = mix64((prefix[PIECE:] - prefix[:-PIECE]) * back[: n - PIECE + 1])
            least = (_least((piece & ~_POS) | np.arange(len(piece), dtype=_U), LENGTH - PIECE + 1) & _POS).astype(np.int64)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(least)]
            start = np.flatnonzero(np.arange(len(least)) + LENGTH <= at[1:][doc])
            if not len(start):
                return
            anchor, doc = least[start], doc[start]
            cut = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
            lo, hi = start[cut], np.append(start[cut[1:] - 1], start[-1])
            anchor, doc = anchor[cut], doc[cut]
            self.at, self.row, self.lo = lo, first_row + doc, lo - at[:-1][doc] + skip
            # Mixed once more: a least hash is small, and its leading bits would deal out unevenly.
            self.windows, self.offset, self.anchor = hi - lo + 1, anchor - lo, mix64(piece[anchor] ^ _U(_P))
            self.form = mix64((prefix[hi + LENGTH] - prefix[lo]) * back[lo] + self.offset.astype(_U) * _U(0xC4CEB9FE1A85EC53) + self.windows.astype(_U))

    def text(self, k: int) -> bytes:
        return self.buf[self.at[k] : self.at[k] + self.windows[k] + LENGTH - 1].tobytes()


def contexts_of(column: pa.Array, most: int = _SLICE, piecewise: int = 8 << 20) -> Iterator[Contexts]:
    data, offsets = text_buffer(column)
    offsets = offsets.astype(np.int64)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        size = offsets[hi] - offsets[lo]
        if size <= piecewise:
            yield Contexts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        else:  # one long text: pieces that overlap by a window less a byte
            for skip in range(0, size, piecewise):
                part = data[offsets[lo] + skip : min(offsets[hi], offsets[lo] + skip + piecewise + LENGTH - 1)]
                yield Contexts(part, np.array([0, len(part)]), lo, skip)
        lo = hi


def _by_part(part: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    arrays = [x[order] for x in arrays]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(part[a]), pickle.dumps([x[a:b] for x in arrays], 5)


def _rows(parts: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in parts], pa.string()), pa.array([p for _, p, _ in parts], pa.int32()), pa.array([x for _, _, x in parts], pa.binary())], ["kind", "part", "packed"])


_SCHEMA = "kind string, part int, packed binary"


def _bits(marked: np.ndarray, part: int, parts_log: int, map_bits: int) -> bytes:
    """A part's slice of the bitmap: the leading bits of an anchor tell both."""
    width = 1 << (map_bits - parts_log)
    flags = np.zeros(width, bool)
    flags[(marked - part * width).astype(np.int64)] = True
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _collect_bitmap(rows: DataFrame, map_bits: int) -> np.ndarray:
    """2**map_bits bits."""
    out = np.zeros((1 << map_bits) // 8, np.uint8)
    for part, packed in rows.where("kind = 'bits'").select("part", "packed").collect():
        got = np.frombuffer(zlib.decompress(packed), np.uint8)
        out[part * len(got) : (part + 1) * len(got)] = got
    return out


def _hit(bitmap: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    bit = (anchor >> _U(64 - (len(bitmap).bit_length() + 2))).astype(np.int64)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def _forget(spark: SparkSession) -> None:
    """Let the files of finished shuffles go: Spark deletes them once the driver's JVM has collected what names them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def first_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Slices of a bitmap over `own` of the first row of every text, on shared storage, and the bytes of different texts."""
    groups = docs.groupBy("th", "n").agg(F.min("id").alias("id")).select(F.xxhash64("id", "th", "n").alias("own"), F.col("n").cast("long").alias("n"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(_U)
            yield _rows([("own", p, x) for p, x in _by_part((own >> _U(64 - TEXT_PARTS)).astype(np.int64), [own, batch.column(1).to_numpy()])])

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        own, n = _join_packed(list(group["packed"]))
        bits = _bits(own >> _U(64 - TEXT_BITS), part, TEXT_PARTS, TEXT_BITS)
        return pd.DataFrame({"kind": ["bits", "bytes"], "part": [part, part], "packed": [bits, str(int(n.sum())).encode()]})

    rows = stash(arrow_map(groups, pack, _SCHEMA, 1 << 16).groupBy("part").applyInPandas(mark, _SCHEMA), shared_dir(docs.sparkSession))
    return rows, sum(int(x.packed) for x in rows.where("kind = 'bytes'").collect())


def _spans(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, size: np.ndarray, parts: int) -> list[tuple[str, int, bytes]]:
    part = (mix64(doc.view(_U) ^ mix64(th.view(_U))) % _U(parts)).astype(np.int64)
    return [("span", p, x) for p, x in _by_part(part, [doc, th, lo.astype(np.uint32), size.astype(np.int32)])]


def _join_packed(packed: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*(pickle.loads(p) for p in packed), strict=True)]


def _runs_by_sorting(texts: list[bytes], windows: np.ndarray) -> np.ndarray:
    """Numbers of the windows of all texts, equal for equal windows only: places in the order of the suffixes they begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()) + LENGTH, np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)] = flat
    owner = np.repeat(np.arange(len(texts)), windows)
    at = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(symbols), -1, np.int64)
    number[at] = np.arange(len(at))
    ordered = number[suffix_array(symbols[: len(symbols) - LENGTH])]
    ordered = ordered[ordered >= 0]
    view = np.lib.stride_tricks.sliding_window_view(symbols, LENGTH)
    place = at[ordered]
    opens = np.ones(len(place), bool)
    for lo in range(1, len(place), 1 << 15):
        opens[lo : lo + (1 << 15)] = (view[place[lo : lo + (1 << 15)]] != view[place[lo - 1 : lo - 1 + len(place[lo : lo + (1 << 15)])]]).any(axis=1)
    out = np.empty(len(place), np.int64)
    out[ordered] = np.cumsum(opens) - 1
    return out


def _least_of_equal(texts: list[bytes], windows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every window of the texts, the least `first` (given per text) of the texts that hold an equal one."""
    run = _runs_by_sorting(texts, windows)
    least = np.full(len(run), np.iinfo(np.int64).max)
    np.minimum.at(least, run, np.repeat(first, windows))
    return least[run]


def _least_of_copies(windows: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """The same for rows of LENGTH bytes with one digest: sorted in bounded runs, whose distinct windows meet in the next round."""
    step = max(2, most // (LENGTH + 1))
    run, rows = np.empty(len(windows), np.int64), []
    for lo in range(0, len(windows), step):
        part = windows[lo : lo + step]
        own = _runs_by_sorting([x.tobytes() for x in part], np.ones(len(part), np.int64))
        run[lo : lo + step] = own + len(rows)
        rows.extend((lo + np.unique(own, return_index=True)[1]).tolist())
    least = np.full(len(rows), np.iinfo(np.int64).max)
    np.minimum.at(least, run, first)
    if len(windows) > step and len(rows) < len(windows):
        least = _least_of_copies(windows[rows], least, most)
    return least[run]


def earliest_by_sorting(texts: list[bytes], windows: np.ndarray, first: np.ndarray, group: np.ndarray | None = None, most: int = SORT_BYTES) -> list[np.ndarray]:
    """For the windows of every text, the least `first` of any text that holds the same window.

    Equal windows lie in texts of one group (an anchor). A window whose digest stands once has no
    equal; only the stretches between a text's first and last window with a repeated digest are sorted,
    equal stretches once.
    """
    group = np.zeros(len(texts), np.int64) if group is None else group
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    base = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), windows)
    at = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    digest = _window_digests(flat)[at]
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    again = np.zeros(len(owner), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    out = first[owner].copy()
    marked = np.flatnonzero(again)
    if len(marked):
        opens = np.append(True, owner[marked][1:] != owner[marked][:-1])
        text, lo = owner[marked][opens], marked[opens]
        hi = marked[np.append(np.flatnonzero(opens)[1:], len(marked)) - 1]
        # Contexts at the rim of a shared passage differ outside it only: cut to the stretch, most are equal.
        known: dict[tuple[int, bytes], int] = {}
        number = np.array([known.setdefault((g, flat[at[a] : at[b] + LENGTH].tobytes()), len(known)) for g, a, b in zip(group[text].tolist(), lo.tolist(), hi.tolist(), strict=True)])
        own, in_group = [x for _, x in known], np.array([g for g, _ in known])
        width = np.array([len(x) for x in own]) - LENGTH + 1
        least = np.full(len(own), np.iinfo(np.int64).max)
        np.minimum.at(least, number, first[text])
        found, place = np.empty(int(width.sum()), np.int64), np.cumsum(width) - width
        load = np.cumsum(width + LENGTH)
        heads = np.append(np.flatnonzero(np.append(True, in_group[1:] != in_group[:-1])), len(own))
        i = 0
        while i < len(own):  # runs of whole groups of about `most` bytes
            j = int(heads[max(np.searchsorted(heads, i, "right"), np.searchsorted(heads, np.searchsorted(load, load[i] - width[i] - LENGTH + most), "right") - 1)])
            stretch = slice(int(place[i]), int(place[j - 1] + width[j - 1]))
            if load[j - 1] - load[i] <= 2 * most:
                found[stretch] = _least_of_equal(own[i:j], width[i:j], least[i:j])
            else:  # one large group: single windows, in runs of whole digests
                joined = np.frombuffer(b"".join(own[i:j]), np.uint8)
                size = width[i:j] + LENGTH - 1
                spot = np.repeat(np.cumsum(size) - size, width[i:j]) + np.arange(int(width[i:j].sum())) - np.repeat(np.cumsum(width[i:j]) - width[i:j], width[i:j])
                view, keys, held = np.lib.stride_tricks.sliding_window_view(joined, LENGTH), _window_digests(joined)[spot], np.repeat(least[i:j], width[i:j])
                rank = np.argsort(keys, kind="stable")
                cut = np.append(np.flatnonzero(np.append(True, keys[rank][1:] != keys[rank][:-1])), len(rank))
                a = 0
                while a < len(rank):
                    b = int(cut[max(np.searchsorted(cut, a, "right"), np.searchsorted(cut, a + most // (LENGTH + 1), "right") - 1)])
                    held[rank[a:b]] = _least_of_copies(view[spot[rank[a:b]]], held[rank[a:b]], most)
                    a = b
                found[stretch] = held
            i = j
        n = hi - lo + 1
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(lo, n) + step] = found[np.repeat(place[number], n) + step]
    return np.split(out, np.cumsum(windows)[:-1])


def _window_digests(flat: np.ndarray) -> np.ndarray:
    """64-bit digests of the LENGTH bytes from every place."""
    with np.errstate(over="ignore"):
        power, back = np.full(len(flat) + 1, _P, _U), np.full(len(flat) + 1, _P_INV, _U)
        power[0] = back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(back, out=back)
        prefix = np.zeros(len(flat) + 1, _U)
        np.cumsum((flat.astype(_U) + _U(1)) * power[:-1], out=prefix[1:])
        return mix64((prefix[LENGTH:] - prefix[:-LENGTH]) * back[: len(flat) - LENGTH + 1])


def covered(docs: DataFrame) -> DataFrame:
    """(id, th, spans): start and stop of the removed runs as packed int64 pairs, for rows that lose bytes."""
    order, digest = keyed(docs)
    spark = docs.sparkSession
    named = docs.select(order.alias("id"), digest.alias("th"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), "text")
    source = named.select("id", "th", "text", F.xxhash64("id", "th", "n").alias("own"))
    marked_texts, size = first_texts(named)
    texts = spark.sparkContext.broadcast(_collect_bitmap(marked_texts, TEXT_BITS))
    doublings = max(0, (size - 1) // GROWTH).bit_length()
    cell_bits, map_bits = min(MOST_CELL_BITS, CELL_BITS + doublings), min(MOST_MAP_BITS, MAP_BITS + doublings)
    parts_log = max(6, min(16, max(2 * max(1, source.rdd.getNumPartitions()) - 1, size >> 24).bit_length()))
    parts = 1 << parts_log

    def firsts(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Without rows whose text stands in an earlier one; a few copies may stay."""
        return batch.filter(pa.array(_hit(texts.value, batch.column(3).to_numpy().view(_U))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            cells = np.sort(np.concatenate(held)) if held else np.zeros(0, _U)
            cell, opens = cells >> _U(1), np.ones(len(cells), bool)
            opens[1:] = cell[1:] != cell[:-1]
            many = np.bitwise_or.reduceat(cells & _U(1), np.flatnonzero(opens)) | (np.diff(np.append(np.flatnonzero(opens), len(cells))) > 1).astype(_U) if len(cells) else cells
            return (cell[opens] << _U(1)) | many

        def pack(cells: np.ndarray) -> pa.RecordBatch:
            part = (cells >> _U(1 + cell_bits - parts_log)).astype(np.int64)
            cut = np.searchsorted(part, np.arange(parts + 1))
            return _rows([("cells", p, zlib.compress(np.diff(cells[a:b], prepend=_U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)) for p, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

        for batch in batches:
            for own in contexts_of(firsts(batch).column(2)):
                each = np.unique(((own.anchor >> _U(64 - cell_bits)) << _U(20)) | (own.row - (own.row[0] if len(own.row) else 0)).astype(_U))
                cell, n = np.unique(each >> _U(20), return_counts=True)
                held.append((cell << _U(1)) | (n > 1).astype(_U))
            if sum(map(len, held)) > 1_000_000:
                held[:] = [merged()]
                if len(held[0]) > 500_000:
                    yield pack(held.pop())
        yield pack(merged())

    def shared(group: pd.DataFrame) -> pd.DataFrame:
        part, cells = int(group["part"].iloc[0]), []
        for x in group["packed"]:
            raw = np.frombuffer(zlib.decompress(x), np.uint8)
            cells.append(np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=_U))
        cells = np.sort(np.concatenate(cells))
        cell = cells >> _U(1)
        same = np.append(cell[1:] == cell[:-1], False)
        marked = cell[same | (cells & _U(1) == 1)] >> _U(cell_bits - map_bits)
        return pd.DataFrame({"kind": ["bits"], "part": [part], "packed": [_bits(marked, part, parts_log, map_bits)]})

    repeated = spark.sparkContext.broadcast(_collect_bitmap(arrow_map(source, count, _SCHEMA, 128).groupBy("part").applyInPandas(shared, _SCHEMA), map_bits))
    _forget(spark)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, held, copies, n_copies = repeated.value, [], [], 0

        def pack() -> pa.RecordBatch:
            arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return _rows([("place", p, x) for p, x in _by_part((arrays[0] >> _U(64 - parts_log)).astype(np.int64), arrays)])

        def whole() -> pa.RecordBatch:
            doc, th, n = (np.concatenate(x) for x in zip(*copies, strict=True))
            copies.clear()
            return _rows(_spans(doc, th, np.zeros(len(doc), np.int64), n, parts))

        for batch in batches:
            n = np.diff(text_buffer(batch.column(2))[1])
            gone = ~_hit(texts.value, batch.column(3).to_numpy().view(_U)) & (n >= LENGTH)
            if gone.any():
                copies.append((batch.column(0).to_numpy()[gone], batch.column(1).to_numpy()[gone], n[gone]))
                n_copies += int(gone.sum())
                if n_copies > 200_000:
                    yield whole()
                    n_copies = 0
            batch = firsts(batch)
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own in contexts_of(batch.column(2)):
                take = np.flatnonzero(_hit(bitmap, own.anchor))
                row = own.row[take]
                held.append((own.anchor[take], own.form[take], ids[row], ths[row], own.lo[take].astype(np.uint32), own.windows[take].astype(np.uint8)))
            if sum(len(x[0]) for x in held) > max(120_000, min(1 << 20, 256 << parts_log)):
                yield pack()
        if held:
            yield pack()
        if copies:
            yield whole()

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        part, whole = int(group["part"].iloc[0]), group[group["kind"] == "span"]
        if len(whole) == len(group):
            return whole
        arrays = _join_packed(list(group.loc[group["kind"] == "place", "packed"]))
        rank = np.lexsort((arrays[1], arrays[0]))
        anchor, form, doc, th, lo, windows = (x[rank] for x in arrays)
        opens = np.append(True, anchor[1:] != anchor[:-1])
        inner = opens | np.append(True, form[1:] != form[:-1])
        a, f = np.flatnonzero(opens), np.flatnonzero(inner)
        of_anchor, of_form = np.cumsum(opens) - 1, np.cumsum(inner) - 1
        least = np.minimum.reduceat(doc, f)[of_form]
        several = (np.minimum.reduceat(doc, a) != np.maximum.reduceat(doc, a))[of_anchor]
        forms = np.add.reduceat(inner.astype(np.int64), a)[of_anchor]
        gone = several & (forms == 1) & (doc > least)
        out = _spans(doc[gone], th[gone], lo[gone], windows[gone].astype(np.int64) + LENGTH - 1, parts)
        open_ = several & (forms > 1)
        if open_.any():
            out.append(("place", part, pickle.dumps([x[open_] for x in (anchor, form, doc, th, lo, windows)], 5)))
            out.append(("bits", part, _bits(np.unique(anchor[open_]) >> _U(64 - map_bits), part, parts_log, map_bits)))
        out.extend(whole.itertuples(index=False, name=None))
        return pd.DataFrame(out, columns=["kind", "part", "packed"])

    resolved = stash(arrow_map(source, places, _SCHEMA, 128).groupBy("part").applyInPandas(resolve, _SCHEMA))
    repeated.unpersist()
    _forget(spark)
    several = spark.sparkContext.broadcast(_collect_bitmap(resolved, map_bits))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen, held, size = several.value, set(), [], 0

        def pack() -> pa.RecordBatch:
            by: dict[int, list[tuple[int, bytes]]] = {}
            for a, f, text in held:
                by.setdefault(a >> (64 - parts_log), []).append((f, text))
            held.clear()
            return _rows([("string", p, pickle.dumps(x, 5)) for p, x in by.items()])

        for batch in batches:
            for own in contexts_of(firsts(batch).column(2)):
                for k in np.flatnonzero(_hit(bitmap, own.anchor)).tolist():
                    f = int(own.form[k])
                    if f not in seen:
                        if len(seen) > 200_000:  # a context that recurs is sent again once in a while
                            seen.clear()
                        seen.add(f)
                        held.append((int(own.anchor[k]), f, own.text(k)))
            if len(held) > 30_000:
                yield pack()
        if held:
            yield pack()

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        is_place = group["kind"] == "place"
        if not is_place.any():
            return pd.DataFrame({"kind": pd.Series(dtype=str), "part": pd.Series(dtype="int32"), "packed": pd.Series(dtype=object)})
        anchor, form, doc, th, lo, windows = _join_packed(list(group.loc[is_place, "packed"]))
        text = dict(x for p in group.loc[~is_place, "packed"] for x in pickle.loads(p))
        rank = np.lexsort((form, anchor))
        anchor, form, doc, th, lo, windows = (x[rank] for x in (anchor, form, doc, th, lo, windows))
        f = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (form[1:] != form[:-1])))
        of_form = np.repeat(np.arange(len(f)), np.diff(np.append(f, len(form))))
        first, width = np.minimum.reduceat(doc, f), windows[f].astype(np.int64)
        texts = [text[x] for x in form[f].tolist()]
        change = np.append(True, anchor[f][1:] != anchor[f][:-1])
        earliest = earliest_by_sorting(texts, width, first, np.cumsum(change))
        flat, base = np.concatenate(earliest), np.cumsum(width) - width
        out = []
        for a in range(0, len(doc), 1 << 18):
            part = slice(a, a + (1 << 18))
            n = width[of_form[part]]
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            gone = flat[base[of_form[part]][row] + step] < doc[part][row]
            row, step = row[gone], step[gone]
            if not len(row):
                continue
            opens = np.append(True, (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1))
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:] - 1, len(row) - 1)
            r = row[starts]
            out.extend(_spans(doc[part][r], th[part][r], lo[part][r] + step[starts], step[ends] - step[starts] + LENGTH, parts))
        return pd.DataFrame(out, columns=["kind", "part", "packed"])

    given = resolved.where("kind = 'place'").union(arrow_map(source, strings, _SCHEMA, 128))
    sorted_spans = given.groupBy("part").applyInPandas(sort, _SCHEMA)
    spans = resolved.where("kind = 'span'").union(sorted_spans)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        doc, th, lo, size = _join_packed(list(group["packed"]))
        lo = lo.astype(np.int64)
        rank = np.lexsort((lo, th, doc))
        doc, th, lo, size = doc[rank], th[rank], lo[rank], size[rank]
        opens = np.append(True, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]))
        number = np.cumsum(opens) - 1
        start, stop = (number << 40) + lo, (number << 40) + lo + size
        reach = np.maximum.accumulate(stop)
        heads = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
        tails = np.append(heads[1:] - 1, len(start) - 1)
        pairs = np.stack((start[heads], reach[tails]), axis=1) & ((1 << 40) - 1)
        of = number[heads]
        cut = np.searchsorted(of, np.arange(number[-1] + 2))
        docs_at = np.flatnonzero(opens)
        return pd.DataFrame({"id": doc[docs_at], "th": th[docs_at], "spans": [pairs[a:b].astype("<i8").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]})

    return spans.groupBy("part").applyInPandas(merge, "id long, th long, spans binary")


def strip(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes)."""
    order, digest = keyed(docs)
    gone = stash(covered(docs), shared_dir(docs.sparkSession)).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "spans").hint("shuffle_hash")
    _forget(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order.alias("__a"), digest.alias("__b"))
    joined = rows.join(gone, (F.col("__a") == F.col("__id")) & (F.col("__b") == F.col("__th")), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            out: list[tuple[int, int, int, str, bytes]] = []
            for k, packed in enumerate(batch.column(2).to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]]
                pairs = np.frombuffer(packed, "<i8").reshape(-1, 2) if packed else np.zeros((0, 2), np.int64)
                kept, at = hashlib.sha256(), 0
                pieces = []
                for a, b in [*pairs.tolist(), [len(raw), len(raw)]]:
                    pieces.append(raw[at:a].tobytes())
                    at = b
                for x in pieces:
                    kept.update(x)
                out.append((len(raw), int((pairs[:, 1] - pairs[:, 0]).sum()), len(pairs), kept.hexdigest(), b"".join(pieces) if with_text else b""))
            arrays = [batch.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays.append(pa.array([x[4] for x in out], pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return arrow_map(joined, cut, schema, 128)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip(documents(spark, sf_dir))
