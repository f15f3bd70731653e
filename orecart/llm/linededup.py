"""Line deduplication by an exact set-similarity join.

A line is the set of its words (ASCII lower case, split at ASCII white space). A line goes if an
earlier line, in the order of (doc_id, line number), has a Jaccard similarity of THRESHOLD or more;
equal sets have similarity 1. Words are told apart by 64-bit hashes, sets by a 64-bit sum of them.
Steps:

1. One pass notes every line with the key of its set and counts words in hashed cells; the cells'
   rarity classes, a table of fixed size, give the global order of words: rare first.
2. A second pass sends the prefix of every distinct line, rare words first: the n - ceil(t n) + 1
   words of which a similar line must share one, with the set's size, the word's position and a
   128-bit parity bitmap. Rows travel packed by hash of the word; a word that may be very frequent is
   dealt over several salts by hash of the line.
3. Rows of a word are sorted by size. A row meets only those longer rows that the length filter and
   its own position leave in reach, one range of the order; position and bitmap of the other row are
   tested next (the Hamming distance of parity bitmaps never exceeds the symmetric difference).
   Every later line gives its closest earlier candidates of each word.
4. Jaccard is verified on the candidates' words themselves: first for a line's one closest candidate
   of all, then for its others. Lines without a match that have still more candidates, or a salted
   word, are open: they alone go on, against all rows of their words in every salt, with ever more
   candidates, until none is open. A family of variants is so closed by its first tries and never
   expands into pairs.
5. Later occurrences of equal sets and verified later lines are removed from their documents.

Defined cases: a line without words (blank, or of a null text) is never removed; a null id sorts
first; rows that repeat an id share its place in the order and do not remove each other's line of the
same number; a text that loses all lines becomes empty; extra columns stay, except that columns named
n_lines and n_removed are replaced; an empty table stays empty.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents, mix64, stash

THRESHOLD = 0.8
#: Candidates of a line and word in the first round; each further round takes WIDER times as many.
TRIES, WIDER = 1, 64
#: Occurrences of a word's cell up to which its lines meet in one place; rows of a part, about.
SALT_ROWS = 1 << 15
PART_ROWS = 150_000
BITMAP = 1 << 24
_U = np.uint64
_FIRST_ID = -(2**63)
_SLICE = 1 << 18
_CLASS = 1.5  # rarity classes to a doubling of the count
_BELOW = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column (null: empty), without copying."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII lower case, with eight more bytes at the end."""
    out = np.zeros(len(data) + 8, np.uint8)
    np.add(data, ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=out[: len(data)])
    return out


def word_hashes(padded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of padded[start:end], eight bytes at a time."""
    view = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    left = end - start
    with np.errstate(over="ignore"):
        h = mix64((view[start] & _BELOW[np.minimum(left, 8)]) + left.astype(_U) * _U(0x9E3779B97F4A7C15))
        at = np.flatnonzero(left > 8)
        for k in range(8, 64, 8):
            if not len(at):
                break
            h[at] = mix64((h[at] ^ (view[start[at] + k] & _BELOW[np.minimum(left[at] - k, 8)])) * _U(0xC4CEB9FE1A85EC53) + _U(k))
            at = at[left[at] > k + 8]
        if len(at):
            from xxhash import xxh3_64_intdigest

            h[at] = [xxh3_64_intdigest(padded[a:b].tobytes()) for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
    return h


class Lines:
    """Word sets of the lines (with words) of some rows, words in prefix order where rank gives cells' classes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first_row: int, rank: np.ndarray | None) -> None:
        full = np.flatnonzero(np.diff(at))
        starts, stops = at[:-1][full], at[1:][full]
        buf = lowered(data)
        low = buf[: len(data)]
        word = ~((low == 32) | ((low - np.uint8(9)) < 5))
        opens, closes = word.copy(), word.copy()
        opens[1:] &= ~word[:-1]
        opens[starts] |= word[starts]
        closes[:-1] &= ~word[1:]
        closes[stops - 1] |= word[stops - 1]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        breaks = np.flatnonzero(low == 10)
        before = np.cumsum(np.bincount(np.searchsorted(a, breaks), minlength=len(a) + 1))[: len(a)]
        doc = np.cumsum(np.bincount(np.searchsorted(a, starts), minlength=len(a) + 1))[: len(a)] - 1
        change = np.append(True, np.diff(before + doc) != 0)[: len(a)]
        lead = np.flatnonzero(change)  # a line's first word
        self.hash = word_hashes(buf, a, b)
        line, h = self._distinct(np.cumsum(change) - 1, self.hash, rank)
        self.line, self.token, lines = line, h, len(lead)
        self.first = np.searchsorted(line, np.arange(lines))
        self.n = np.diff(np.append(self.first, len(line)))
        with np.errstate(over="ignore"):
            mixed = mix64(h + _U(1))
            self.key = (np.add.reduceat(mixed, self.first) if lines else np.zeros(0, _U)) ^ self.n.astype(_U)
        self.bits, self.bits2 = parity(mixed, self.first)
        self.row = first_row + full[doc[lead]]
        self.number = before[lead] - np.searchsorted(breaks, starts)[doc[lead]]

    @staticmethod
    def _distinct(line: np.ndarray, h: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of every line, by line, class and hash."""
        place = np.zeros(len(h), _U) if rank is None else rank[(h >> _U(64 - _log2(len(rank)))).astype(np.int64)].astype(_U)
        if len(h) <= _SLICE:  # one sort of packed numbers; where 22 bits of two words of a line are alike, the other way
            packed = (line.astype(_U) << _U(46)) | (place << _U(40)) | (h >> _U(42) << _U(18)) | np.arange(len(h), dtype=_U)
            packed.sort()
            order = (packed & _U((1 << 18) - 1)).astype(np.int64)
            packed >>= _U(18)
            sorted_h = h[order]
            same = packed[1:] == packed[:-1]
            new = np.append(True, ~same)[: len(h)]
            if not (same & (sorted_h[1:] != sorted_h[:-1])).any():
                return line[order][new], sorted_h[new]
        order = np.lexsort((h, place, line))
        line, h = line[order], h[order]
        new = np.append(True, (line[1:] != line[:-1]) | (h[1:] != h[:-1]))[: len(h)]
        return line[new], h[new]


def parity(mixed: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit map per set of hashes: a bit is 1 where an odd number of them falls."""
    if not len(first):
        return np.zeros(0, _U), np.zeros(0, _U)
    at = mixed >> _U(57)
    one, low = _U(1) << (at & _U(63)), at < 64
    return np.bitwise_xor.reduceat(one * low, first), np.bitwise_xor.reduceat(one * ~low, first)


def _log2(size: int) -> int:
    return size.bit_length() - 1


def _slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def lines_of(column: pa.Array, rank: np.ndarray | None = None, most: int = _SLICE) -> Iterator[Lines]:
    data, offsets = text_buffer(column)
    for lo, hi in _slices(offsets, most):
        yield Lines(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1].astype(np.int64) - offsets[lo], lo, rank)


def raw_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, then row, number, start and end of every line of every row."""
    data, offsets = text_buffer(column)
    offsets = offsets.astype(np.int64)
    breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
    per = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    row = np.repeat(np.arange(len(per)), per)
    number = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = np.empty(len(row), np.int64)
    start[number == 0] = offsets[:-1]
    start[number > 0] = breaks + 1
    end = np.empty(len(row), np.int64)
    last = np.append(number[1:] == 0, True)[: len(row)]
    end[last] = offsets[1:]
    end[~last] = breaks
    return data, row, number, start, end


def least_overlap(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def similar(x: set[bytes], y: set[bytes], threshold: float) -> bool:
    both = len(x & y)
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def planes(x: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane: the constant high bytes cost nothing once compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


#: A prefix row: word, key's low half, parity bitmap, id and line of the set's place, set size, position, rarity class, the bitmap's other half.
_PACK = ("<u4", "<u4", "<u8", "<i8", "<i4", "<u4", "<u2", "u1", "<u8")


def _packed(rows: list[np.ndarray]) -> bytes:
    return pickle.dumps([planes(x) for x in rows], 5)


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    parts = [[unplaned(x, kind) for x, kind in zip(pickle.loads(p), _PACK, strict=True)] for p in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, kind) for kind in _PACK]


class Join:
    """What the tasks know of the whole input: threshold, classes of the cells, number of parts."""

    def __init__(self, rank: np.ndarray, words: float, threshold: float, salt_rows: int, part_rows: int) -> None:
        self.rank, self.threshold, self.part_rows = rank, threshold, part_rows
        self.parts = int(max(64, (1 - threshold) * words / part_rows))
        limit = max(salt_rows, 64 * words / len(rank))
        most = np.exp2((np.arange(64) + 1) / _CLASS)
        self.salts = np.minimum(np.ceil(most / limit), 4096).astype(np.int64)  # by class

    def part(self, word: np.ndarray, salt: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(word.astype(_U) + (salt.astype(_U) << _U(32)) + _U(1)) % _U(self.parts)).astype(np.int32)

    def dealt(self, rows: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """Rows packed by part; a row's own salt comes from its key."""
        salts = self.salts[rows[7]]
        yield from by_part(self.part(rows[0], rows[1] % salts), rows)

    def prefixes(self, own: Lines, ids: np.ndarray, fresh: np.ndarray) -> list[np.ndarray]:
        n = own.n
        size = n - np.ceil(self.threshold * n - 1e-9).astype(np.int64) + 1
        i = np.arange(len(own.line)) - own.first[own.line]
        take = fresh[own.line] & (i < size[own.line])
        at, h = own.line[take], own.token[take]
        cls = self.rank[(h >> _U(64 - _log2(len(self.rank)))).astype(np.int64)]
        return [(mix64(h) >> _U(32)).astype("<u4"), own.key[at].astype("<u4"), own.bits[at], ids[own.row[at]], own.number[at].astype("<i4"), n[at].astype("<u4"), np.minimum(i[take], 65535).astype("<u2"), cls, own.bits2[at]]


def by_part(part: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    part, rows = part[order], [x[order] for x in rows]
    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(part[a]), _packed([x[a:b] for x in rows])


def distinct_rows(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Sorted by word and size; a set that was sent from several places keeps its earliest."""
    word, key, bits, doc, line, n = rows[:6]
    place = (word.astype(_U) << _U(32)) | n.astype(_U)
    order = np.argsort(place)
    same = place[order][1:] == place[order][:-1]
    tied = np.flatnonzero(np.append(False, same)[: len(order)] | np.append(same, False)[: len(order)])
    among = order[tied]  # only rows alike in both need the other columns
    order[tied] = among[np.lexsort((line[among], doc[among], bits[among], key[among], place[among]))]
    rows = [x[order] for x in rows]
    word, key, bits, _, _, n = rows[:6]
    new = np.append(True, (word[1:] != word[:-1]) | (n[1:] != n[:-1]) | (key[1:] != key[:-1]) | (bits[1:] != bits[:-1]))[: len(word)]
    return [x[new] for x in rows]


def candidates(base: list[np.ndarray], threshold: float, tries: int, probes: list[np.ndarray] | None = None, label: np.ndarray | None = None, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (later, earlier) and distance of the `tries` closest earlier candidates of every later row, and its number of candidates.

    base is as distinct_rows() gives it. Without probes its rows meet each other, those of one label
    not; with probes, each of those is a later row and meets the rows of base.
    """
    word, _, bits, doc, line, n, position, _, wide = base
    n, position = n.astype(np.int64), position.astype(np.int64)
    place = (word.astype(np.int64) << 31) + np.minimum(n, 2**31 - 1)
    spare = (1 + threshold) / threshold
    if probes is None:
        w2, bits2, doc2, line2, n2, position2, wide2 = word, bits, doc, line, n, position, wide
    else:
        w2, _, bits2, doc2, line2, n2, position2, _, wide2 = probes
        n2, position2 = n2.astype(np.int64), position2.astype(np.int64)
    reach = np.minimum(np.floor((n2 - position2) * spare + 1e-9).astype(np.int64) - n2, np.floor(n2 / threshold + 1e-9).astype(np.int64))
    top = np.searchsorted(place, (w2.astype(np.int64) << 31) + np.minimum(np.maximum(reach, 0), 2**31 - 1), "right")
    if probes is None:
        low = np.arange(len(word)) + 1
    else:
        low = np.searchsorted(place, (w2.astype(np.int64) << 31) + np.minimum(np.ceil(threshold * n2 - 1e-9).astype(np.int64), 2**31 - 1), "left")
        own_top = np.searchsorted(place, (w2.astype(np.int64) << 31) + np.minimum(n2, 2**31 - 1), "right")
        top = np.maximum(top, own_top)
    width = np.maximum(0, top - low)
    many = np.zeros(len(n2), np.int64)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def cut() -> None:
        nonlocal size
        a, b, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((line[b], doc[b], h, a))
        a, b, h = a[order], b[order], h[order]
        opens = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
        turn = np.arange(len(a)) - np.repeat(opens, np.diff(np.append(opens, len(a))))
        held[:] = [(a[turn < tries], b[turn < tries], h[turn < tries])]
        size = len(held[0][0])

    ends = np.cumsum(width)
    done, total = 0, int(ends[-1]) if len(ends) else 0
    while done < total:
        stop = min(total, done + block)
        lo, hi = int(np.searchsorted(ends, done, "right")), int(np.searchsorted(ends, stop, "left"))
        rows = np.arange(lo, hi + 1)
        begin = ends[rows] - width[rows]
        a_ = np.maximum(begin, done)
        counts = np.minimum(ends[rows], stop) - a_
        x = np.repeat(rows, counts)
        y = np.arange(done, stop) - np.repeat(begin, counts) + low[x]
        done = stop
        need = least_overlap(n2[x], n[y], threshold)
        fit = (need <= np.minimum(n2[x] - position2[x], n[y] - position[y])) & (np.minimum(n2[x], n[y]) >= need)
        x, y, need = x[fit], y[fit], need[fit]
        far = np.bitwise_count(bits2[x] ^ bits[y]).astype(np.int64) + np.bitwise_count(wide2[x] ^ wide[y])
        fit = far <= n2[x] + n[y] - 2 * need
        x, y, far = x[fit], y[fit], far[fit]
        after = (doc2[x] > doc[y]) | ((doc2[x] == doc[y]) & (line2[x] > line[y]))
        if probes is None:
            apart = (after | (doc[x] != doc[y]) | (line[x] != line[y])) & (True if label is None else label[x] != label[y])
            later, earlier = np.where(after, x, y)[apart], np.where(after, y, x)[apart]
            far = far[apart]
        else:
            later, earlier, far = x[after], y[after], far[after]
        if len(later):
            many += np.bincount(later, minlength=len(many))
            held.append((later, earlier, far))
            size += len(later)
            if size > block:
                cut()
    if not held:
        none = np.zeros(0, np.int64)
        return none, none, none, many
    cut()
    return *held[0], many


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of BITMAP bits from bit numbers, a table of fixed size; a bit too many only sends a line in vain."""
    words = values.select(F.col(column).alias("c")).distinct().groupBy(F.expr("shiftright(c, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 AS int))")).alias("v")).collect()
    out = np.zeros(BITMAP // 64, np.int64)
    for w, v in words:
        out[w] = v
    return out


def _spot(ids: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(mix64(ids.astype(np.int64).view(_U) + _U(1)) + line.astype(_U)) % _U(BITMAP)).astype(np.int64)


def marked(bitmap: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (bitmap[bit >> 6] >> (bit & 63)) & 1 == 1


def keyed(docs: DataFrame) -> tuple[Column, Column]:
    """Order of a row, and a digest that tells rows with one id apart."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)), F.xxhash64("text")


def _noted(source: DataFrame, bits: int) -> DataFrame:
    """(id, th, line, key) of every line with words; rows with line -1 hold counts of words by cell, packed by slice."""
    width = 1 << 14

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held, size = np.zeros(1 << bits, np.int64), [], 0
        names = ["id", "th", "line", "key", "cells"]
        for batch in batches:
            ids, ths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for own in lines_of(batch.column(2)):
                held.append((own.token >> _U(64 - bits)).astype(np.uint32))
                size += len(held[-1])
                if size > 1 << 20:
                    cells += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[own.row]), pa.array(ths[own.row]), pa.array(own.number.astype(np.int32)), pa.array(own.key.view(np.int64)), pa.nulls(len(own.row), pa.binary())], names)
        if held:
            cells += np.bincount(np.concatenate(held), minlength=1 << bits)
        if cells.any():
            parts = cells.reshape(-1, width)
            zero = pa.array(np.zeros(len(parts), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), zero, pa.array(np.full(len(parts), -1, np.int32)), zero, pa.array([zlib.compress(planes(x), 1) for x in parts], pa.binary())], names)

    return stash(arrow_map(source, scan, "id long, th long, line int, key long, cells binary"))


def _classes(noted: DataFrame, bits: int) -> tuple[np.ndarray, float]:
    """Rarity class of every cell, and the number of words."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(unplaned(zlib.decompress(x), "<i8") for x in group["cells"])
        cls = np.minimum(63, np.floor(_CLASS * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"id": [int(group["id"].iloc[0])], "words": [int(total.sum())], "cls": [cls.tobytes()]})

    rank, words = np.zeros(1 << bits, np.uint8), 0
    for at, n, cls in noted.where("line < 0").select("id", "cells").groupBy("id").applyInPandas(add, "id long, words long, cls binary").collect():
        rank[at << 14 : (at + 1) << 14] = np.frombuffer(cls, np.uint8)
        words += n
    return rank, float(words)


def _batch(columns: dict[str, pa.Array], schema: pa.Schema, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)


_FOUND = "part int, rows binary, id long, line int, k int, id2 long, line2 int, k2 int, far int, home int"


def _places(rows: list[np.ndarray], at: np.ndarray, second: str = "") -> dict[str, np.ndarray]:
    return {f"id{second}": rows[3][at], f"line{second}": rows[4][at], f"k{second}": rows[1][at].view(np.int32)}


def _frame(**columns: object) -> pd.DataFrame:
    """Rows of _FOUND: a pair has id2, a part's kept rows have rows, an open line has home."""
    size = max(len(x) for x in columns.values() if hasattr(x, "__len__") and not isinstance(x, bytes))
    kinds = {"part": "Int32", "id": "Int64", "line": "Int32", "k": "Int32", "id2": "Int64", "line2": "Int32", "k2": "Int32", "far": "Int32", "home": "Int32"}
    return pd.DataFrame({name: pd.Series(columns[name] if name in columns else [None] * size, dtype=kind) for name, kind in kinds.items()} | {"rows": pd.Series(columns.get("rows", [None] * size), dtype=object)})[["part", "rows", "id", "line", "k", "id2", "line2", "k2", "far", "home"]]


def matched(source: DataFrame, join: Join, tries: int = TRIES) -> DataFrame:
    """(key) of the sets that have an earlier similar set; source has id, th, text."""
    at = ["id", "line", "k"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        held: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out = list(join.dealt([np.concatenate(x) for x in zip(*held, strict=True)]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["part", "rows"])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for own in lines_of(batch.column(2), join.rank):
                fresh = np.zeros(len(own.key), bool)
                for k, (key, row, line) in enumerate(zip(own.key.tolist(), ids[own.row].tolist(), own.number.tolist(), strict=True)):
                    if key not in seen or (row, line) < seen[key]:
                        fresh[k], seen[key] = True, (row, line)
                if len(seen) > 50_000:  # a set that recurs is sent once in a while, which costs little
                    seen.clear()
                held.append(join.prefixes(own, ids, fresh))
                size += len(held[-1][0])
                if size > 250_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        base = distinct_rows(_unpacked(list(group["rows"])))
        x, y, far, many = candidates(base, join.threshold, tries)
        frames = [_frame(**_places(base, x), **_places(base, y, "2"), far=far).drop_duplicates(ignore_index=True)] if len(x) else []
        # Rows that may still be needed: of words with a line that has more candidates, and of salted words.
        salted = join.salts[base[7]] > 1
        open_ = (many > tries) | salted
        if open_.any():
            stays = np.isin(base[0], np.unique(base[0][open_]))
            frames.append(_frame(part=[part], rows=[_packed([c[stays] for c in base])]))
            frames.append(_frame(home=np.full(int(open_.sum()), part), **_places(base, open_)).drop_duplicates(ignore_index=True))
        return pd.concat(frames) if frames else _frame(part=[])

    found = stash(arrow_map(source, send, "part int, rows binary").groupBy("part").applyInPandas(meet, _FOUND))
    kept = found.where("rows IS NOT NULL").select("part", "rows")
    pairs = found.where("id2 IS NOT NULL").select(*at, "id2", "line2", "k2", "far")
    best = pairs.groupBy(*at).agg(F.min(F.struct("far", "id2", "line2", "k2")).alias("b")).select(*at, "b.id2", "b.line2", "b.k2")
    best = stash(best)
    texts = _texts(source, _ends(pairs))  # of all candidates at once: nearly all belong to a best pair anyway
    keys = stash(_verified(best, texts, join.threshold))
    pairs = pairs.drop("far").join(keys.select(*at), at, "left_anti").join(best, [*at, "id2", "line2", "k2"], "left_anti").distinct()
    open_ = found.where("home IS NOT NULL").select(*at, "home")
    while True:
        open_ = stash(open_.join(keys.select(*at), at, "left_anti"))
        last = not open_.limit(1).count()
        if not last:
            tries *= WIDER
            again = _again(kept, open_, join, tries)
            more = again.where("id2 IS NOT NULL").select(*at, "id2", "line2", "k2")
            missing = stash(_ends(more).join(texts.select(*at), at, "left_anti"))
            if missing.limit(1).count():
                texts = texts.union(_texts(source, missing))
            pairs = pairs.union(more).distinct()
            open_ = again.where("home IS NOT NULL").select(*at, "home").distinct()
        keys = stash(keys.union(_verified(pairs, texts, join.threshold)))
        if last:
            return keys.select("key")
        pairs = pairs.limit(0)


def _again(kept: DataFrame, open_: DataFrame, join: Join, tries: int) -> DataFrame:
    """Open lines against every kept row of their words: _FOUND rows of pairs, and of lines with more candidates than tries."""

    def extract(rows: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        out = {"part": [], "probes": [], "home": []}
        if len(rows) and len(lines):
            base, home = _unpacked(list(rows["rows"])), int(rows["part"].iloc[0])
            wanted = set(zip(lines["id"].tolist(), lines["line"].tolist(), lines["k"].tolist(), strict=True))
            take = np.array([x in wanted for x in zip(base[3].tolist(), base[4].tolist(), base[1].view(np.int32).tolist(), strict=True)])
            probe = [x[take] for x in base]
            times = join.salts[probe[7]]
            at = np.repeat(np.arange(len(times)), times)
            salt = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            for part, blob in by_part(join.part(probe[0][at], salt), [x[at] for x in probe]):
                out["part"].append(part)
                out["probes"].append(blob)
                out["home"].append(home)
        return pd.DataFrame(out).astype({"part": "int32", "home": "int32"})

    def probe(rows: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        frames = []
        if len(rows) and len(probes):
            base = distinct_rows(_unpacked(list(rows["rows"])))
            for home, blob in zip(probes["home"].tolist(), probes["probes"].tolist(), strict=True):
                own = _unpacked([blob])
                x, y, far, many = candidates(base, join.threshold, tries, own)
                if len(x):
                    frames.append(_frame(**_places(own, x), **_places(base, y, "2"), far=far).drop_duplicates(ignore_index=True))
                more = many > tries
                if more.any():
                    frames.append(_frame(home=np.full(int(more.sum()), home), **_places(own, more)).drop_duplicates(ignore_index=True))
        return pd.concat(frames) if frames else _frame(part=[])

    by = kept.groupBy("part")
    probes = by.cogroup(open_.withColumnRenamed("home", "part").groupBy("part")).applyInPandas(extract, "part int, probes binary, home int")
    return stash(by.cogroup(probes.groupBy("part")).applyInPandas(probe, _FOUND))


def _ends(pairs: DataFrame) -> DataFrame:
    """(id, line, k) of the lines of pairs."""
    return pairs.select("id", "line", "k").union(pairs.select("id2", "line2", "k2")).distinct()


def _texts(source: DataFrame, places: DataFrame) -> DataFrame:
    """(id, line, k, key, words) of lines. Bitmaps let only wanted lines leave the scan; one text per place."""
    at = ["id", "line", "k"]

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, line = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_spot(ids, line)), pa.array(_spot(ids, np.zeros(len(ids), np.int64)))], [*at, "spot", "homed"])

    wanted = stash(arrow_map(places, spots, "id long, line int, k int, spot long, homed long"))
    places, homes = bitmap(wanted, "spot"), bitmap(wanted, "homed")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            home = marked(homes, _spot(ids, np.zeros(len(ids), np.int64)))
            if not home.any():
                continue
            chosen = batch.filter(pa.array(home))
            ids = chosen.column(0).to_numpy()
            data, row, number, start, end = raw_lines(chosen.column(1))
            take = np.flatnonzero((end > start) & marked(places, _spot(ids[row], number)))
            row, number = row[take], number[take]
            raw = [data[a:b].tobytes().lower() for a, b in zip(start[take].tolist(), end[take].tolist(), strict=True)]
            for own in lines_of(pa.array(raw, pa.binary())):
                i = own.row
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[i]]), pa.array(number[i].astype(np.int32)), pa.array(own.key.astype(np.uint32).view(np.int32)), pa.array(own.key.view(np.int64)), pa.array([zlib.compress(raw[j], 1) for j in i.tolist()], pa.binary())], [*at, "key", "words"])

    texts = arrow_map(source.select("id", "text"), fetch, "id long, line int, k int, key long, words binary")
    return stash(texts.join(wanted.select(*at), at, "left_semi").groupBy(*at).agg(F.first("key").alias("key"), F.first("words").alias("words")))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(key, id, line, k) of the pairs' later lines whose words are similar to the earlier line's."""
    at = ["id", "line", "k"]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            good = [similar(set(zlib.decompress(p).split()), set(zlib.decompress(q).split()), threshold) for p, q in zip(a, b, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1, 2, 3])

    second = texts.select(F.col("id").alias("id2"), F.col("line").alias("line2"), F.col("k").alias("k2"), F.col("words").alias("words2"))
    joined = pairs.join(texts, at).join(second, ["id2", "line2", "k2"]).select("key", *at, "words", "words2")
    return arrow_map(joined, check, "key long, id long, line int, k int").distinct()


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD, salt_rows: int = SALT_ROWS, part_rows: int = PART_ROWS, tries: int = TRIES) -> DataFrame:
    """(id, th, lines): numbers of the lines to remove, for rows that lose any; id and th as keyed() gives them."""
    order, digest = keyed(docs)
    source = docs.select(order.alias("id"), digest.alias("th"), "text")
    bits = 20 + min(4, max(0, (source.rdd.getNumPartitions() // 128).bit_length()))
    noted = _noted(source, bits)
    lines = noted.where("line >= 0").select("id", "th", "line", "key")
    rank, words = _classes(noted, bits)
    goes = matched(source, Join(rank, words, threshold, salt_rows, part_rows), tries).distinct().withColumn("goes", F.lit(True))
    # Most sets stand once and stay: only lines of the others are sorted by place.
    # The aggregates are written, so that the joins shuffle both sides and a hot line's rows can be split.
    again = stash(lines.groupBy("key").count().where("count > 1").select("key").join(goes, "key", "full_outer"))
    some = stash(lines.join(again.hint("shuffle_hash"), "key"))
    firsts = some.where("goes IS NULL").groupBy("key").agg(F.min(F.struct("id", "line")).alias("place"))
    firsts = stash(firsts)
    later = some.where("goes IS NULL").join(firsts.hint("shuffle_hash"), "key").where(F.struct("id", "line") > F.col("place"))
    gone = some.where("goes").select("id", "th", "line").union(later.select("id", "th", "line"))
    return gone.groupBy("id", "th").agg(F.collect_set("line").alias("lines"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, salt_rows: int = SALT_ROWS, part_rows: int = PART_ROWS, tries: int = TRIES) -> DataFrame:
    """docs with the repeated lines taken out of text, plus n_lines and n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    order, digest = keyed(docs)
    gone = stash(repeated_lines(docs, threshold, salt_rows, part_rows, tries))

    def homed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_spot(ids, np.zeros(len(ids), np.int64)))], ["v"])

    homes = bitmap(arrow_map(gone.select("id"), homed, "v long"), "v")

    @F.pandas_udf("boolean")
    def listed(ids: pd.Series) -> pd.Series:
        return pd.Series(marked(homes, _spot(ids.to_numpy(), np.zeros(len(ids), np.int64))))

    @F.pandas_udf("string")
    def kept(texts: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for text, gone in zip(texts, lines, strict=True):
            if text is not None and gone is not None:
                goes = set(gone.tolist())
                text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in goes)
            out.append(text)
        return pd.Series(out, dtype=object)

    columns, count = docs.columns, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines")
    tagged = docs.withColumns({"__a": order, "__b": digest, "__loses": listed(order)})
    # Only documents that may lose lines are shuffled; the bitmap misses none.
    as_is = tagged.where(~F.col("__loses")).select(*[F.col(f"`{c}`") for c in columns], count, F.lit(0).cast("long").alias("n_removed"))
    named = gone.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("lines").alias("__lines")).hint("shuffle_hash")
    joined = tagged.where("__loses").join(named, (F.col("__a") == F.col("__id")) & (F.col("__b") == F.col("__th")), "left")
    text = kept(F.col("text"), F.col("__lines"))
    return as_is.union(joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns], count, F.coalesce(F.size("__lines"), F.lit(0)).cast("long").alias("n_removed")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
