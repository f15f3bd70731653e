"""Repair of conversations by weighted finite-state composition.

Three machines are composed lazily: the conversation as an input acceptor of row symbols (role initial
and fault), an edit transducer (keep, rerole, delete, at most two insertions between reads, as the
grammar makes a third one useless), and the acceptor of the role grammar `(s?(ua)+)?`. Weights are
pairs (cost, label string), ordered lexicographically; the shortest path is found in reverse
topological order, where prepending a label keeps that order. The string of a weight is held as its
rank among the four grammar states of its level: two candidates of one state are told apart by their
label, or, under one label, by the ranks of their targets. Levels depend on the symbol and on the
weights behind it alone, so each distinct one is composed once and then looked up.

Every conversation streams through one task, in order and twice: first its symbols, which cost a few
bytes a row, then its texts, which are hashed or handed on as they come and never gathered. Spark's
sort does both in spillable memory. Reading a conversation's text in one place is what its digest asks
for; a conversation with a great share of all rows therefore takes one task long, but not much memory.

Defined cases: null conversation ids are one conversation; a null turn sorts first and counts for no
gap; a null role or text is one space; rows of one turn are taken by role and the SHA-256 of their text;
repeated rows stay and are duplicates; a conversation of no rows after damage has zeros, an empty audit
and the digest of nothing; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map

# Fixed values of the contract: costs of the edits, the role grammar and its final states.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FINAL = (0, 3)
WRITTEN = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

#: Faults in the order in which they are looked for.
SOUND, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
MOST_INSERTED = 2
_SPACE = r"\x20\x09-\x0D"
_SPACES = " \t\n\x0b\f\r"

Symbol = tuple[str, int] | None
Behind = tuple[tuple[int, int], ...]
Paths = tuple[tuple[str, tuple[tuple[str, str | None], ...], int], ...]


def edits(symbol: Symbol, inserted: int, state: int) -> Iterator[tuple[str, int, str | None, bool, int]]:
    """Arcs of the composed machine: label, cost, role written (None: as it is or nothing), whether the row is read, grammar state."""
    if symbol is not None:
        initial, fault = symbol
        yield "D", DELETE, None, True, state
        if fault in (SOUND, CUT):
            more = TRUNCATED if fault == CUT else 0
            if initial in GRAMMAR[state]:
                yield "K", more, None, True, GRAMMAR[state][initial]
            for role, to in GRAMMAR[state].items():
                if role in WRITTEN:
                    yield "R", REROLE + more, WRITTEN[role], True, to
    if inserted < MOST_INSERTED:
        for role, to in GRAMMAR[state].items():
            if role in WRITTEN:
                yield "I", INSERT, WRITTEN[role], False, to


@lru_cache(maxsize=65_536)
def level(symbol: Symbol, behind: Behind) -> tuple[int, Behind, Paths]:
    """Weights before a row from those behind it: (cost common to all, weights, per state its labels, edits and next state)."""
    best: list[tuple[int, int]] = []
    paths: list[tuple[str, tuple[tuple[str, str | None], ...], int]] = []
    for inserted in range(MOST_INSERTED, -1, -1):
        found, strings, ways = [], [], []
        for state in GRAMMAR:
            ends = [(0, ("", 0), ("", (), state))] if symbol is None and state in FINAL else []
            for label, cost, role, reads, to in edits(symbol, inserted, state):
                at = behind[to] if reads else best[to]
                rest = ("", (), to) if reads else paths[to]
                ends.append((cost + at[0], (label, at[1]), (label + rest[0], ((label, role), *rest[1]), rest[2])))
            cost, string, way = min(ends, key=lambda e: e[:2]) if ends else (1 << 40, ("~", state), ("", (), state))
            found.append(cost)
            strings.append(string)
            ways.append(way)
        order = sorted(set(strings))
        best, paths = [(c, order.index(s)) for c, s in zip(found, strings, strict=True)], ways
    least = min(c for c, _ in best)
    return least, tuple((c - least, r) for c, r in best), tuple(paths)


def plan(backwards: Iterable[Symbol]) -> tuple[list[Paths], int]:
    """Paths of every level in row order, the last one behind all rows, and the least cost. backwards: the symbols, last row first."""
    total, behind, out = 0, ((0, 0),) * len(GRAMMAR), []
    for symbol in chain((None,), backwards):
        more, behind, paths = level(symbol, behind)
        total += more
        out.append(paths)
    out.reverse()
    return out, total + behind[0][0]


class _Conversation:
    """What one conversation keeps while it streams by: its symbols' numbers, then its levels."""

    def __init__(self, key: int | None) -> None:
        self.key, self.codes, self.faults = key, array("i"), [0, 0, 0, 0]
        self.low = self.high = self.turn = self.levels = None
        self.turns = self.illegal = self.at = self.state = self.written = self.cost = 0
        self.last, self.audit, self.digest = None, [], hashlib.sha256()

    def symbol(self, code: int, initial: str, fault: int, turn: int | None) -> None:
        self.codes.append(code)
        self.faults[fault] += 1
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1

    def begin(self, known: list[tuple[str, int]]) -> None:
        self.levels, self.cost = plan(known[c] for c in reversed(self.codes))
        self.codes = array("i")

    def write(self, role: str = "", text: str = "") -> list[tuple[str, str, str]]:
        """What the next row becomes, as (edit, role, text), or, after the last row, what follows; the digest takes it in."""
        labels, own, self.state = self.levels[self.at][self.state]
        self.at += 1
        self.audit.append(labels)
        out = []
        for label, written in own:
            if label != "D":
                row = (label, written or role, "" if label == "I" else text)
                self.digest.update(f"{chr(10) if self.written else ''}{row[1]}:{row[2]}".encode("utf-8", "surrogatepass"))
                self.written += 1
                out.append(row)
        return out

    def summary(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, place long, edit string, role string, text string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after the contract's damage; dropped ones stay, marked, so that no conversation is lost."""
    seen = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(seen("conv_id"), F.lit(":"), seen("turn")).cast("binary")) % 20
    text = F.when(n == 1, F.lit("")).when(n == 2, F.regexp_replace(seen("text"), "[.!?]", "")).otherwise(seen("text"))
    made = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(n == 4, F.lit("user")).otherwise(seen("role")).alias("role"), text.alias("text"), (n == 0).alias("gone"), F.when(n == 3, 2).otherwise(1).alias("copies"))
    return made.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")


def whole(rows: DataFrame) -> DataFrame:
    """The same columns for rows that are taken as they are."""
    seen = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), seen("role"), seen("text"), F.lit(False).alias("gone"))


def streamed(rows: DataFrame) -> DataFrame:
    """Conversations one after another, each with its symbols first and then its texts, both in row order."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(_SPACES)), -1, 1)
    keyed = rows.withColumn("key", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    again = Window.partitionBy("conv_id", "gone", "role", "key").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(~F.col("text").rlike(f"[^{_SPACE}]"), BLANK).when(F.row_number().over(again) > 1, DUPLICATE).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT)
    found = keyed.repartition("conv_id").withColumn("fault", fault)
    twice = found.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    text: Column = F.when(F.col("pass") == 1, F.col("text"))
    return twice.where("pass = 0 OR NOT gone").sortWithinPartitions(F.asc_nulls_first("conv_id"), "pass", F.asc_nulls_first("turn"), "role", "key", F.col("fault") == DUPLICATE).select("conv_id", "pass", "turn", "gone", "fault", "role", text.alias("text"))


def _conversations(batches: Iterator[pa.RecordBatch], out: list | None) -> Iterator[_Conversation]:
    """Ended conversations; repaired rows go to out, if given, as they come."""
    codes: dict[tuple[str, int], int] = {}
    known: list[tuple[str, int]] = []
    now: _Conversation | None = None

    def close(done: _Conversation) -> _Conversation:
        if done.levels is None:
            done.begin(known)
        put(done, done.write())
        return done

    def put(own: _Conversation, rows: list) -> None:
        if out is not None:
            out.extend((own.key, own.written - len(rows) + i, *row) for i, row in enumerate(rows))

    for batch in batches:
        for key, step, turn, gone, fault, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield close(now)
                now = _Conversation(key)
            if gone:
                continue
            if step == 0:
                symbol = (role[:1], fault)
                code = codes.setdefault(symbol, len(known))
                if code == len(known):
                    known.append(symbol)
                now.symbol(code, role[:1], fault, turn)
            else:
                if now.levels is None:
                    now.begin(known)
                put(now, now.write(role, text))
    if now is not None:
        yield close(now)


def audit(rows: DataFrame) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits and the digest of what they make of it. rows: as whole() or damaged() give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for done in _conversations(batches, None):
            held.append(done.summary())
            if len(held) == 2048:
                yield _batch(held, SUMMARY)
                held = []
        if held:
            yield _batch(held, SUMMARY)

    return arrow_map(streamed(rows), run, SUMMARY)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, the row's edit (K, R or I), role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                if held:
                    ready.append(_batch(held, ROWS))
                    held.clear()

        ready: list[pa.RecordBatch] = []
        for _ in _conversations(watched(), held):
            yield from ready
            ready.clear()
        yield from ready
        if held:
            yield _batch(held, ROWS)

    return arrow_map(streamed(rows), run, ROWS)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same by dynamic programming from the last row, with strings in full. CRC-32 is folded byte by byte, as keys are digits.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT) AS bytes
  FROM conversations
), numbered AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS n FROM keyed, tab
), after AS (
  SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN n = 1 THEN '' WHEN n = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN n = 3 THEN [0, 1] WHEN n = 0 THEN [] ELSE [0] END) AS copy
  FROM numbered
), marked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM after
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n, seen, lag(role) OVER o AS before
  FROM marked WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), seen)
), found AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
    WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'sound' ELSE 'truncated' END AS fault,
    before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS bad
  FROM placed
), states(g) AS (VALUES (0), (1), (2), (3)),
ins(g, h, labels, rows) AS (VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])),
moves(h, initial, label, cost, role, to_h) AS (VALUES (0, 's', 'K', 0, NULL, 1), (0, 'u', 'K', 0, NULL, 2), (1, 'u', 'K', 0, NULL, 2), (2, 'a', 'K', 0, NULL, 3), (3, 'u', 'K', 0, NULL, 2),
  (0, NULL, 'R', 1, 'user', 2), (1, NULL, 'R', 1, 'user', 2), (2, NULL, 'R', 1, 'assistant', 3), (3, NULL, 'R', 1, 'user', 2)),
steps AS (
  SELECT ins.g, ins.labels || m.label AS labels, 5 * length(ins.labels) + m.cost AS cost, ins.rows, m.initial, m.role, m.label AS kind, m.to_h FROM ins JOIN moves m ON m.h = ins.h
  UNION ALL SELECT g, labels || 'D', 5 * length(labels) + 2, rows, NULL, NULL, 'D', h FROM ins
), best AS (
  SELECT conv_id, i, g, w FROM (
    SELECT c.conv_id, c.n + 1 AS i, ins.g, min({'cost': 5 * length(ins.labels), 'audit': ins.labels, 'rows': ins.rows}) AS w
    FROM (SELECT DISTINCT conv_id, n FROM placed) c, ins WHERE ins.h IN (0, 3) GROUP BY ALL)
  UNION ALL
  SELECT f.conv_id, f.i, s.g, min({'cost': s.cost + b.w.cost + CASE WHEN f.fault = 'truncated' AND s.kind <> 'D' THEN 5 ELSE 0 END, 'audit': s.labels || b.w.audit,
    'rows': list_concat(list_concat(s.rows, CASE WHEN s.kind = 'D' THEN [] ELSE [coalesce(s.role, f.role) || ':' || f.text] END), b.w.rows)}) AS w
  FROM best b JOIN found f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1
  JOIN steps s ON s.to_h = b.g AND (s.kind <> 'K' OR s.initial = left(f.role, 1)) AND (s.kind = 'D' OR f.fault IN ('sound', 'truncated'))
  GROUP BY f.conv_id, f.i, s.g
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal
  FROM found GROUP BY conv_id
)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
  coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(b.w.cost, 0)::BIGINT AS cost, coalesce(b.w.audit, '') AS audit, sha256(coalesce(array_to_string(b.w.rows, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = 1 AND b.g = 0
"""
