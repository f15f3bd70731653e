"""op12 against a search over all edits in plain Python, and against its SQL on odd rows."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from orecart.llm import convrepair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Least (cost, audit) and the rows it makes, by best-first search over whole paths; rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if (i, roles[-1:], len(roles) < 1, cost, audit) in seen:
            continue
        seen.add((i, roles[-1:], len(roles) < 1, cost, audit))
        step = lambda label, more, j, role, text: heapq.heappush(heap, (cost + more, audit + label, j, roles + role[:1], (*out, f"{role}:{text}")))  # noqa: B023, E731
        legal = lambda role: re.fullmatch("s?(ua)*u?", roles + role[:1]) and role[:1] != ""  # noqa: B023, E731
        for role in ("user", "assistant"):
            if legal(role) and audit.count("I") <= 2 * len(rows) + 2:
                step("I", 5, i, role, "")
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if legal(role):
                    step("K", more, i + 1, role, text)
                for other in ("user", "assistant"):
                    if legal(other):
                        step("R", 1 + more, i + 1, other, text)
    raise AssertionError


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "sound" if body[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def want(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        own = by.setdefault(conv, [])
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if n:
            text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
            own += [(turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    out = Counter()
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        known = faults([r[1:] for r in own])
        turns = {t for t, _, _ in own if t is not None}
        count = Counter(f for _, _, f in known)
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(known))
        cost, audit, made = cheapest(known)
        out[conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], bad, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()] += 1
    return out


def table(rnd, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "u", "s"]
    texts = ["Fine.", "cut", "Ok? \n", " \t", "", None, "é!", "Fine.", "a\nb.", " "]
    return [(c if c % 9 else None, rnd.choice([*range(8), None]), rnd.choice(roles), rnd.choice(texts)) for c in range(n) for _ in range(rnd.randint(1, 7))]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    found = [r for r in table(rnd, 60) if r[0] is not None]
    return found + [(None, 1, "user", "x."), (None, 2, "assistant", "y."), (777, 3, "user", "z"), (777, 3, "user", "z")]


def test_registered_query_equals_search_and_sql(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = Counter(tuple(r[c] for c in COLUMNS) for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect())
    assert got == want(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    done = con.execute(cr.ORACLE_SQL)
    names = [c[0] for c in done.description]
    assert got == Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in done.fetchall())


def test_every_short_conversation_is_repaired_at_least_cost():
    cells = [("system", "sound"), ("user", "sound"), ("assistant", "sound"), ("user", "truncated"), ("assistant", "blank"), ("tool", "sound")]
    code = {"sound": cr.SOUND, "blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.CUT}
    for n in range(5):
        for picked in itertools.product(cells, repeat=n):
            paths, cost = cr.plan((role[:1], code[fault]) for role, fault in reversed(picked))
            state, audit = 0, ""
            for level in paths:
                labels, _, state = level[state]
                audit += labels
            assert (cost, audit) == cheapest([(role, "t", fault) for role, fault in picked])[:2], picked


def test_a_long_conversation_streams(spark):
    n = 60_000
    long = spark.range(n).selectExpr("cast(5 as long) conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('t', id, '.') text").repartition(4)
    (row,) = cr.audit(cr.whole(long)).collect()
    assert (row.cost, row.audit) == (0, "K" * n)
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{'ua'[i % 2] == 'u' and 'user' or 'assistant'}:t{i}." for i in range(n)).encode()).hexdigest()


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Yes."), (2, 0, "user", "Why?"), (3, 0, "user", "")]
    got = sorted(tuple(r) for r in cr.repaired(cr.whole(spark.createDataFrame(rows, SCHEMA).repartition(2))).collect())
    assert got == [(1, 0, "R", "user", "Hello."), (1, 1, "K", "assistant", "Yes.")]
    sums = {r.conv_id: (r.cost, r.audit) for r in cr.audit(cr.whole(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert sums == {1: (3, "RDK"), 2: (2, "D"), 3: (2, "D")}


def test_empty_table_and_more_columns(spark):
    assert cr.audit(cr.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "a.", 1, "x", 5), (1, 1, "assistant", "b.", 1, "x", 5)], f"{SCHEMA}, fault long, KEY string, pass long")
    assert cr.audit(cr.whole(more)).first().audit == "KK"
