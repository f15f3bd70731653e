"""Byte-level BPE encoding and decoding as DuckDB recursive queries, one database per Python worker.

Texts are cut into pre-tokens; every distinct pre-token becomes token-position rows (word, position,
token), at first one per byte. A recursive query joins neighbouring tokens with the merge table
(every split of a vocabulary entry into two entries), contracts the leftmost pair of minimum rank of
each word and repeats until no word has a pair left. Words of over LONG bytes contract all disjoint
places of the minimum rank at once where that cannot change the outcome, so the number of steps
follows the number of distinct tokens. Decoding joins token rows with the vocabulary and aggregates
the bytes in order. Encoded words are remembered within a task up to a bound; forgetting costs time only,
and the database goes with the task, so that an idle worker holds nothing.

Defined cases: a null text counts as empty: no tokens, the digests of zero bytes. Every row is
encoded, repeated ones too; extra columns are ignored; an empty table gives an empty result. An id
outside the vocabulary cannot be decoded: the operator raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents
from orecart.llm.pieces import connect, cut, disconnect

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONG = 48
WORDS_HELD = 400_000
WORDS_AT_ONCE = 40_000
CHUNK = 2 << 20

# A row knows its right neighbour's position and token; -1 stands for none.
_SHORT_STEP = """
WITH RECURSIVE s(w, p, t, np, nt, done) AS (
  SELECT w, p, t, np, nt, false FROM start_rows
  UNION ALL
  (WITH b AS (
    SELECT s.w, min((m.new::BIGINT << 40) | (s.p::BIGINT << 20) | s.np) AS k
    FROM s JOIN merges m ON m.l = s.t AND m.r = s.nt WHERE NOT s.done GROUP BY s.w
  ), c AS (
    SELECT b.w, (b.k >> 40)::INTEGER AS new, ((b.k >> 20) & 1048575)::INTEGER AS at, s.p AS gone, s.np AS after_p, s.nt AS after_t
    FROM b JOIN s ON s.w = b.w AND s.p = (b.k & 1048575)::INTEGER
  )
  SELECT s.w, s.p, CASE WHEN s.p = c.at THEN c.new ELSE s.t END, CASE WHEN s.p = c.at THEN c.after_p ELSE s.np END,
    CASE WHEN s.p = c.at THEN c.after_t WHEN s.np = c.at THEN c.new ELSE s.nt END, c.w IS NULL
  FROM s LEFT JOIN c ON s.w = c.w WHERE NOT s.done AND (c.w IS NULL OR s.p <> c.gone))
)
SELECT w, p, t FROM s WHERE done
"""

_LONG_STEP = """
WITH RECURSIVE s(w, p, t, done) AS (
  SELECT w, p, t, false FROM start_rows
  UNION ALL
  SELECT w, p, CASE WHEN taken THEN new ELSE t END, best IS NULL
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY p), false) AS gone
    FROM (
      SELECT *, coalesce(new = best AND CASE WHEN restless THEN p = first_p ELSE row_number() OVER (PARTITION BY w, island, coalesce(new = best, false) ORDER BY p) % 2 = 1 END, false) AS taken
      FROM (
        SELECT *, i - row_number() OVER (PARTITION BY w, coalesce(new = best, false) ORDER BY p) AS island, min(CASE WHEN new = best THEN p END) OVER (PARTITION BY w) AS first_p
        FROM (
          SELECT a.w, a.p, a.t, a.i, m.new, m.restless, min(m.new) OVER (PARTITION BY a.w) AS best
          FROM (SELECT w, p, t, lead(t) OVER pw AS rt, row_number() OVER pw AS i FROM s WHERE NOT done WINDOW pw AS (PARTITION BY w ORDER BY p)) a
          LEFT JOIN merges m ON m.l = a.t AND m.r = a.rt
        )
      )
    )
  ) WHERE NOT gone
)
SELECT w, p, t FROM s WHERE done
"""


@lru_cache(maxsize=2)
def vocabulary(name: str) -> list[bytes]:
    """Token bytes by rank."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        pairs = [(int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f)]
    out = [b""] * (max(r for r, _ in pairs) + 1)
    for rank, token in pairs:
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def codec(name: str) -> Codec:
    return Codec(vocabulary(name))


class Codec:
    def __init__(self, tokens: list[bytes]) -> None:
        import public_tokenizers

        self.pattern, self.tokens, self.con = public_tokenizers.PATTERN, tokens, connect("160MB")
        rank = {t: i for i, t in enumerate(tokens) if t}
        self.of_byte = np.array([rank[bytes([b])] for b in range(256)], dtype=np.int32)
        rows = [(rank[t[:i]], rank[t[i:]], n) for t, n in rank.items() for i in range(1, len(t)) if t[:i] in rank and t[i:] in rank]
        left, right, new = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        self.con.register("given_merges", pa.table({"l": left, "r": right, "new": new}))
        # restless: a neighbour could join the new token to an entry of lower rank.
        self.con.execute("CREATE TABLE merges AS SELECT l, r, new, new IN (SELECT l FROM given_merges WHERE new < l UNION SELECT r FROM given_merges WHERE new < r) AS restless FROM given_merges")
        self.con.unregister("given_merges")
        # Latin-1 text stands for bytes, as ordered aggregates take text.
        self.con.register("given_vocabulary", pa.table({"id": pa.array(range(len(tokens)), pa.int32()), "text": pa.array([t.decode("latin-1") for t in tokens])}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given_vocabulary")
        self.con.unregister("given_vocabulary")
        self.forget()

    def forget(self) -> None:
        """Words known so far: slot by word, and for slot k the ids pool[ends[k]:ends[k + 1]]."""
        self.slot: dict[str, int] = {}
        self.pool, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode new words by the recursive queries and append their ids to the pool."""
        sizes = np.array([len(x.encode()) for x in words], dtype=np.int64)
        for step, chosen in ((_SHORT_STEP, np.flatnonzero(sizes <= LONG)), (_LONG_STEP, np.flatnonzero(sizes > LONG))):
            for lo in range(0, len(chosen), WORDS_AT_ONCE):
                part = chosen[lo : lo + WORDS_AT_ONCE]
                own = [words[i] for i in part]
                n = sizes[part]
                t = self.of_byte[np.frombuffer("".join(own).encode(), dtype=np.uint8)]
                w = np.repeat(np.arange(len(part), dtype=np.int32), n)
                p = (np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
                last = np.append(w[1:] != w[:-1], True)
                self.con.register("start_rows", pa.table({"w": w, "p": p, "t": t, "np": np.where(last, -1, p + 1).astype(np.int32), "nt": np.where(last, -1, np.append(t[1:], 0)).astype(np.int32)}))
                got = self.con.sql(step).to_arrow_table()
                self.con.unregister("start_rows")
                w, p, t = (got.column(c).to_numpy() for c in "wpt")
                order = np.argsort((w.astype(np.int64) << 32) | p)
                at = len(self.slot)
                self.slot.update(zip(own, range(at, at + len(own)), strict=True))
                self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.bincount(w, minlength=len(own))))
                self.pool = np.append(self.pool, t[order])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text, without special tokens."""
        cut(self.con, list(range(len(texts))), texts, self.pattern)
        rows = self.con.sql("SELECT doc, pieces FROM piece_rows ORDER BY doc").to_arrow_table()
        lists = rows.column("pieces").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) + len(words) > WORDS_HELD:
            self.forget()
        self.learn([x for x in words if x not in self.slot])
        slots = np.array([self.slot[x] for x in words], dtype=np.int64)[coded.indices.to_numpy()] if words else np.zeros(0, np.int64)
        start, n = self.ends[slots], self.ends[slots + 1] - self.ends[slots]
        stop = np.concatenate(([0], np.cumsum(n)))
        flat = self.pool[np.arange(stop[-1]) + np.repeat(start - stop[:-1], n)]
        at = stop[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """Bytes of every list of token ids."""
        n = np.array([len(x) for x in ids], dtype=np.int64)
        flat = np.concatenate(ids).astype(np.int32) if len(ids) else np.zeros(0, np.int32)
        if len(flat) and not 0 <= flat.min() <= flat.max() < len(self.tokens):
            raise ValueError("a token id is outside the vocabulary")
        self.con.register("token_rows", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), n), "p": np.arange(len(flat), dtype=np.int64), "id": flat}))
        got = self.con.execute("SELECT doc, string_agg(text, '' ORDER BY p) FROM token_rows JOIN vocabulary USING (id) GROUP BY doc").fetchall()
        self.con.unregister("token_rows")
        out = [b""] * len(ids)
        for doc, text in got:
            out[doc] = text.encode("latin-1")
        return out


def chunks(texts: list[str | None], most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text or "") > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield at, held


def encode_decode(docs: DataFrame, name: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids themselves if with_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(vocabulary(name))
        for batch in batches:
            doc_ids = batch.column(0)
            for at, texts in chunks(batch.column(1).to_pylist()):
                ids = own.encode(texts)
                back = own.decode(ids)
                columns = [doc_ids.slice(at, len(texts)), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
        disconnect(own.con)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
