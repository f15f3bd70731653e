"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content (null becomes empty; nothing else may change,
as every byte matters to the tokenizer) with the digest of the tokenizer file and the library's
version. Keys are joined with the stored counts; of the keys without one, a single row each fetches
the text, which is encoded and appended to the cache; then all documents join the cache.

For byte-level tokenizers without a normalizer, misses go through a second cache of the same kind in
the worker: the library splits a text into pre-tokens and encodes each alone, so a text's count is the
sum over its pre-tokens, and only distinct pre-tokens are given to the library. Texts that hold one of
the tokenizer's special strings, and all texts of other tokenizers, are given to the library whole.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows stay and share a key;
a null id is kept; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.bpe import chunks
from orecart.llm.common import arrow_map, documents, shared_dir
from orecart.llm.pieces import connect, cut

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
WORDS_HELD = 600_000


@lru_cache(maxsize=4)
def version_of(name: str) -> str:
    """Digest of the tokenizer file with the library that reads it."""
    import public_tokenizers

    kind = "sentencepiece" if name.endswith(".model") else "tokenizers"
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + f"\0{kind} {__import__(kind).__version__}".encode()).hexdigest()


@lru_cache(maxsize=4)
def counter(name: str) -> Counter:
    return Counter(name)


class Counter:
    def __init__(self, name: str) -> None:
        import os

        import public_tokenizers

        path = public_tokenizers.path(name)
        self.by_piece, self.slot, self.counts = False, {}, np.zeros(0, np.int64)
        if name.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_padding()
        own.no_truncation()
        self.library = lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
        self.special = [x.content for x in own.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        if self.by_piece:
            self.con, self.pattern = connect("200MB"), public_tokenizers.PATTERN

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self.library(texts)
        out = np.zeros(len(texts), np.int64)
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        if whole:
            out[whole] = self.library([texts[i] for i in whole])
        rest = np.setdiff1d(np.arange(len(texts)), whole)
        cut(self.con, list(range(len(rest))), [texts[i] for i in rest], self.pattern)
        lists = self.con.sql("SELECT doc, pieces FROM piece_rows ORDER BY doc").to_arrow_table().column("pieces").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.slot) + len(words) > WORDS_HELD:
            self.slot, self.counts = {}, np.zeros(0, np.int64)
        new = [x for x in words if x not in self.slot]
        if new:
            self.counts = np.append(self.counts, np.array(self.library(new), np.int64))
            self.slot.update(zip(new, range(len(self.slot), len(self.slot) + len(new)), strict=True))
        if words:
            each = self.counts[np.array([self.slot[x] for x in words])][coded.indices.to_numpy()]
            stop = np.concatenate(([0], np.cumsum(each)))[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            out[rest] = np.diff(stop)
        return out.tolist()


def encode_counts(rows: DataFrame, name: str) -> DataFrame:
    """(digest, text) rows to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(name)
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(own.count(texts), pa.int64())], ["digest", "n_tokens"])

    return arrow_map(rows.select("digest", "text"), run, "digest binary, n_tokens long", 2048)


def token_counts(docs: DataFrame, cache: str, name: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; texts new to the cache (a Parquet folder) are appended to it."""
    spark, version = docs.sparkSession, version_of(name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)))
    try:
        stored = spark.read.schema("digest binary, n_tokens long, version string").parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    except AnalysisException:
        stored = None
    distinct = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    misses = distinct.join(stored.select("digest"), "digest", "left_anti") if stored is not None else distinct
    # Keyed by id and digest, so that a group of copies spreads over all tasks; of equal ids with equal texts one remains.
    wanted = misses.select(F.col("digest").alias("miss"), "first_id").hint("shuffle_hash")
    fetched = keyed.join(wanted, (F.col("digest") == F.col("miss")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("digest", "text")
    new = encode_counts(fetched, name).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    new.withColumn("version", F.lit(version)).write.mode("append").parquet(cache)
    stored = spark.read.schema("digest binary, n_tokens long, version string").parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")
    # Only runs that append at the same time leave a digest twice. Without the aggregate, Spark can split the join's hot digests.
    if stored.count() != stored.select("digest").distinct().count():
        stored = stored.groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    sized = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    return sized.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query starts from an empty cache, so that its work does not depend on earlier runs."""
    return token_counts(documents(spark, sf_dir), shared_dir(spark))
