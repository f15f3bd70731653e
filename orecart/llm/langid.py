"""Language identification by multilingual mixture inference.

Model: per language the smoothed distribution of hashed byte trigrams of lower-cased text, counted
over every training document. A document's trigram counts c are explained by a mixture
sum_l pi_l p_l; expectation-maximisation estimates pi. The set of languages is then grown in order
of pi while the log-likelihood gain of the enlarged set exceeds a penalty of PENALTY * log(n) per
language. The proportions are estimated anew within that set; the predicted language is the largest
of them, its proportion the score. Every estimation runs until no proportion moves by TOLERANCE.

Defined cases: a text that is null or has no letter gets `und` with score 0. Rows without a language
or id are not learned from where the language is null; a null id counts as an empty string for the
split. With nothing learned every prediction is `und`. Equal proportions go to the language that
sorts first. Repeated rows are predicted each; extra columns stay, except that columns named
lang_pred, score and lang_set are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.llm.common import arrow_map, documents, text_slices

BUCKETS = 1 << 15
#: Where an estimation ends, and a bound for mixtures whose languages can hardly be told apart.
TOLERANCE, STEPS = 1e-4, 1000
PENALTY = 8.0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigram_buckets(raw: bytes) -> np.ndarray:
    """Buckets of all byte trigrams of one text, padded with one space on either side."""
    b = _LOWER[np.frombuffer(b" " + raw + b" ", dtype=np.uint8)].astype(np.uint32)
    code = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16)) if len(b) > 2 else np.zeros(0, np.uint32)
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Log-probabilities per language from (lang, text) rows; the model's size does not depend on the rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1)):
                for lang, raw in zip(langs[at:], texts, strict=False):
                    held.setdefault(lang, np.zeros(BUCKETS, np.int64)).__iadd__(np.bincount(trigram_buckets(raw), minlength=BUCKETS))
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])

    counted = arrow_map(rows.select("lang", "text"), count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.full((len(langs), BUCKETS), 0.5)
    for i, lang in enumerate(langs):
        own = counted[counted["lang"] == lang]
        table[i, own["bucket"].to_numpy()] += own["n"].to_numpy()
    return langs, table / table.sum(axis=1, keepdims=True)


def mixture(p: np.ndarray, c: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of p (n-grams by languages) that explain counts c, and the log-likelihood."""
    n, pi = c.sum(), np.full(p.shape[1], 1.0 / p.shape[1])
    if p.shape[1] > 1:
        for _ in range(steps):
            new = pi * (p.T @ (c / (p @ pi))) / n
            done = np.abs(new - pi).max() < TOLERANCE
            pi = new
            if done:
                break
    return pi, float(c @ np.log(p @ pi))


def infer(raw: bytes, model: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The chosen set of languages of one text, and their proportions, largest first. model: n-grams by languages."""
    counts = np.bincount(trigram_buckets(raw), minlength=BUCKETS)
    at = np.flatnonzero(counts)
    p, c = model[at], counts[at].astype(np.float64)
    pi, _ = mixture(p, c)
    order = np.argsort(-pi, kind="stable")
    chosen, penalty = [int(order[0])], PENALTY * np.log(max(2.0, c.sum()))
    share, best = mixture(p[:, chosen], c)
    for k in order[1:]:
        if pi[k] < 0.02:
            break
        wider, more = mixture(p[:, [*chosen, int(k)]], c)
        if more - best <= penalty:
            break
        chosen.append(int(k))
        share, best = wider, more
    order = sorted(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
    return share[order], [chosen[i] for i in order]


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4) == 2


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred, score and lang_set. Only the text is looked at."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "lang_set")]
    model = np.ascontiguousarray(table.T)
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("__letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = batch.column(len(keep) + 1).to_pylist()
            out: list[tuple[str, float, list[str]]] = []
            for at, texts in text_slices(batch.column(len(keep))):
                for ok, raw in zip(letters[at:], texts, strict=False):
                    if not ok or not langs:
                        out.append(("und", 0.0, []))
                        continue
                    share, chosen = infer(raw, model)
                    out.append((langs[chosen[0]], float(min(1.0, share[0])), [langs[k] for k in chosen]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.list_(pa.string()))], [*keep, "lang_pred", "score", "lang_set"])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return arrow_map(taken, run, ", ".join([*fields, "lang_pred string", "score double", "lang_set array<string>"]))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    langs, table = learn(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()))
    return predict(docs, langs, table, keep)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "lang_set")
