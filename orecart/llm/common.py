"""Shared pieces of the corpus operators: shared storage, Arrow batches, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python. Whole texts travel in a batch, so it is kept small.
BATCH_ROWS = 512

#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares. All of an application's go when it ends.

    Where that is unset a local session gets a temporary one; on a cluster it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="orecart-")
        context.setCheckpointDir(base)
    own = f"{base.rstrip('/')}/orecart-{context.applicationId}"
    if getattr(context, "_orecart_folder", None) != own:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._orecart_folder = own
    return f"{own}/{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow whose function gets batches of `rows` rows; workers give their memory back between tasks.

    Whole texts travel in a batch, so one bound, the same for all plans, stands in place of the session's
    default; a bound that the caller has set stays.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH_ROWS))

    def run(batches: Iterator) -> Iterator:
        yield from fn(regrouped(batches, rows))
        release()

    return df.mapInArrow(run, schema)


def regrouped(batches: Iterator, rows: int) -> Iterator:
    """The same rows in batches of `rows` rows, the last one smaller."""
    import pyarrow as pa

    held, n = [], 0

    def joined():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        while len(batch):
            part = batch.slice(0, rows - n)
            held.append(part)
            n += len(part)
            batch = batch.slice(len(part))
            if n == rows:
                yield joined()
                held, n = [], 0
    if held:
        yield joined()


def release() -> None:
    """Return freed memory to the system, which a worker that is used again would keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, elementwise on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_slices(column, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of an Arrow string column as UTF-8 (null: empty), in runs of at most `most` bytes or one text."""
    at, held, size = 0, [], 0
    for i, text in enumerate(column.to_pylist()):
        raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
        if held and size + len(raw) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield at, held
