"""Current state on storage: Parquet parts and a manifest for each version.

A commit writes its rows as a new part, then publishes the next version's manifest, which names all
parts. Publishing fails if that version exists, so of two writers one commits first and the other goes on
from its version. A crash before publishing leaves the version before, and an unnamed part that no reader
sees. Upserts and patches are logs whose fold does not depend on how they were cut into parts; compaction
folds them into one base part. All rows are written, read and folded by Spark; the manifests are small.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orecart.streaming import targets


class ConflictError(Exception):
    """Another writer has committed the version that this one expected to write."""


class Versions:
    """Manifests of a table: numbered files, each with the parts of its version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def latest(self) -> int:
        """The newest version, 0 before the first commit."""
        folder = self._at(f"{self.path}/versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return max((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), default=0)

    def parts(self, version: int) -> list[dict]:
        if not version:
            return []
        return json.loads(self.spark.read.text(self._file(version), wholetext=True).first().value)

    def publish(self, version: int, parts: list[dict]) -> bool:
        """Put a version in place as a whole; False if it exists."""
        part, whole = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._at(self._file(version))
        out = self._fs.create(part)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # a local rename replaces, a link does not
                try:
                    os.link(part.toUri().getPath(), whole.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(whole) and self._fs.rename(part, whole)
        finally:
            self._fs.delete(part, False)


class Targets(Versions):
    """Crawl targets by url: upserts and patches in, the folded state of any version out."""

    def _commit(self, kind: str, rows: DataFrame, expected: int | None) -> int:
        path = f"{self.path}/parts/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        while True:
            at = self.latest() if expected is None else expected
            before = [] if kind == "base" else self.parts(at)
            if self.publish(at + 1, [*before, {"kind": kind, "path": path, "version": at + 1}]):
                return at + 1
            if expected is not None:
                raise ConflictError(f"version {at + 1} of {self.path} exists")

    def upsert(self, log: DataFrame, expected: int | None = None) -> int:
        """Commit upserts (the columns of fold_upserts and seq) and return the version. With expected, only on top of that version."""
        return self._commit("upsert", log, expected)

    def patch(self, changes: DataFrame, expected: int | None = None) -> int:
        """Commit patches (url, seq, name, value)."""
        return self._commit("patch", changes, expected)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The targets of a version, the newest by default; None before the first upsert. Later commits win over earlier ones, within one seq decides."""
        parts = self.parts(self.latest() if version is None else version)
        log, changes = (self._log(parts, kinds) for kinds in (("base", "upsert"), ("patch",)))
        if log is None:
            return None
        now = targets.fold_upserts(log)
        return now if changes is None else targets.patch(now, changes)

    def _log(self, parts: list[dict], kinds: tuple[str, ...]) -> DataFrame | None:
        own = [self.spark.read.parquet(p["path"]).withColumn("seq", F.struct(F.lit(p["version"]).alias("v"), F.col("seq").cast("long").alias("s"))) for p in parts if p["kind"] in kinds]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own) if own else None

    def compact(self) -> int:
        """Fold all parts into one. Tries again on top of what other writers commit meanwhile."""
        while True:
            at = self.latest()
            try:
                now = self.read(at)
                return at if now is None else self._commit("base", now.withColumn("seq", F.lit(0)), at)
            except ConflictError:
                continue
