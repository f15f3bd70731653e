"""Session factory and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(app: str = "orecart", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow; cluster settings win over these defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that spark.checkpoint.dir names, or below the checkpoint folder of a session without that setting."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = held.get()
    own = f"{base.rstrip('/')}/orecart-tables-{context.applicationId}"
    if getattr(context, "_orecart_tables", None) != own:
        path = context._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
        context._orecart_tables = own
    return f"{own}/{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to Python workers once per application, through the driver's file server."""
    context = spark.sparkContext
    if getattr(context, "_orecart_shipped", False):
        return
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared:
            context.setCheckpointDir(shared)
        elif context.master == "local" or context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp(prefix="orecart-"))
    fd, path = tempfile.mkstemp(prefix="orecart-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(path)
    context._orecart_shipped = True
