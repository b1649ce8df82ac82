"""Spark session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job relies on; safe to set on a shared session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles methods above 8000 bytes; let Spark split such stages instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def tuned(spark: SparkSession) -> SparkSession:
    """A session of our own beside the caller's: its settings, then ours. The caller's stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in RUNTIME_CONF.items():
        own.conf.set(key, value)
    return own


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers once per application, so that they need no copy of the repository.

    Also to a local master's: they are processes of their own and may start from any folder.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    bundle = os.path.join(tempfile.mkdtemp(prefix="fluxloom-"), "fluxloom.zip")
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("fluxloom", os.path.relpath(path, home)))
    context.addPyFile(bundle)
    _shipped.add(context.applicationId)


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fluxloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_private_folder: str | None = None


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; anywhere else
    a missing setting is an error, because a private folder would lose rows silently.
    """
    global _private_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _private_folder is None:
        _private_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _private_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint in the shared folder.

    Used where a result feeds several later passes: a lost executor costs a re-read,
    and Spark removes the files once nothing refers to them.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


cut = settle
