"""Continuous intake of event releases and live outcome counts (IDs K1, K3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators.catalogs import novelty
from fluxloom.operators.records import within_bounds
from fluxloom.session import settle
from fluxloom.sources.records import normalize_tce


def release_stream(spark: SparkSession, path: str, columns: Sequence[str], max_files: int = 1000) -> DataFrame:
    """Typed rows of every new CSV file under ``path``, with the file they came from and why they are rejected, if so."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.readStream.schema(schema).option("header", "true").option("comment", "#").option("maxFilesPerTrigger", max_files).csv(path)
    rows = normalize_tce(raw.withColumn("file", F.col("_metadata.file_path")), ["file"])
    inside = F.coalesce(within_bounds(), F.lit(False))
    return rows.withColumn("reject", F.when(~inside, "out-of-bounds").when(F.col("tic").isNull(), "invalid-identifier"))


def harvest_batch(rows: DataFrame, registries: dict[str, DataFrame], availability: DataFrame, registered: DataFrame) -> DataFrame:
    """Outcome of every row: rejected with its reason, registered, already provisioned, ineligible or unavailable.

    Rows are told apart by their file and their place in the batch, so of the rows of a new target, in
    whichever files, exactly one registers it.
    """
    x = settle(rows.withColumn("place", F.monotonically_increasing_id())).withColumn("target_id", F.try_to_number("tic", F.lit("9" * 20)).cast("decimal(20,0)"))
    x = x.withColumn("target_id", F.when(F.col("target_id") <= 2**63 - 1, F.col("target_id").cast("long")))
    reject = F.coalesce("reject", F.when(F.col("target_id").isNull(), F.lit("invalid-identifier")))
    lost = x.where(reject.isNotNull()).select("file", "place", "target_id", reject.alias("outcome"))
    x = x.where(reject.isNull())
    first = x.groupBy("target_id").agg(F.min(F.struct("file", "place")).alias("_first"))
    status = novelty(first, registries, availability)
    seen = registered.select("target_id").distinct().withColumn("_seen", F.lit(True))
    y = x.join(first, "target_id").join(status, "target_id").join(seen, "target_id", "left")
    again = F.coalesce(F.col("_seen"), F.lit(False)) | (F.struct("file", "place") != F.col("_first"))
    outcome = F.when(F.col("novelty") != "eligible", F.col("novelty")).when(again, "already-provisioned").otherwise("registered")
    return y.select("file", "place", "target_id", outcome.alias("outcome")).unionByName(lost)


OUTCOMES = "file string, place long, target_id long, outcome string"


def harvest_stream(stream: DataFrame, registries: dict[str, DataFrame], availability: DataFrame, sink: str, checkpoint: str):
    """Run every waiting file through the harvest and append all outcomes under ``sink``.

    Each micro-batch owns one ``batch=<id>`` directory that a retry overwrites, so a
    lost executor or restarted query never registers a target twice.
    """
    def work(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(sink)
        known = spark.createDataFrame([], OUTCOMES + ", batch long")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            known = spark.read.schema(OUTCOMES + ", batch long").parquet(sink).where((F.col("batch") < batch_id) & (F.col("outcome") == "registered"))
        harvest_batch(rows, registries, availability, known).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counts(stream: DataFrame, sink: str, checkpoint: str):
    """Running number of targets per outcome; each update replaces its batch directory."""
    counts = stream.groupBy("outcome").agg(F.count(F.lit(1)).alias("targets"))

    def work(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.schema("outcome string, targets long, batch long").parquet(sink)
    return rows.groupBy("outcome").agg(F.max_by("targets", "batch").alias("targets"))
