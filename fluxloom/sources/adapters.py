"""Deterministic views of the driver tables as survey tables.

Every expression that both engines accept is written once, as text; literals
carry an exponent so that both read them as doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIOD = "(2.6e0 + 0.1e0 * (target_id % 5))"
BOX = (f"abs((t - 1.25e0 + {PERIOD} / 2) - {PERIOD} * floor((t - 1.25e0 + {PERIOD} / 2) / {PERIOD})"
       f" - {PERIOD} / 2) < 0.125e0")
QUALITY = "CASE WHEN k % 10 = 7 THEN k ELSE 0 END"
FLUX_ERR = "CASE WHEN target_id % 4 = 3 AND event_id % 50 = 0 THEN NULL ELSE 4e0 + (k % 5) * 0.5e0 END"
FLUX = f"1000e0 + value - CASE WHEN {BOX} THEN 40e0 ELSE 0e0 END"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str, target: str = "user_id") -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id",
        F.expr(target).alias("target_id"),
        ((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400e6)).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type", "value",
    )


def raw_cadence(spark: SparkSession, folder: str, target: str = "user_id") -> DataFrame:
    """Uncleaned cadences: one target per user, or 16 long series with ``user_id % 16``."""
    return events(spark, folder, target).select(
        "event_id", "target_id",
        (F.floor(F.col("t") / 10).cast("int") + 1).alias("sector"), "t",
        F.expr(QUALITY).alias("quality"),
        F.concat(F.lit("p"), (F.col("k") % 3).cast("string")).alias("product"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.expr(FLUX)).alias("flux"),
        F.expr(FLUX_ERR).alias("flux_err"),
    )


def cadence(spark: SparkSession, folder: str, target: str = "user_id") -> DataFrame:
    """Clean cadences with flux near one."""
    raw = raw_cadence(spark, folder, target).where((F.col("quality") == 0) & ~F.isnan("flux"))
    return raw.select("target_id", "sector", "t", "event_id", (F.col("flux") / 1000).alias("flux"),
                      (F.coalesce("flux_err", F.lit(5.0)) / 1000).alias("flux_err"))


def ephemeris(spark: SparkSession, folder: str, target: str = "user_id") -> DataFrame:
    ids = table(spark, folder, "events").select(F.expr(target).alias("target_id")).distinct()
    return ids.select("target_id", F.expr(PERIOD).alias("period"), F.lit(1.25).alias("epoch"), F.lit(6.0).alias("duration_hours"))


SERIES16 = "user_id % 16"


def raw_sql(target: str = "user_id") -> str:
    return f"""ev AS (SELECT event_id, {target} AS target_id, (epoch_us(ts) - 1704067200000000) / 86400e6 AS t,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type, value FROM events),
raw AS (SELECT event_id, target_id, CAST(floor(t / 10) AS INTEGER) + 1 AS sector, t, {QUALITY} AS quality,
  'p' || CAST(k % 3 AS VARCHAR) AS product,
  CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE {FLUX} END AS flux, {FLUX_ERR} AS flux_err FROM ev)"""


def cadence_sql(target: str = "user_id") -> str:
    return raw_sql(target) + f""",
lc AS (SELECT target_id, sector, t, event_id, flux / 1000 AS flux, coalesce(flux_err, 5e0) / 1000 AS flux_err
  FROM raw WHERE quality = 0 AND NOT isnan(flux)),
eph AS (SELECT target_id, {PERIOD} AS period, 1.25e0 AS epoch, 6e0 AS duration_hours
  FROM (SELECT DISTINCT {target} AS target_id FROM events))"""


def phase_sql(t: str = "t", period: str = "period", epoch: str = "epoch") -> str:
    """Phase in days, the same formula as ``functions.fold.phase_days``."""
    x = f"({t} - {epoch} + {period} / 2)"
    return f"({x} - {period} * floor({x} / {period}) - {period} / 2)"
