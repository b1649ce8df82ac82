"""Cadence and pixel scans (IDs A1-A6, A17)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators.spread import attach, medians, rank_rows, time_piece

MAD_SCALE = 1.4826
BJD_ZERO = 2457000.0
GROUP = ("target_id", "sector")


def read_cadence(spark: SparkSession, path: str, sectors: Sequence[int] | None = None, min_points: int = 50) -> DataFrame:
    """Clean, normalised cadences from a Parquet table partitioned by ``sector``."""
    return clean_cadence(spark.read.parquet(path), sectors, min_points)


def clean_cadence(df: DataFrame, sectors: Sequence[int] | None = None, min_points: int = 50) -> DataFrame:
    """Keep unflagged finite samples, divide by the group median, drop small groups."""
    if sectors is not None:
        df = df.where(F.col("sector").isin(list(sectors)))
    good = df.where((F.col("quality") == 0) & F.col("flux").isNotNull() & ~F.isnan("flux") & F.col("t").isNotNull())
    level = medians(good, GROUP, "flux", "_level", "n_points").where(F.col("n_points") >= min_points)
    return attach(good, level, GROUP, spread=["t"]).withColumn("flux", F.col("flux") / F.col("_level")).drop("_level")


def dedupe_products(df: DataFrame, min_points: int = 50, order: Sequence[str] = ("root_rank", "product")) -> DataFrame:
    """Keep one product per (target, sector): the first in order that has enough points.

    A product name present in a better root shadows the same name in a worse one.
    """
    sizes = df.groupBy(*GROUP, "root_rank", "product").agg(F.count(F.lit(1)).alias("_n"))
    best_root = W.partitionBy("target_id", "product")
    usable = sizes.withColumn("_root", F.min("root_rank").over(best_root)).where(
        (F.col("root_rank") == F.col("_root")) & (F.col("_n") >= min_points))
    first = usable.groupBy(*GROUP).agg(F.min(F.struct(*order)).alias("_first"))
    chosen = first.select(*GROUP, *[F.col("_first")[c].alias(f"_{c}") for c in order])
    kept = attach(df, chosen, GROUP)
    for c in order:
        kept = kept.where(F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    return kept


def fill_flux_err(df: DataFrame) -> DataFrame:
    """Reported errors when all are finite and positive, else 1.4826 MAD (1.0 if that is zero)."""
    e = F.col("flux_err")
    good = F.coalesce(e.isNotNull() & ~F.isnan(e) & (e > 0) & (e < float("inf")), F.lit(False))
    level = medians(df, GROUP, "flux", "_med")
    flags = df.groupBy(*GROUP).agg(F.bool_and(good).alias("_all"), F.count(e).alias("_reported"))
    centred = attach(df, level.drop("n"), GROUP, spread=["t"])
    mad = medians(centred, GROUP, F.abs(F.col("flux") - F.col("_med")), "_mad").drop("n")
    facts = flags.join(mad, list(GROUP))
    fallback = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_SCALE).otherwise(F.lit(1.0))
    return attach(df, facts, GROUP, spread=["t"]).select(
        *[c for c in df.columns if c != "flux_err"],
        F.when(F.col("_all"), e).otherwise(fallback).alias("flux_err"),
        F.when(F.col("_all"), "reported").when(F.col("_reported") == 0, "mad-estimate")
        .otherwise("mad-estimate-invalid-reported").alias("flux_err_source"),
    )


def to_btjd(df: DataFrame, header: DataFrame) -> DataFrame:
    """Times in days since BJD 2457000 from the declared scale, unit, format and reference.

    A group whose time system is not declared keeps its rows with NULL ``t_btjd``
    and the ``reason``; callers filter on it.
    """
    scale, declared = F.upper(F.trim(F.coalesce("timesys", F.lit("")))), F.upper(F.trim(F.coalesce("time_scale", F.lit(""))))
    unit, fmt = F.lower(F.trim(F.coalesce("timeunit", F.lit("")))), F.lower(F.trim(F.coalesce("time_format", F.lit(""))))
    bjd = F.col("bjdrefi") + F.coalesce("bjdreff", F.lit(0.0))
    mjd = F.col("mjdrefi") + F.coalesce("mjdreff", F.lit(0.0))
    middle = medians(df, GROUP, "t", "_mid").drop("n")
    rule = header.join(middle, list(GROUP)).select(
        *GROUP,
        F.when((scale != "") & ~scale.isin("TDB", "BJD_TDB"), "time system is not TDB")
        .when((declared != "") & (declared != "TDB"), "declared scale is not TDB")
        .when((scale == "") & (declared != "TDB"), "time scale undeclared")
        .when((unit != "") & ~unit.isin("d", "day", "days"), "time unit is not days")
        .when((unit == "") & ~fmt.isin("btjd", "mjd", "jd"), "time unit undeclared")
        .when(~((fmt == "mjd") | (mjd.isNotNull() & bjd.isNull())) & (F.col("_mid") <= 2000000.0)
              & bjd.isNull() & (fmt != "btjd"), "time origin undeclared").alias("reason"),
        F.when((fmt == "mjd") | (mjd.isNotNull() & bjd.isNull()), F.coalesce(mjd, F.lit(0.0)) + 2400000.5 - BJD_ZERO)
        .when(F.col("_mid") > 2000000.0, F.lit(-BJD_ZERO))
        .when(bjd.isNotNull(), bjd - BJD_ZERO).otherwise(F.lit(0.0)).alias("_shift"),
    )
    return attach(df, rule, GROUP, spread=["t"]).withColumn(
        "t_btjd", F.when(F.col("reason").isNull(), F.col("t") + F.col("_shift"))).drop("_shift")


def median_bin(df: DataFrame, n_bins: int = 4000, keys: Sequence[str] = GROUP) -> DataFrame:
    """At most ``n_bins`` equal-count bins per group, edges at ``floor(i n / B)``."""
    values = [c for c in ("flux", "flux_err", "sector") if c in df.columns and c not in keys]
    ranked = rank_rows(df, keys, ["t"], time_piece("t"))
    index = F.when(F.col("n") <= n_bins, F.col("rn") - 1).otherwise(F.floor((F.col("rn") * n_bins - 1) / F.col("n")))
    binned = ranked.withColumn("bin", index.cast("long"))
    where = [*keys, "bin"]
    out = binned.groupBy(*where).agg(F.avg("t").alias("t"), F.count(F.lit(1)).alias("n_in_bin"))
    for c in values:  # a bin of a very long series holds many rows, so its median is bracketed too
        out = out.join(medians(binned, where, c, c).drop("n"), where, "left")
    return out


def read_pixels(df: DataFrame, stamp: str = "stamp", width: int = 8) -> DataFrame:
    """Pixel rows with integer x, y from a flattened image column."""
    rest = [c for c in df.columns if c != stamp]
    flat = df.select(*rest, F.posexplode(stamp).alias("_pos", "flux"))
    return flat.select(*rest, (F.col("_pos") % width).cast("int").alias("x"),
                       F.floor(F.col("_pos") / width).cast("int").alias("y"), F.col("flux").cast("double").alias("flux"))


SECTOR_IN_NAME = r"(?i)(?:^|[_-])s(\d{1,4})[_.-]"


def with_sector(products: DataFrame) -> DataFrame:
    """Sector from the mission label or the file name; ``reason`` says why none was found."""
    label = F.regexp_extract("label", r"(?i)sector\s*(\d+)", 1)
    name = F.regexp_extract("file_name", SECTOR_IN_NAME, 1)
    sector = F.coalesce(F.when(label != "", label.cast("int")), F.when(name != "", name.cast("int")))
    return products.withColumn("sector", F.when(sector > 0, sector)).withColumn(
        "reason", F.when(F.col("sector").isNull(), F.lit("no verified sector")))


def observed_sectors(products: DataFrame) -> DataFrame:
    return with_sector(products).where(F.col("reason").isNull()).groupBy("target_id").agg(
        F.array_sort(F.collect_set("sector")).alias("sectors"))
