"""Weighted and plain percentile summaries (IDs D6-D8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.spread import attach, quantiles, running_sum, value_piece

LEVELS = (0.16, 0.50, 0.84)
LEVEL_NAMES = ("p16", "median", "p84")


def weighted_summary(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean and scatter; a group whose weights sum to zero is weighted equally."""
    x, w = F.col(value), F.col(weight)
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"),
        F.sum(x).alias("_x"), F.sum(x * x).alias("_xx"))
    use = F.col("_w") > 0
    total = F.when(use, F.col("_w")).otherwise(F.col("n"))
    mean = F.when(use, F.col("_wx")).otherwise(F.col("_x")) / total
    square = F.when(use, F.col("_wxx")).otherwise(F.col("_xx")) / total
    return s.select(*keys, "n", mean.alias("weighted_mean"),
                    F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("weighted_std"))


def weighted_percentiles(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """16/50/84 percentiles, linear between the cumulative weights that bracket each level."""
    x = df.select(*keys, F.col(value).cast("double").alias("_x"), F.col(weight).cast("double").alias("_wt"))
    x = x.where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.col("_wt") >= 0) & ~F.isnan("_wt"))
    totals = x.groupBy(*keys).agg(F.sum("_wt").alias("_total"), F.count(F.lit(1)).alias("n"))
    shared = attach(value_piece(x, keys, "_x"), totals, keys, spread=["_x"])
    weighted = F.col("_total") > 0
    cum = running_sum(shared, keys, ["_x", "_wt"], F.col("_vp"), F.when(weighted, F.col("_wt")).otherwise(1.0), "_sum")
    cum = cum.withColumn("_c", F.col("_sum") / F.when(weighted, F.col("_total")).otherwise(F.col("n")))
    point = F.struct(F.col("_x").alias("x"), F.col("_c").alias("c"))  # c rises with x
    aggs = [F.max("n").alias("n"), F.max("_x").alias("_top")]
    for i, level in enumerate(LEVELS):
        aggs += [F.max(F.when(F.col("_c") <= level, point)).alias(f"_lo{i}"), F.min(F.when(F.col("_c") > level, point)).alias(f"_hi{i}")]
    got = cum.groupBy(*keys).agg(*aggs)
    out = []
    for i, (level, name) in enumerate(zip(LEVELS, LEVEL_NAMES)):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        between = lo["x"] + (F.lit(level) - lo["c"]) / (hi["c"] - lo["c"]) * (hi["x"] - lo["x"])
        out.append(F.when(hi.isNull(), F.col("_top")).when(lo.isNull(), hi["x"]).otherwise(between).alias(name))
    return got.select(*keys, "n", *out).withColumn("plus", F.col("p84") - F.col("median")).withColumn(
        "minus", F.col("median") - F.col("p16"))


def percentile_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Plain 16/50/84 percentiles with the distances to the median."""
    return quantiles(df, keys, value, list(LEVELS), list(LEVEL_NAMES)).withColumn(
        "plus", F.col("p84") - F.col("median")).withColumn("minus", F.col("median") - F.col("p16"))
