"""Folding on an ephemeris and robust in/out measurements (IDs B1-B4, D1-D5, D21, E9, H30)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.fold import cycle_number, floored_mod, phase_days, phase_hours, window_label
from fluxloom.operators.spread import attach, medians, previous_value, quantiles, time_piece

TARGET = ("target_id",)
MEDIAN_ERROR = 1.253
PPM = 1e6


def with_ephemeris(df: DataFrame, eph: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    return attach(df, eph, keys, spread=["t"])


def with_phase(df: DataFrame, eph: DataFrame) -> DataFrame:
    """Signed hours from the nearest event centre."""
    return with_ephemeris(df, eph).withColumn("phase_hours", phase_hours("t", "period", "epoch"))


def with_cycle(df: DataFrame, eph: DataFrame, rule: str = "rint") -> DataFrame:
    """Event number and its parity under the chosen rounding rule."""
    folded = with_ephemeris(df, eph).withColumn("cycle", cycle_number("t", "period", "epoch", rule))
    return folded.withColumn("is_even", F.pmod(F.col("cycle"), F.lit(2)) == 0)


def with_window_label(df: DataFrame, eph: DataFrame, shift: float = 0.0, period_factor: float = 1.0) -> DataFrame:
    """Label in/baseline at ``epoch + shift * period`` for ``period_factor`` times the period."""
    p = F.col("period") * period_factor
    return with_ephemeris(df, eph).withColumn(
        "window", window_label(phase_hours(F.col("t"), p, F.col("epoch") + F.lit(shift) * F.col("period")), "duration_hours"))


def mask_transits(df: DataFrame, eph: DataFrame, half: float = 0.75, min_rows: int = 100) -> DataFrame:
    """Drop rows near events; a target left with too few rows keeps all of them."""
    far = F.abs(phase_hours("t", "period", "epoch")) >= F.col("duration_hours") * half
    marked = attach(df, eph, TARGET, "left", spread=["t"])
    marked = marked.withColumn("_far", F.coalesce(far, F.lit(True))).withColumn("_known", F.col("period").isNotNull())
    kept = marked.groupBy("target_id").agg(F.count_if("_far").alias("_kept"), F.bool_or("_known").alias("_has"))
    facts = kept.select("target_id", F.when(F.col("_kept") < min_rows, "not-applied-insufficient-rows")
                        .when(F.col("_has"), "applied").otherwise("not-applied-no-ephemeris").alias("mask_status"))
    out = attach(marked, facts, TARGET, spread=["t"])
    return out.where(F.col("_far") | (F.col("mask_status") != "applied")).select(*df.columns, "mask_status")


def label_statistics(labelled: DataFrame, keys: Sequence[str], value: str = "flux") -> DataFrame:
    """Count, median and population scatter of the in and baseline samples, one row per key."""
    stats = quantiles(labelled, [*keys, "window"], value, [0.5], ["median"], "n", [F.stddev_pop("_v").alias("sd")])
    cells = []
    for tag, window in (("in", "in"), ("out", "baseline")):
        here = F.col("window") == window
        cells += [F.max(F.when(here, F.col(c))).alias(f"{c}_{tag}") for c in ("n", "median", "sd")]
    return stats.groupBy(*keys).agg(*cells).withColumn("n_in", F.coalesce("n_in", F.lit(0))).withColumn(
        "n_out", F.coalesce("n_out", F.lit(0)))


def depth_columns() -> tuple[Column, Column]:
    """Depth and its uncertainty in ppm from ``label_statistics`` columns."""
    depth = (F.col("median_out") - F.col("median_in")) * PPM
    part = [F.lit(MEDIAN_ERROR) * F.col(f"sd_{tag}") / F.sqrt(F.col(f"n_{tag}")) for tag in ("in", "out")]
    return depth, F.sqrt(part[0] * part[0] + part[1] * part[1]) * PPM


def transit_depth(df: DataFrame, eph: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Median depth in ppm; NULL where one side has no samples."""
    labelled = with_window_label(df, eph).where(F.col("window").isNotNull())
    depth, error = depth_columns()
    return label_statistics(labelled, keys).select(
        *keys, depth.alias("depth_ppm"), error.alias("uncertainty_ppm"), "n_in", "n_out")


# name, shift in declared periods, period factor, parity filter on the floor-rule cycle
SCREEN_WINDOWS = (
    ("primary", 0.0, 1.0, None), ("odd", 0.0, 1.0, 1), ("even", 0.0, 1.0, 0),
    ("half_phase", 0.5, 1.0, None), ("double_primary", 0.0, 2.0, None), ("double_alternating", 1.0, 2.0, None),
)
MIN_WINDOW_SAMPLES = 3
ODD_EVEN_SIGMA = 3.0


def screen_long(df: DataFrame, eph: DataFrame) -> DataFrame:
    """One row per (target, screening window) with depth, uncertainty, significance, status."""
    folded = with_ephemeris(df, eph)
    parity = F.pmod(cycle_number("t", "period", "epoch", "floor"), F.lit(2))
    tries = []
    for name, shift, factor, want in SCREEN_WINDOWS:
        label = window_label(phase_hours(F.col("t"), F.col("period") * factor, F.col("epoch") + F.col("period") * shift), "duration_hours")
        if want is not None:
            label = F.when(parity == want, label)
        tries.append(F.struct(F.lit(name).alias("test"), label.alias("window")))
    labelled = folded.select("target_id", "flux", F.explode(F.array(*tries)).alias("_w")).select(
        "target_id", "flux", "_w.test", "_w.window").where(F.col("window").isNotNull())
    stats = label_statistics(labelled, ["target_id", "test"])
    every = eph.select("target_id").distinct().select("target_id", F.explode(F.array(*[F.lit(w[0]) for w in SCREEN_WINDOWS])).alias("test"))
    depth, error = depth_columns()
    covered = (F.col("n_in") >= MIN_WINDOW_SAMPLES) & (F.col("n_out") >= MIN_WINDOW_SAMPLES)
    full = every.join(stats, ["target_id", "test"], "left").fillna(0, ["n_in", "n_out"])
    measured = full.select(
        "target_id", "test", "n_in", "n_out",
        F.when(covered, depth).alias("depth_ppm"),
        F.when(covered & (error > 0), error).alias("uncertainty_ppm"),
        F.when(~covered, "insufficient_coverage").when(error > 0, "measured").otherwise("uncertainty_unavailable").alias("status"))
    return measured.withColumn("sigma", F.col("depth_ppm") / F.col("uncertainty_ppm"))


def screen(df: DataFrame, eph: DataFrame) -> DataFrame:
    """Fixed-ephemeris screen, one row per target, with the odd-even comparison."""
    long = screen_long(df, eph)
    cells = []
    for name, *_ in SCREEN_WINDOWS:
        here = F.col("test") == name
        cells += [F.max(F.when(here, F.col(c))).alias(f"{name}_{c}") for c in ("depth_ppm", "uncertainty_ppm", "sigma", "status")]
    wide = long.groupBy("target_id").agg(*cells)
    both = F.hypot("odd_uncertainty_ppm", "even_uncertainty_ppm")
    z = F.abs(F.col("odd_depth_ppm") - F.col("even_depth_ppm")) / F.when(both > 0, both)
    return wide.withColumn("odd_even_z", z).withColumn("odd_even_consistent", F.col("odd_even_z") < ODD_EVEN_SIGMA).withColumn(
        "odd_even_status", F.when(F.col("odd_even_z").isNull(), "unresolved").otherwise("measured"))


def phase_bins(df: DataFrame, eph: DataFrame, limit_hours: float = 14.0, bin_minutes: float = 8.0, min_samples: int = 3) -> DataFrame:
    """Median flux in phase bins; the last bin is closed, thin bins are NULL."""
    count = math.ceil(2.0 * limit_hours / (bin_minutes / 60.0))
    width = 2.0 * limit_hours / count
    folded = with_phase(df, eph).where(F.abs("phase_hours") <= limit_hours)
    index = F.least(F.floor((F.col("phase_hours") + limit_hours) / width), F.lit(count - 1)).cast("int")
    stats = quantiles(folded.withColumn("bin", index), ["target_id", "bin"], "flux", [0.5], ["median"], "n", [F.stddev_pop("_v").alias("sd")])
    every = eph.select("target_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    enough = F.col("n") >= min_samples
    return every.join(stats, ["target_id", "bin"], "left").select(
        "target_id", "bin", ((F.col("bin") + 0.5) * width - limit_hours).alias("centre_hours"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(enough, F.col("median")).alias("median_flux"),
        F.when(enough, F.lit(MEDIAN_ERROR) * F.col("sd") / F.sqrt("n")).alias("error"))


def weighted_phase_bins(df: DataFrame, eph: DataFrame, bins: int = 100) -> DataFrame:
    """Inverse-variance mean phase, flux and error in at most ``bins`` bins over the period."""
    good = df.where((F.col("flux_err") > 0) & F.col("flux").isNotNull())
    sizes = good.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"))
    folded = with_ephemeris(good, eph.join(sizes, "target_id")).withColumn("x", phase_days("t", "period", "epoch"))
    b = F.least(F.lit(bins).cast("long"), F.col("_n"))
    index = F.least(F.floor((F.col("x") + F.col("period") / 2) / (F.col("period") / b)), b - 1).cast("int")
    w = 1 / (F.col("flux_err") * F.col("flux_err"))
    sums = folded.withColumn("bin", index).withColumn("w", w).groupBy("target_id", "bin").agg(
        F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("x")).alias("_wx"), F.sum(F.col("w") * F.col("flux")).alias("_wy"))
    return sums.select("target_id", "bin", (F.col("_wx") / F.col("_w")).alias("phase_days"),
                       (F.col("_wy") / F.col("_w")).alias("flux"), F.sqrt(1 / F.col("_w")).alias("error"))


def binned_depth(bins: DataFrame, eph: DataFrame) -> DataFrame:
    """Depth over the weighted phase bins (at most 100 rows per target) and the mean bin error."""
    x, d = F.abs("phase_days"), F.col("duration_hours") / 24.0
    sides = bins.join(eph, "target_id").groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_bins"), F.avg("error").alias("mean_error"),
        F.count_if(x <= d / 2).alias("n_in"), F.count_if(x >= d).alias("n_out"),
        F.expr("percentile(flux, 0.5e0) FILTER (WHERE abs(phase_days) <= duration_hours / 24e0 / 2)").alias("_in"),
        F.expr("percentile(flux, 0.5e0) FILTER (WHERE abs(phase_days) >= duration_hours / 24e0)").alias("_out"))
    depth = (F.col("_out") - F.col("_in")) * PPM
    status = (F.when(F.col("n_bins") < 10, "too few bins").when((F.col("n_in") < 3) | (F.col("n_out") < 3), "bins not populated")
              .when(~(depth > 0), "no positive depth").otherwise("measured"))
    return sides.select("target_id", "n_bins", "n_in", "n_out", "mean_error", depth.alias("depth_ppm"), status.alias("status"))


def event_count(df: DataFrame, eph: DataFrame) -> DataFrame:
    """Distinct observed events: cadences within half a duration (inclusive)."""
    near = with_cycle(df, eph, "rint").where(F.abs(phase_hours("t", "period", "epoch")) <= F.col("duration_hours") / 2)
    counts = near.groupBy("target_id").agg(F.countDistinct("cycle").alias("n_events"))
    return eph.select("target_id").distinct().join(counts, "target_id", "left").fillna(0, ["n_events"])


def exposure(df: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Median positive spacing of the cadences per group."""
    gaps = previous_value(df.select(*keys, "t"), keys, "t", time_piece("t")).select(
        *keys, (F.col("t") - F.col("previous")).alias("_gap")).where(F.col("_gap") > 0)
    return medians(gaps, keys, "_gap", "exposure", "n_gaps")


def oc_residuals(times: DataFrame, eph: DataFrame) -> DataFrame:
    """Minutes between each measured time and the linear ephemeris."""
    x = attach(times, eph, TARGET)
    cycle = F.rint((F.col("t_obs") - F.col("epoch")) / F.col("period"))
    return x.withColumn("cycle", cycle.cast("long")).withColumn(
        "oc_minutes", (F.col("t_obs") - (F.col("epoch") + cycle * F.col("period"))) * 1440.0)


def transit_windows(df: DataFrame, eph: DataFrame, half_hours: float = 13.0, min_rows: int = 100) -> DataFrame:
    """Native cadences around events with a dense sector index and each sector's exposure."""
    near = with_phase(df, eph).where(F.abs("phase_hours") <= half_hours)
    spacing = exposure(df, ["target_id", "sector"]).select("target_id", "sector", "exposure")
    # one row per (target, sector) here, so these windows span sector lists only
    sectors = near.groupBy("target_id", "sector").agg(F.count(F.lit(1)).alias("_c"))
    facts = sectors.join(spacing, ["target_id", "sector"], "left").selectExpr(
        "*", "CAST(dense_rank() OVER (PARTITION BY target_id ORDER BY sector) - 1 AS INT) AS sector_index",
        "sum(_c) OVER (PARTITION BY target_id) AS _all").where(F.col("_all") >= min_rows).drop("_c", "_all")
    return attach(near, facts, ["target_id", "sector"], spread=["t"])
