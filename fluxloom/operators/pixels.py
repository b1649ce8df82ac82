"""Pixel operators (IDs B6, C13, D12-D16, H29)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.fold import phase_hours, window_label
from fluxloom.operators.folding import transit_depth
from fluxloom.operators.spread import attach, medians, quantiles

GROUP = ["target_id", "sector"]
CADENCE = [*GROUP, "t"]
HARD_MASK = 24319  # fixed value: quality bits that exclude a cadence
HALF_SIZES = (1, 2, 3)
PIXEL_ARCSEC = 21.0
CORE_FRACTION = 0.2
MIN_CORE = 3
PRF_SIGMA = 0.75 / 2.3548  # fixed value: width of the point-source template in pixels


def hard_quality(px: DataFrame, mask: int = HARD_MASK) -> DataFrame:
    """Pixels of cadences without a masked quality bit and with every pixel finite."""
    finite = F.col("flux").isNotNull() & ~F.isnan("flux") & (F.abs("flux") < float("inf"))
    good = px.where(F.col("t").isNotNull() & (F.col("quality").bitwiseAND(F.lit(mask)) == 0))
    whole = good.groupBy(*CADENCE).agg(F.bool_and(finite).alias("_ok")).where("_ok").drop("_ok")
    return good.join(whole, CADENCE, "left_semi")


def aperture_pixels(aperture: DataFrame, half_sizes=HALF_SIZES) -> DataFrame:
    """Pixel membership of square boxes around the aperture centroid and of the pipeline mask.

    The aperture table has one row per (target, sector, x, y); a mask without any
    pipeline pixel counts as full.
    """
    inside = F.col("bits").bitwiseAND(F.lit(2)) != 0
    c = aperture.groupBy(*GROUP).agg(
        F.coalesce(F.avg(F.when(inside, F.col("x"))), F.avg("x")).alias("cx"), F.coalesce(F.avg(F.when(inside, F.col("y"))), F.avg("y")).alias("cy"),
        F.bool_or(inside).alias("_any"))
    x = aperture.join(c, GROUP)
    near = F.greatest(F.abs(F.col("x") - F.col("cx")), F.abs(F.col("y") - F.col("cy")))
    names = [F.when(near <= h, F.lit(f"box_{2 * h + 1}x{2 * h + 1}")) for h in half_sizes]
    names.append(F.when(inside | ~F.col("_any"), F.lit("pipeline")))
    return x.select(*GROUP, "x", "y", F.explode(F.array_compact(F.array(*names))).alias("aperture"))


def aperture_flux(px: DataFrame, aperture: DataFrame) -> DataFrame:
    """Summed flux per cadence and aperture."""
    member = aperture_pixels(aperture)
    joined = attach(px, member, [*GROUP, "x", "y"], parts=4, spread=["t"])
    return joined.groupBy(*CADENCE, "aperture").agg(F.sum("flux").alias("flux"), F.count(F.lit(1)).alias("n_pixels"))


def aperture_depths(apflux: DataFrame, eph: DataFrame, min_cadences: int = 100) -> DataFrame:
    """Depth per (target, sector, aperture) after dividing by the median flux."""
    keys = [*GROUP, "aperture"]
    level = medians(apflux, keys, "flux", "_m", "_n").where((F.col("_n") >= min_cadences) & (F.col("_m") > 0))
    x = attach(apflux, level, keys, spread=["t"]).withColumn("flux", F.col("flux") / F.col("_m"))
    return transit_depth(x, eph, keys).where(F.col("depth_ppm").isNotNull())


def depth_stability(depths: DataFrame) -> DataFrame:
    """Spread of aperture depths per target (sectors x apertures, a handful of rows each)."""
    d = depths.withColumn("d", F.round("depth_ppm", 2))
    s = d.groupBy("target_id").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("min_ppm"), F.max("d").alias("max_ppm"), F.expr("percentile(d, 0.5e0)").alias("median_ppm"))
    ratio = (F.col("max_ppm") - F.col("min_ppm")) / F.greatest(F.col("median_ppm"), F.lit(1e-9))
    return s.withColumn("variation", ratio).withColumn("verdict", F.when(F.col("variation") < 0.3, "stable").otherwise("aperture-sensitive"))


def aperture_summary(depths: DataFrame) -> DataFrame:
    return depths.withColumn("d", F.round("depth_ppm", 2)).groupBy("target_id", "aperture").agg(
        F.count(F.lit(1)).alias("n_sectors"), F.expr("percentile(d, 0.5e0)").alias("median_ppm"), F.min("d").alias("min_ppm"), F.max("d").alias("max_ppm"))


def difference_image(px: DataFrame, eph: DataFrame, min_side: int = 10) -> DataFrame:
    """Median out minus median in per pixel, where both sides have enough cadences."""
    x = attach(px, eph, ["target_id"], spread=["t"])
    x = x.withColumn("window", window_label(phase_hours("t", "period", "epoch"), "duration_hours")).where(F.col("window").isNotNull())
    m = quantiles(x, [*GROUP, "x", "y", "window"], "flux", [0.5], ["m"], "n")
    side = lambda w, c: F.max(F.when(F.col("window") == w, F.col(c)))
    d = m.groupBy(*GROUP, "x", "y").agg(side("in", "m").alias("m_in"), side("baseline", "m").alias("m_out"),
                                       side("in", "n").alias("n_in"), side("baseline", "n").alias("n_out"))
    return d.where((F.col("n_in") >= min_side) & (F.col("n_out") >= min_side)).select(
        *GROUP, "x", "y", (F.col("m_out") - F.col("m_in")).alias("difference"), "n_in", "n_out")


def difference_centroid(img: DataFrame, position: DataFrame) -> DataFrame:
    """Flux-weighted centroid of the pixels above a fifth of the peak, as offsets in arcsec."""
    peak = img.groupBy(*GROUP).agg(F.max("difference").alias("_peak"), F.count("difference").alias("_n"))
    x = img.join(peak, GROUP)
    core = (F.col("_peak") > 0) & (F.col("_n") >= 3) & (F.col("difference") >= F.col("_peak") * CORE_FRACTION)
    d = F.when(core, F.col("difference"))
    s = x.groupBy(*GROUP).agg(F.count(d).alias("n_core"), (F.sum(d * F.col("x")) / F.sum(d)).alias("_cx"), (F.sum(d * F.col("y")) / F.sum(d)).alias("_cy"))
    y = s.join(position, "target_id")
    solved = F.col("n_core") >= MIN_CORE
    ra = F.when(solved, (F.col("_cx") - F.col("target_x")) * PIXEL_ARCSEC * F.greatest(F.col("cos_dec"), F.lit(0.01)))
    dec = F.when(solved, (F.col("_cy") - F.col("target_y")) * PIXEL_ARCSEC)
    return y.select(*GROUP, "n_core", ra.alias("ra_offset"), dec.alias("dec_offset"), F.hypot(ra, dec).alias("offset"))


def localization_summary(centroids: DataFrame) -> DataFrame:
    """Per-target summary over sectors; the status never goes beyond inconclusive."""
    s = centroids.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_sectors"), F.count_if(F.col("n_core") < MIN_CORE).alias("n_unresolved"), F.expr("percentile(offset, 0.5e0)").alias("median_offset"))
    return s.withColumn("status", F.when(F.col("n_sectors") == 0, "inconclusive_no_complete_depth_maps")
                        .when(F.col("n_unresolved") > 0, "inconclusive_insufficient_difference_core").otherwise("inconclusive_uncalibrated_prf"))


def nonnegative_solve(g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with non-negative amplitudes from the Gram matrix, by an active set.

    The unknown that lowers the residual fastest joins the free ones; when a free one would turn negative, the step
    ends where the first of them reaches zero. Each full step lowers the residual, so no set comes twice.
    """
    n = len(b)
    x, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-12 * max(float(np.abs(b).max(initial=0.0)), 1e-300)
    for _ in range(3 * n + 10):
        slope = np.where(free, -np.inf, b - g @ x)
        k = int(slope.argmax())
        if free.all() or slope[k] <= tolerance:
            break
        free[k] = True
        while free.any():
            own = np.flatnonzero(free)
            full, *_ = np.linalg.lstsq(g[np.ix_(own, own)], b[own], rcond=None)
            if (full > 0).all():
                x[:] = 0.0
                x[own] = full
                break
            low = full <= 0
            part = np.min(x[own][low] / np.maximum(x[own][low] - full[low], 1e-300))
            x[own] += part * (full - x[own])
            free[own[low & (x[own] <= 1e-14 * max(x.max(), 1e-300))]] = False
            x[~free] = 0.0
    return x


def source_amplitudes(img: DataFrame, sources: DataFrame, min_pixels: int = 5) -> DataFrame:
    """Non-negative template amplitudes of the target and its neighbours.

    Spark sums the Gram matrix over pixels; the helper solves the small system.
    ``sources`` has ``target_id, source_index, x_pix, y_pix, is_target``.
    """
    pairs = img.join(sources, "target_id")
    dx, dy = F.col("x") - F.col("x_pix"), F.col("y") - F.col("y_pix")
    pairs = pairs.withColumn("v", F.exp((dx * dx + dy * dy) / (-2.0 * PRF_SIGMA * PRF_SIGMA)))
    keys = [*GROUP, "source_index"]
    total = pairs.groupBy(*keys).agg(F.sum("v").alias("_t"), F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= min_pixels) & (F.col("_t") > 0))
    unit = pairs.join(total, keys).select(*GROUP, "x", "y", "difference", "source_index", "is_target", (F.col("v") / F.col("_t")).alias("v"))
    # the sources of a stamp share its pixels
    per_pixel = unit.groupBy(*GROUP, "x", "y", "difference").agg(F.collect_list(F.struct("source_index", "v", "is_target")).alias("s"))
    rows = per_pixel.select(*GROUP, "difference", "s", F.explode("s").alias("a"))
    cross = rows.select(*GROUP, F.col("a.source_index").alias("i"), F.col("a.is_target").alias("is_target"), (F.col("a.v") * F.col("difference")).alias("p"),
                        F.col("a.v").alias("va"), F.explode("s").alias("b"))
    gram = cross.groupBy(*GROUP, "i", F.col("b.source_index").alias("j")).agg(
        F.sum(F.col("va") * F.col("b.v")).alias("g"), F.sum("p").alias("p"), F.max("is_target").alias("is_target"))

    def solve(key, cells: pd.DataFrame) -> pd.DataFrame:
        names = sorted(cells["i"].unique())
        g = cells.pivot(index="i", columns="j", values="g").loc[names, names].to_numpy(float)
        one = cells.drop_duplicates("i").set_index("i").loc[names]
        return pd.DataFrame({"target_id": key[0], "sector": key[1], "source_index": names, "is_target": one["is_target"].to_numpy(bool),
                             "amplitude": nonnegative_solve(g, one["p"].to_numpy(float))})

    kinds = dict(gram.dtypes)
    return gram.groupBy(*GROUP).applyInPandas(
        solve, f"target_id {kinds['target_id']}, sector {kinds['sector']}, source_index {kinds['i']}, is_target boolean, amplitude double")
