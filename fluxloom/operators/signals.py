"""Box injection, event masking and inverted controls (IDs H13-H15)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.fold import box_overlap
from fluxloom.operators.folding import exposure
from fluxloom.operators.spread import attach

TARGET = ("target_id",)


def with_exposure(df: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Use a declared exposure column, else the median positive spacing."""
    if "exposure" in df.columns:
        return df
    return attach(df, exposure(df, keys).select(*keys, "exposure"), keys, spread=["t"])


def with_overlap(df: DataFrame, events: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Join box events to cadences and add the exposure fraction inside the box."""
    joined = attach(with_exposure(df, keys), events, keys, spread=["t"])
    return joined.withColumn("overlap", box_overlap("t", "exposure", "period", "epoch", "duration_hours"))


def inject(df: DataFrame, injections: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """Dim every cadence by its overlap; one output series per injection row of the target."""
    out = with_overlap(df, injections, keys)
    return out.withColumn("flux", F.col("flux") * (1.0 - F.col("depth_ppm") * 1e-6 * F.col("overlap")))


def held_inject(t: np.ndarray, flux: np.ndarray, exposure: float, period: float, epoch: float, duration_hours: float, depth_ppm: float) -> np.ndarray:
    """As ``inject`` for one series, whose rows one task holds."""
    half = duration_hours / 24.0 / 2
    centre = epoch + np.rint((t - epoch) / period) * period
    shared = np.minimum(t + exposure / 2, centre + half) - np.maximum(t - exposure / 2, centre - half)
    overlap = np.minimum(np.maximum(shared, 0.0) / exposure, 1.0)
    return flux * (1.0 - depth_ppm * 1e-6 * overlap)


def mask_events(df: DataFrame, eph: DataFrame, keys: Sequence[str] = TARGET) -> DataFrame:
    """NULL the flux of every cadence that touches an event."""
    out = with_overlap(df, eph, keys).withColumn("masked", F.col("overlap") > 0)
    return out.withColumn("flux", F.when(~F.col("masked"), F.col("flux")))


def invert(df: DataFrame) -> DataFrame:
    """Reflect normalised flux about one."""
    return df.withColumn("flux", 2.0 - F.col("flux"))
