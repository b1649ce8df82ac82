"""Null controls, injection recovery and verdicts (IDs C10, C11, D9, H16-H19)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.fold import phase_hours
from fluxloom.operators import search, series, signals, variants
from fluxloom.operators.folding import exposure
from fluxloom.operators.spread import attach
from fluxloom.session import cut


@dataclass(frozen=True)
class SurveyConfig:
    """Frozen search and control settings of a survey."""

    durations_hours: Sequence[float] = (1.0, 2.0, 4.0)
    period_min: float = 0.5
    period_max: float = 20.0
    n_periods: int = 200
    detrend_window_days: float = 1.0
    gap_fraction: float = 0.5
    scramble_seeds: Sequence[int] = (5, 7, 11)
    period_tolerance: float = 0.01
    epoch_tolerance_durations: float = 1.0
    phase_offsets: Sequence[float] = (0.25, 0.5, 0.75)
    minimum_recovered: int = 2
    minimum_fraction: float = 2.0 / 3.0
    min_points: int = 50


@dataclass(frozen=True)
class SensitivityGrid:
    """Injection grid: period x duration x depth x phase."""

    periods: Sequence[float] = (0.75, 3.0, 10.0)
    durations_hours: Sequence[float] = (1.0, 2.0, 4.0)
    depths_ppm: Sequence[float] = (250.0, 1000.0, 2500.0)
    phases: Sequence[float] = (0.125, 0.375, 0.625, 0.875)


WILSON_Z = 1.959963984540054
BRANCHES = ("normalized", "running-median")
BOX = ("period", "epoch", "duration_hours", "depth_ppm")


def explode_values(df: DataFrame, name: str, values: Sequence[float]) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def injection_grid(df: DataFrame, grid: SensitivityGrid) -> DataFrame:
    """Every grid cell for every target, anchored at the target's first cadence."""
    x = df.groupBy("target_id").agg(F.min("t").alias("_t0"))
    for name, values in (("period", grid.periods), ("duration_hours", grid.durations_hours), ("depth_ppm", grid.depths_ppm), ("phase_offset", grid.phases)):
        x = explode_values(x, name, values)
    return x.select("target_id", "period", (F.col("_t0") + F.col("phase_offset") * F.col("period")).alias("epoch"),
                    "duration_hours", "depth_ppm", "phase_offset")


def candidate_injections(det: DataFrame, offsets: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Injections at the detected period, duration and depth, shifted in phase."""
    usable = det.where((F.col("period") > 0) & (F.col("duration_hours") > 0) & (F.col("depth_ppm") > 0)
                       & F.col("epoch").isNotNull() & F.col("snr").isNotNull() & (F.col("n_events") >= 2))
    x = explode_values(usable, "phase_offset", offsets)
    return x.select("target_id", "period", (F.col("epoch") + F.col("phase_offset") * F.col("period")).alias("epoch"),
                    "duration_hours", "depth_ppm", "phase_offset")


def both_branches(df: DataFrame, keys: Sequence[str], cfg: SurveyConfig) -> DataFrame:
    """The rows as they are and with a running-median trend divided out (errors unchanged)."""
    plain = cut(df.withColumnRenamed("flux_err", "_err"))
    flat = series.detrend(plain, cfg.detrend_window_days, True, cfg.gap_fraction, keys).drop("run")
    both = plain.withColumn("branch", F.lit(BRANCHES[0])).unionByName(flat.withColumn("branch", F.lit(BRANCHES[1])))
    return cut(both.withColumnRenamed("_err", "flux_err"))


def control_rows(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Signal, inverted and scrambled copies of every series in a ``control`` column."""
    base = df.select("target_id", "sector", "t", "flux", "flux_err")
    parts = [("signal", base), ("inverted", signals.invert(base))]
    parts += [(f"scramble-{seed}", series.scramble(base, seed)) for seed in cfg.scramble_seeds]
    return reduce(DataFrame.unionByName, [part.withColumn("control", F.lit(name)) for name, part in parts])


def held_branches(label, seen: variants.Observation, flux: np.ndarray, known: np.ndarray, cfg: SurveyConfig) -> Iterator[variants.Series]:
    """As ``both_branches`` for a variant of an observation that one task holds; a row without a sector has no run."""
    yield (label, BRANCHES[0]), seen, flux, known
    yield (label, BRANCHES[1]), seen, seen.flat(flux, known & seen.placed, cfg.detrend_window_days, cfg.gap_fraction), known & seen.placed


def long_rows(df: DataFrame, facts: DataFrame) -> DataFrame | None:
    """Rows of the targets that no task holds, None if there are none."""
    long = facts.where(F.col("n_points") > variants.ROWS_PER_TASK).select("target_id")
    return None if long.isEmpty() else attach(df, long, ["target_id"], spread=["t"])


def robustness_trials(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """Best box per (target, branch, control): all variants of an observation go through one search."""
    keys = ["target_id", "branch", "control"]
    base = df.select("target_id", "sector", "t", "flux", "flux_err")
    facts = variants.sizes(base)
    seeds = {f"scramble-{seed}": seed for seed in cfg.scramble_seeds}
    wanted = facts.select("target_id", F.explode(F.array(*[F.lit(name) for name in ("signal", "inverted", *seeds)])).alias("control"))

    def make(seen: variants.Observation, order: list[dict]) -> Iterator[variants.Series]:
        name = order[0]["control"]
        flux, known = seen.flux, seen.known
        if name == "inverted":
            flux = 2.0 - flux
        elif name in seeds:
            source = series.held_scramble(seen.key, seen.sector, seen.groups, seeds[name])
            flux, known = flux[source], known[source] & seen.placed
        yield from held_branches(name, seen, flux, known, cfg)

    found = variants.box_search_variants(base, facts, wanted, "control", make, len(BRANCHES), cfg)
    if (long := long_rows(base, facts)) is not None:
        rows = both_branches(control_rows(long, cfg), ["target_id", "sector", "control"], cfg)
        more = search.box_search(rows, keys, cfg.durations_hours, cfg.period_min, cfg.period_max, cfg.n_periods, min_points=cfg.min_points, shared=["target_id"])
        found = found.unionByName(more)
    # rows of no target form a series in which nothing is searched
    blind = search.series_facts(base.where(F.col("target_id").isNull()), ["target_id"], cfg.min_points)
    blind = blind.select("target_id", F.lit(BRANCHES[0]).alias("branch"), F.explode(F.array(F.lit("signal"), F.lit("inverted"))).alias("control"), F.lit(0).alias("n_events"))
    return search.select_duration(found.unionByName(blind, allowMissingColumns=True), keys)


def robustness(df: DataFrame, cfg: SurveyConfig) -> DataFrame:
    """One row per target: both signal branches and the strongest control."""
    trials = robustness_trials(df, cfg)
    cells = []
    for tag, branch in zip(("plain", "flat"), BRANCHES):
        here = (F.col("branch") == branch) & (F.col("control") == "signal")
        cells += [F.max(F.when(here, F.col(c))).alias(f"{tag}_{c}") for c in ("period", "snr", "n_events")]
    return trials.groupBy("target_id").agg(
        *cells, F.max(F.when(F.col("control") != "signal", F.col("snr"))).alias("max_control_snr"),
        F.count_if((F.col("control") != "signal") & F.col("snr").isNotNull()).alias("n_controls"))


def injection_recovery(df: DataFrame, injections: DataFrame, cfg: SurveyConfig, min_snr: float) -> DataFrame:
    """Recovery of each injection in both branches; a missing peak is not a recovery."""
    named = injections.withColumn("injection_id", F.xxhash64("period", "epoch", "duration_hours", "depth_ppm"))
    base = df.select("target_id", "sector", "t", "flux", "flux_err")
    facts = variants.sizes(base)
    wanted = named.select("target_id", "injection_id", *BOX)
    keys = ["target_id", "injection_id", "branch"]

    def make(seen: variants.Observation, order: list[dict]) -> Iterator[variants.Series]:
        spacing = seen.exposure()
        if spacing is None:
            return
        rows = seen if len(order) == 1 else seen.repeated(len(order))  # an injection that is wanted twice has its rows twice
        dimmed = signals.held_inject(rows.t, rows.flux, spacing, *(order[0][name] for name in BOX))
        yield from held_branches(order[0]["injection_id"], rows, dimmed, rows.known, cfg)

    found = variants.box_search_variants(base, facts, wanted, "injection_id", make, len(BRANCHES), cfg)
    if (long := long_rows(base, facts)) is not None:
        long = attach(long, exposure(long).select("target_id", "exposure"), ["target_id"], spread=["t"])
        dimmed = signals.inject(long, wanted)
        rows = both_branches(dimmed.select("target_id", "injection_id", "sector", "t", "flux", "flux_err"),
                             ["target_id", "sector", "injection_id"], cfg)
        more = search.box_search(rows, keys, cfg.durations_hours, cfg.period_min, cfg.period_max, cfg.n_periods, min_points=cfg.min_points, shared=["target_id"])
        found = found.unionByName(more)
    best = search.select_duration(found, keys).select(*keys, F.col("period").alias("_p"), F.col("epoch").alias("_e"), "snr", "n_events")
    every = explode_branches(named)
    x = every.join(best, keys, "left")
    no = F.lit(False)
    period_ok = F.coalesce(F.abs(F.col("_p") / F.col("period") - 1.0) <= cfg.period_tolerance, no)
    epoch_ok = F.coalesce(F.abs(phase_hours("_e", "period", "epoch")) <= F.col("duration_hours") * cfg.epoch_tolerance_durations, no)
    snr_ok = F.coalesce((F.col("snr") >= min_snr) & (F.col("n_events") >= 2), no)
    x = x.withColumn("period_match", period_ok).withColumn("epoch_match", epoch_ok).withColumn("snr_pass", snr_ok)
    return x.groupBy("target_id", "period", "epoch", "duration_hours", "depth_ppm", "phase_offset").agg(
        F.bool_and("period_match").alias("period_match"), F.bool_and("epoch_match").alias("epoch_match"),
        F.bool_and("snr_pass").alias("snr_pass"),
        F.bool_and(F.col("period_match") & F.col("epoch_match") & F.col("snr_pass")).alias("recovered"))


def explode_branches(df: DataFrame) -> DataFrame:
    return df.withColumn("branch", F.explode(F.array(*[F.lit(b) for b in BRANCHES])))


def recovery_summary(trials: DataFrame) -> DataFrame:
    """Recovery per grid cell and overall (NULL cell) with the Wilson 95 % interval."""
    cell = ["target_id", "period", "duration_hours", "depth_ppm"]
    sets = [[F.col(c) for c in cell], [F.col("target_id")]]
    s = trials.groupingSets(sets, *cell).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("recovered").alias("recovered"))
    n, k = F.col("trials"), F.col("recovered")
    p, zz = k / n, WILSON_Z * WILSON_Z
    centre = (p + zz / (2.0 * n)) / (1.0 + zz / n)
    half = WILSON_Z * F.sqrt((p * (1.0 - p) + zz / (4.0 * n)) / n) / (1.0 + zz / n)
    return s.withColumn("fraction", p).withColumn(
        "lower", F.when(k == 0, 0.0).otherwise(F.greatest(centre - half, F.lit(0.0)))).withColumn(
        "upper", F.when(k == n, 1.0).otherwise(F.least(centre + half, F.lit(1.0))))


def sensitivity(df: DataFrame, grid: SensitivityGrid, cfg: SurveyConfig, min_snr: float) -> DataFrame:
    return recovery_summary(injection_recovery(df, injection_grid(df, grid), cfg, min_snr))


def robustness_verdict(reference: DataFrame, controls: DataFrame, recovery: DataFrame, review_snr: float, cfg: SurveyConfig) -> DataFrame:
    """Alert only if both branches repeat the signal, controls stay quiet and enough
    phase-shifted copies are recovered. Anything missing fails."""
    r = recovery.groupBy("target_id").agg(F.count(F.lit(1)).alias("trials"), F.count_if("recovered").alias("recovered"))
    x = reference.select("target_id", F.col("period").alias("ref_period"), F.col("snr").alias("ref_snr"), F.col("n_events").alias("ref_events"))
    x = x.join(controls, "target_id", "left").join(r, "target_id", "left").fillna(0, ["trials", "recovered"])
    agree = lambda c: F.abs(F.col(c) / F.col("ref_period") - 1.0) <= cfg.period_tolerance
    strong = (F.col("ref_snr") >= review_snr) & (F.col("plain_snr") >= review_snr) & (F.col("flat_snr") >= review_snr)
    seen = (F.col("ref_events") >= 2) & (F.col("plain_n_events") >= 2) & (F.col("flat_n_events") >= 2)
    quiet = F.col("max_control_snr") < review_snr
    found = ((F.col("trials") == len(cfg.phase_offsets)) & (F.col("recovered") >= cfg.minimum_recovered)
             & (F.col("recovered") / F.greatest(F.col("trials"), F.lit(1)) >= cfg.minimum_fraction))
    passed = strong & seen & agree("plain_period") & agree("flat_period") & quiet & found
    flags = [("strong", strong), ("seen", seen), ("agrees", agree("plain_period") & agree("flat_period")), ("quiet", quiet), ("recovered_enough", found)]
    return x.select("target_id", "trials", "recovered", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags],
                    F.coalesce(passed, F.lit(False)).alias("passed"))
