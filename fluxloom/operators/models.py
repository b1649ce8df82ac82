"""Timing, phase-curve, velocity and spectral-energy models (IDs H20-H28, D22).

Every model is a sum over rows on an exploded parameter grid, or a normal matrix
aggregated by Spark; only the final small linear system of a target is solved in
numpy. H26 and H27 return grid optima and grid posteriors, not sampler output; H26 searches each
instrument's jitter in numpy on sums of one grid point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.fold import floored_mod, phase_days
from fluxloom.operators.robust import LEVELS, percentile_summary, weighted_percentiles
from fluxloom.operators.spread import attach, fan_out, medians, running_sum
from fluxloom.session import settle

TAU = 2.0 * math.pi
TARGET = ["target_id"]


# ---- event timing -------------------------------------------------------------------

def trapezoid(dt: Column, depth: Column, duration_hours: Column, ingress_hours: Column) -> Column:
    depth_fraction = (duration_hours / 48.0 - F.abs(dt)) / (ingress_hours / 24.0)
    return 1.0 - depth * F.least(F.greatest(depth_fraction, F.lit(0.0)), F.lit(1.0))


def event_times(df: DataFrame, template: DataFrame, window_days: float = 0.35, half_steps: int = 20, step_days: float = 0.001,
                min_points: int = 30) -> DataFrame:
    """Centre time of every event: chi-square grid, parabolic refinement, curvature error.

    ``template`` has ``period, epoch, depth, duration_hours, ingress_hours`` per target.
    """
    x = attach(df.where(F.col("flux").isNotNull() & (F.col("flux_err") > 0)), template, TARGET, spread=["t"])
    cycle = F.rint((F.col("t") - F.col("epoch")) / F.col("period"))
    x = x.withColumn("cycle", cycle.cast("long")).withColumn("centre", F.col("epoch") + cycle * F.col("period"))
    x = x.withColumn("dt", F.col("t") - F.col("centre")).where(F.abs("dt") < window_days)
    near = x.select("target_id", "cycle", "centre", "dt", "flux", "flux_err", "depth", "duration_hours", "ingress_hours")

    def chi2(shift: Column) -> Column:
        r = (F.col("flux") - trapezoid(F.col("dt") - shift, F.col("depth"), F.col("duration_hours"), F.col("ingress_hours"))) / F.col("flux_err")
        return F.sum(r * r)

    event = ["target_id", "cycle", "centre"]
    trials = near.withColumn("j", F.explode(F.sequence(F.lit(-half_steps), F.lit(half_steps))))
    grid = trials.groupBy(*event, "j").agg(F.count(F.lit(1)).alias("n"), chi2(F.col("j") * step_days).alias("x2")).where(F.col("n") >= min_points)
    # one event has 2 * half_steps + 1 trials
    g = grid.groupBy(*event).agg(F.max("n").alias("n"), F.min_by("j", F.struct(F.round("x2", 9), F.col("j"))).alias("j"),
                                F.map_from_entries(F.collect_list(F.struct("j", "x2"))).alias("_m"))
    a, b, c = (F.try_element_at("_m", F.col("j") + d) for d in (-1, 0, 1))
    bend = a - 2.0 * b + c
    shift = F.col("j") * step_days + F.when(F.abs(bend) > 1e-12, (a - c) / bend * (0.5 * step_days)).otherwise(0.0)
    fitted = g.select(*event, "n", F.coalesce(shift, F.col("j") * step_days).alias("shift"))
    again = attach(near, fitted.drop("centre", "n"), ["target_id", "cycle"], parts=4, spread=["dt"])
    three = again.groupBy("target_id", "cycle").agg(*[chi2(F.col("shift") + d * step_days).alias(f"x{i}") for i, d in enumerate((-1.0, 0.0, 1.0))])
    curve = (F.col("x2") - 2.0 * F.col("x1") + F.col("x0")) / (step_days * step_days)
    sigma = F.when(curve > 0, F.sqrt(2.0 / F.when(curve > 0, curve))).otherwise(step_days)
    return fitted.join(three, ["target_id", "cycle"]).select(
        "target_id", "cycle", "n", (F.col("centre") + F.col("shift")).alias("t_obs"),
        F.least(F.greatest(sigma, F.lit(0.0005)), F.lit(0.05)).alias("sigma"), F.col("x1").alias("chi2"))


def linear_ephemeris(times: DataFrame) -> DataFrame:
    """Weighted line through (cycle, time), cycles centred on their rounded median."""
    good = times.where(F.col("t_obs").isNotNull() & F.col("cycle").isNotNull() & (F.col("sigma") > 0))
    mid = medians(good, TARGET, "cycle", "_mid", "n_events").withColumn("reference_cycle", F.rint("_mid").cast("long")).drop("_mid")
    anchor = good.groupBy(*TARGET).agg(F.min("t_obs").alias("_t0"))
    facts = mid.join(anchor, TARGET)
    x = attach(good, facts, TARGET, spread=["t_obs"]).withColumn("_x", (F.col("cycle") - F.col("reference_cycle")).cast("double"))
    x = x.withColumn("_y", F.col("t_obs") - F.col("_t0")).withColumn("_w", 1.0 / (F.col("sigma") * F.col("sigma")))
    w, u, y = F.col("_w"), F.col("_x"), F.col("_y")
    s = x.groupBy(*TARGET).agg(F.max("n_events").alias("n_events"), F.max("reference_cycle").alias("reference_cycle"), F.max("_t0").alias("_t0"), F.sum(w).alias("s0"),
                              F.sum(w * u).alias("s1"), F.sum(w * u * u).alias("s2"), F.sum(w * y).alias("y0"), F.sum(w * u * y).alias("y1"))
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    ok = (F.col("n_events") >= 2) & (det > F.col("s0") * F.col("s2") * 1e-12)
    d = F.when(ok, det)
    fit = s.select("target_id", "n_events", "reference_cycle", "_t0", ((F.col("s2") * F.col("y0") - F.col("s1") * F.col("y1")) / d).alias("_a"),
                   ((F.col("s0") * F.col("y1") - F.col("s1") * F.col("y0")) / d).alias("period"), F.sqrt(F.col("s2") / d).alias("epoch_sigma"),
                   F.sqrt(F.col("s0") / d).alias("period_sigma"), (-F.col("s1") / d).alias("covariance"))
    res = attach(good, fit.select("target_id", "_t0", "_a", "period", "reference_cycle"), TARGET, spread=["t_obs"])
    r = F.col("t_obs") - F.col("_t0") - F.col("_a") - F.col("period") * (F.col("cycle") - F.col("reference_cycle"))
    chi = res.groupBy(*TARGET).agg(F.sum(r * r / (F.col("sigma") * F.col("sigma"))).alias("chi2"), (F.sqrt(F.avg(r * r)) * 1440.0).alias("oc_rms_minutes"))
    out = fit.join(chi, TARGET)
    return out.select("target_id", "n_events", "reference_cycle", (F.col("_t0") + F.col("_a")).alias("epoch"), "period", "epoch_sigma", "period_sigma", "covariance",
                      "chi2", (F.col("n_events") - 2).alias("dof"), "oc_rms_minutes",
                      F.when(F.col("n_events") < 2, "not-fit-insufficient-transits").when(F.col("period").isNull(), "not-fit-singular-normal-matrix").otherwise("fit").alias("status"))


def super_periods(eph: DataFrame, companions: DataFrame) -> DataFrame:
    """Timing super-period of every declared outer companion for j = 2, 3, 4; a target listed twice counts once."""
    x = companions.join(eph.groupBy("target_id").agg(F.any_value("period").alias("period")), "target_id").where(F.col("companion_period") > F.col("period"))
    x = x.withColumn("j", F.explode(F.array(*[F.lit(j) for j in (2, 3, 4)])))
    rate = F.abs(F.col("j") / F.col("companion_period") - (F.col("j") - 1) / F.col("period"))
    return x.select("target_id", "companion_period", "j", F.when(rate == 0, F.lit(float("inf"))).otherwise(1.0 / F.when(rate > 0, rate)).alias("super_period"))


# ---- phase curve ---------------------------------------------------------------------

PHYSICAL = ("reflection", "beaming", "ellipsoidal", "sine_control", "eclipse_depth")
LOCAL = ("offset", "slope", *PHYSICAL)
PAIRS = [(i, j) for i in range(len(LOCAL)) for j in range(i, len(LOCAL))]
BLOCK_DAYS = 0.5


def phase_design(df: DataFrame, eph: DataFrame, mask: float = 0.65, eclipse_phase: float = 0.5) -> DataFrame:
    """Cadences outside the primary event with the seven columns that are non-zero in their sector."""
    keys = ["target_id", "sector"]
    x = attach(df.where(F.col("flux").isNotNull() & (F.col("flux_err") > 0)), eph, TARGET, spread=["t"])
    x = x.withColumn("_ph", phase_days("t", "period", "epoch")).where(F.abs("_ph") > F.col("duration_hours") / 24.0 * mask)
    mid = medians(x, keys, "t", "_mid").drop("n").join(x.groupBy(*keys).agg(F.min("t").alias("_first")), keys)
    x = attach(x, mid, keys, spread=["t"])
    angle = F.col("_ph") / F.col("period") * TAU
    far = F.abs(floored_mod(F.col("_ph") / F.col("period") - eclipse_phase + 0.5, F.lit(1.0)) - 0.5)
    eclipse = F.when(far < F.col("duration_hours") / 48.0 / F.col("period"), -1.0).otherwise(0.0)
    columns = [F.lit(1.0), F.col("t") - F.col("_mid"), -F.cos(angle), F.sin(angle), -F.cos(angle * 2), F.sin(angle * 2), eclipse]
    return x.select(*keys, "t", F.floor((F.col("t") - F.col("_first")) / BLOCK_DAYS).alias("block"), (1.0 / (F.col("flux_err") * F.col("flux_err"))).alias("w"),
                    F.col("flux").alias("y"), *[c.alias(f"c{i}") for i, c in enumerate(columns)])


def assembled(rows: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """Full normal-type matrix from per-sector pair sums: sector columns first, shared columns last."""
    k = 2 * len(rows)
    out = np.zeros((k + 5, k + 5))
    for s, row in enumerate(rows[list(names)].to_numpy(float)):
        at = [2 * s, 2 * s + 1, *range(k, k + 5)]
        for v, (i, j) in zip(row, PAIRS):
            out[at[i], at[j]] += v
            if i != j:
                out[at[j], at[i]] += v
    return out


def phase_curve(df: DataFrame, eph: DataFrame, min_rows: int = 100) -> DataFrame:
    """Sector baselines, four harmonics and an eclipse box with cluster-robust errors.

    Two aggregations build the normal matrix and the per-block score products; the
    sandwich covariance of a target is finished on its sectors' 28 sums each.
    """
    keys = ["target_id", "sector"]
    design = phase_design(df, eph)
    pair = lambda i, j: F.sum(F.col("w") * F.col(f"c{i}") * F.col(f"c{j}"))
    normal = design.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[pair(i, j).alias(f"n{i}{j}") for i, j in PAIRS],
                                       *[F.sum(F.col("w") * F.col("y") * F.col(f"c{i}")).alias(f"y{i}") for i in range(7)])
    kind = dict(df.dtypes)
    normal_names = [f"n{i}{j}" for i, j in PAIRS]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sector", ignore_index=True)
        m = assembled(pdf, normal_names)
        k = 2 * len(pdf)
        rhs = np.zeros(k + 5)
        ys = pdf[[f"y{i}" for i in range(7)]].to_numpy(float)
        rhs[0:k:2], rhs[1:k:2], rhs[k:] = ys[:, 0], ys[:, 1], ys[:, 2:].sum(axis=0)
        beta = np.linalg.pinv(m) @ rhs
        out = pdf[["target_id", "sector"]].assign(b0=beta[0:k:2], b1=beta[1:k:2])
        return out.assign(**{f"b{i + 2}": beta[k + i] for i in range(5)})

    coefficients = ", ".join(f"b{i} double" for i in range(7))
    enough = normal.groupBy("target_id").agg(F.sum("n").alias("_all")).where(F.col("_all") >= min_rows).select("target_id")
    normal = normal.join(enough, "target_id", "left_semi")
    beta = normal.groupBy("target_id").applyInPandas(solve, f"target_id {kind['target_id']}, sector {kind['sector']}, {coefficients}")
    fitted = attach(design, beta, keys, spread=["t"])
    model = sum((F.col(f"b{i}") * F.col(f"c{i}") for i in range(1, 7)), F.col("b0") * F.col("c0"))
    r = F.col("y") - model
    scores = fitted.groupBy(*keys, "block").agg(*[F.sum(F.col("w") * F.col(f"c{i}") * r).alias(f"s{i}") for i in range(7)])
    meat = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}{j}") for i, j in PAIRS])
    meat_names = [f"m{i}{j}" for i, j in PAIRS]

    def report(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sector", ignore_index=True)
        bread = np.linalg.pinv(assembled(pdf, normal_names))
        n, g, k = int(pdf["n"].sum()), int(pdf["blocks"].sum()), 2 * len(pdf)
        p = k + 5
        scale = n / max(n - p, 1) if g < 2 or n <= p else g / (g - 1.0) * (n - 1.0) / (n - p)
        errors = np.sqrt(np.maximum(np.diag(scale * bread @ assembled(pdf, meat_names) @ bread), 0.0))
        return pd.DataFrame({"target_id": pdf["target_id"].iloc[0], "component": PHYSICAL, "amplitude_ppm": pdf[[f"b{i + 2}" for i in range(5)]].iloc[0].to_numpy(float) * 1e6,
                             "error_ppm": errors[k:] * 1e6, "n_points": n, "n_clusters": g})

    full = normal.join(beta, keys).join(meat, keys)
    return full.groupBy("target_id").applyInPandas(
        report, f"target_id {kind['target_id']}, component string, amplitude_ppm double, error_ppm double, n_points long, n_clusters long")


# ---- eclipse template over posterior draws ---------------------------------------------

def eclipse_geometry(e: Column, omega: Column, rp: Column, b: Column) -> tuple[Column, Column]:
    """Eclipse phase and duration ratio of one draw; NULL where the planet is not occulted.

    With k = e sin(omega), transit and eclipse lie at the radii (1 - e^2) / (1 + k) and
    (1 - e^2) / (1 - k); their eccentric anomalies have opposite sines, so Kepler's equation
    gives the time between them in closed form.
    """
    k, width = e * F.sin(omega), F.sqrt(F.greatest(1 - e * e, F.lit(0.0)))
    side = width * F.cos(omega)
    between = F.atan2(-side, e - F.sin(omega)) - F.atan2(side, e + F.sin(omega)) + e * side * 2 / (1 - k * k)
    far = (1 + k) / (1 - k)  # ratio of the distances, and of the speeds the other way round
    reach = (rp + 1) * (rp + 1)
    seen = e.between(0, 1) & (e < 1) & (rp > 0) & (b >= 0) & (F.abs(k) < 1) & (reach > b * b) & (reach > b * far * b * far)
    safe = lambda c: F.when(seen, c)
    return safe(floored_mod(between, F.lit(TAU)) / TAU), safe(far * F.sqrt((reach - b * far * b * far) / F.nullif(reach - b * b, F.lit(0.0))))


def eclipse_draws(chain: DataFrame) -> DataFrame:
    phase, ratio = eclipse_geometry(F.col("e"), F.col("omega"), F.col("rp"), F.col("b"))
    return chain.withColumn("phase", phase).withColumn("duration_ratio", ratio)


def eclipse_template(df: DataFrame, eph: DataFrame, draws: DataFrame) -> DataFrame:
    """Fraction of all draws whose eclipse covers each cadence.

    Every draw becomes the ends of its phase interval; a running count along phase, summed
    piece by piece, gives the number of open intervals at each cadence. Nothing is collected.
    """
    facts = eph.select("target_id", "period", "epoch", "duration_hours").join(draws.groupBy("target_id").agg(F.count(F.lit(1)).alias("_total")), "target_id")
    rows = attach(df, facts.select("target_id", F.col("period").alias("_p"), F.col("epoch").alias("_e"), "_total"), TARGET, spread=["t"])
    turn = floored_mod(phase_days("t", "_p", "_e") / F.col("_p"), F.lit(1.0))
    rows = rows.select("target_id", F.struct(*df.columns).alias("_row"), "_total", turn.alias("x"), F.lit(1).alias("side"), F.lit(0).alias("step"))
    seen = attach(draws.where(F.col("phase").isNotNull()), facts.select("target_id", (F.col("duration_hours") / 48.0 / F.col("period")).alias("_h")), TARGET, spread=["phase"])
    half = F.col("_h") * F.col("duration_ratio")
    low, high = F.col("phase") - half, F.col("phase") + half
    edge = lambda x, side, step: F.struct(x.cast("double").alias("x"), F.lit(side).alias("side"), F.lit(step).alias("step"))
    always = edge(F.lit(-1.0), 2, 1)
    ends = (F.when(half >= 0.5, F.array(always)).when(low < 0, F.array(always, edge(high, 0, -1), edge(low + 1, 2, 1)))
            .when(high > 1, F.array(always, edge(high - 1, 0, -1), edge(low, 2, 1))).otherwise(F.array(edge(low, 2, 1), edge(high, 0, -1))))
    ends = seen.select("target_id", F.explode(ends).alias("v")).groupBy("target_id", "v.x", "v.side").agg(F.sum("v.step").cast("int").alias("step"))
    both = rows.unionByName(ends, allowMissingColumns=True)
    # an interval is open: its end counts before a cadence at the same phase, its start after
    counted = running_sum(both, TARGET, ["x", "side"], F.floor(F.col("x") * 256).cast("int"), "step", "_open").where(F.col("_row").isNotNull())
    return counted.select("_row.*", (F.col("_open") / F.col("_total")).alias("template"))


def circular_phase_summary(draws: DataFrame) -> DataFrame:
    """Percentiles of a phase around its circular mean, so an interval may cross zero."""
    d = draws.where(F.col("phase").isNotNull())
    mean = d.groupBy("target_id").agg(F.atan2(F.avg(F.sin(F.col("phase") * TAU)), F.avg(F.cos(F.col("phase") * TAU))).alias("_a"))
    mean = mean.select("target_id", floored_mod(F.col("_a") / TAU, F.lit(1.0)).alias("_ref"))
    x = attach(d, mean, TARGET).withColumn("value", floored_mod(F.col("phase") - F.col("_ref") + 0.5, F.lit(1.0)) - 0.5)
    s = percentile_summary(x, TARGET).join(mean, TARGET)
    back = lambda c: floored_mod(F.col("_ref") + F.col(c), F.lit(1.0))
    return s.select("target_id", "n", back("median").alias("median"), back("p16").alias("p16"), back("p84").alias("p84"),
                    (back("p16") > back("p84")).alias("wraps"), ((F.col("p84") - F.col("p16")) * 0.5).alias("half_width"))


# ---- radial velocities -------------------------------------------------------------------

def true_anomaly(mean: Column, e: Column, rounds: int = 8) -> Column:
    """Kepler's equation by a fixed number of Newton steps."""
    big = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), mean + e * F.sin(mean),
                      lambda x, _: x - (x - e * F.sin(x) - mean) / (F.lit(1.0) - e * F.cos(x)))
    return F.atan2(F.sqrt(1 + e) * F.sin(big / 2), F.sqrt(1 - e) * F.cos(big / 2)) * 2


ORBIT = (0, 1, 2, 3)  # trend, cosine and sine of the true anomaly, activity
FLAT = (0, 3)


def solve_shared(block: np.ndarray, use: Sequence[int]) -> tuple[np.ndarray, float]:
    """Coefficients of the shared terms in ``use`` and the chi-square left, from the 5x5 block whose last row is the velocity.

    Terms are eliminated one after the other; one that the others explain (or that is constant) gets 0.
    """
    m, done = block.copy(), []
    for k in use:
        if m[k, k] > 1e-10 * max(block[k, k], 1e-300):
            done.append((k, m[k].copy()))
            m = m - np.outer(m[k], m[k]) / m[k, k]
    beta = np.zeros(4)
    for k, row in reversed(done):
        beta[k] = (row[4] - sum(row[j] * beta[j] for j, _ in done if j != k)) / row[k]
    return beta, max(float(m[4, 4]), 0.0)


def jitter_search(blocks: np.ndarray, norms: np.ndarray, use: Sequence[int]) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Lowest ``-2 ln L`` over all jitters, its chi-square, shared coefficients and each instrument's jitter.

    ``blocks[i, j]`` is what instrument i with jitter j adds to the shared sums. Given the coefficients, instruments are
    independent, so each takes its best jitter; given the jitters, the coefficients follow. That ends in a good
    choice from each common jitter; a bound then shows that no other is better, or finds it: instruments not yet
    chosen cannot do better than alone, with coefficients of their own.
    """
    n, k = norms.shape
    every, best = np.arange(n), None
    for start in range(k):
        choice, seen = np.full(n, start), set()
        while tuple(choice) not in seen:
            seen.add(tuple(choice))
            beta, chi2 = solve_shared(blocks[every, choice].sum(0), use)
            total = chi2 + float(norms[every, choice].sum())
            if best is None or total < best[0] - 1e-9:
                best = total, chi2, beta, choice
            residual = np.append(-beta, 1.0)
            choice = np.round(np.einsum("a,ijab,b->ij", residual, blocks, residual) + norms, 9).argmin(1)
    alone = np.array([[solve_shared(blocks[i, j], use)[1] + norms[i, j] for j in range(k)] for i in range(n)])
    rest = np.append(np.cumsum(alone.min(1)[::-1])[::-1], 0.0)  # lower bound of the instruments from i on
    open_ = [(0, np.zeros_like(blocks[0, 0]), 0.0, ())]
    while open_:
        i, block, norm, chosen = open_.pop()
        for j in alone[i].argsort()[::-1]:
            with_j = block + blocks[i, j]
            beta, chi2 = solve_shared(with_j, use)
            total = chi2 + norm + norms[i, j]
            if total + rest[i + 1] < best[0] - 1e-9:
                if i + 1 < n:
                    open_.append((i + 1, with_j, norm + norms[i, j], (*chosen, j)))
                else:
                    best = total, chi2, beta, np.array((*chosen, j))
    return best


def anomaly_phasor(mean: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray]:
    """Cosine and sine of the true anomaly, by up to eight Newton steps."""
    x = mean + e * np.sin(mean)
    for _ in range(8 if e else 0):
        step = (x - e * np.sin(x) - mean) / (1.0 - e * np.cos(x))
        x = x - step
        if len(x) and np.nanmax(np.abs(step), initial=0.0) < 1e-13:
            break
    cos = np.cos(x)
    far = 1.0 - e * cos
    return (cos - e) / far, math.sqrt(1.0 - e * e) * np.sin(x) / far


ORBIT_ROWS = 250_000  # rows of a target from which its sums are formed in parts
ORBIT_STEP = 4096  # rows looked at together


def rv_compare(rv: DataFrame, periods: DataFrame, eccentricities: Sequence[float] = (0.0, 0.2, 0.4, 0.6), phases: int = 16,
               jitters: Sequence[float] = (0.0, 1.0, 3.0)) -> DataFrame:
    """Offsets, trend, activity and jitters with and without a Keplerian at the fixed period.

    Eccentricity and mean anomaly form a grid; amplitude and argument of periastron are linear. Per
    instrument and jitter the offset is eliminated and what is left is summed, so each instrument's jitter is
    searched on its own. ``rv`` has ``target_id, instrument, t, velocity, sigma`` and may have ``activity``, which is fitted
    where every row of a target has it and it varies. Every parameter that is charged is fitted. ``jitters`` of the result
    names the Keplerian's per instrument.
    """
    activity = F.col("activity").cast("double") if "activity" in rv.columns else F.lit(None).cast("double")
    x = rv.select("target_id", "instrument", "t", "velocity", "sigma", activity.alias("activity"))
    facts = x.groupBy("target_id").agg(F.avg("t").alias("_mid"), F.avg("activity").alias("_level"), F.count(F.lit(1)).alias("_n"), ((F.count("activity") == F.count(F.lit(1))) & (F.max("activity") > F.min("activity"))).alias("_active"))
    x = attach(x, periods.join(facts, "target_id"), TARGET, spread=["t"])
    since = F.col("t") - F.col("_mid")
    part = F.pmod(F.xxhash64("t", "velocity"), F.ceil(F.col("_n") / ORBIT_ROWS)).cast("int")
    x = x.select("target_id", "instrument", part.alias("part"), F.col("_active").cast("int").alias("active"), since.alias("since"), floored_mod(since / F.col("period") * TAU, F.lit(TAU)).alias("phase"),
                 F.when(F.col("_active"), F.col("activity") - F.col("_level")).otherwise(0.0).alias("activity"), F.coalesce(F.col("velocity").cast("double"), F.lit(0.0)).alias("velocity"), F.col("sigma").cast("double").alias("sigma"))
    kinds = dict(x.dtypes)
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    sums = ["s", "norm", *(f"s{i}" for i in range(5)), *(f"p{i}{j}" for i, j in pairs)]
    nodes = [(float(e), TAU * i / phases) for e in eccentricities for i in range(phases)]

    def collapse(rows: pd.DataFrame) -> pd.DataFrame:
        """The sums of the rows at every grid point and jitter, as matrix products of a few rows at a time."""
        total = np.zeros((len(sums), len(nodes), len(jitters)))
        at = {name: k for k, name in enumerate(sums)}
        for low in range(0, len(rows), ORBIT_STEP):
            here = rows.iloc[low:low + ORBIT_STEP]
            since, phase, act, velocity, sigma = (here[c].to_numpy(float) for c in ("since", "phase", "activity", "velocity", "sigma"))
            cos, sin = (np.vstack(x) for x in zip(*(anomaly_phasor(np.mod(phase + m0, TAU), e) for e, m0 in nodes)))
            var = sigma[:, None] ** 2 + np.array(jitters, float) ** 2
            w = np.nan_to_num(1.0 / var, nan=0.0)
            total[at["s"]] += w.sum(axis=0)
            total[at["norm"]] += np.nansum(np.log(var * TAU), axis=0)
            fixed = {0: since, 3: act, 4: velocity}
            for i, u in fixed.items():
                total[at[f"s{i}"]] += u @ w
                for j, v in fixed.items():
                    if j >= i:
                        total[at[f"p{i}{j}"]] += (u * v) @ w
                for k, c in ((1, cos), (2, sin)):
                    total[at[f"p{min(i, k)}{max(i, k)}"]] += c @ (u[:, None] * w)
            for k, c in ((1, cos), (2, sin)):
                total[at[f"s{k}"]] += c @ w
            total[at["p11"]] += (cos * cos) @ w
            total[at["p12"]] += (cos * sin) @ w
            total[at["p22"]] += (sin * sin) @ w
        out = pd.DataFrame(total.reshape(len(sums), -1).T, columns=sums)
        e, m0, jitter = (np.array(x, float) for x in zip(*((*node, float(j)) for node in nodes for j in jitters)))
        first = rows.iloc[0]
        return out.assign(target_id=first["target_id"], instrument=first["instrument"], active=first["active"], e=e, m0=m0, jitter=jitter, n=len(rows))[collapsed]

    collapsed = ["target_id", "e", "m0", "active", "instrument", "jitter", "n", *sums]
    task = ["target_id", "instrument", "part"]
    fields = f"target_id {kinds['target_id']}, e double, m0 double, active int, instrument {kinds['instrument']}, jitter double, n long, " + ", ".join(f"{c} double" for c in sums)
    parts = fan_out(x, *task).groupBy(*task).applyInPandas(collapse, fields)
    s = parts.groupBy("target_id", "e", "m0", "active", "instrument", "jitter").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    left = F.array(*[F.col(f"p{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("s") for i, j in pairs])
    # one row per instrument and jitter of a target's grid point
    grid = s.groupBy("target_id", "e", "m0", "active").agg(F.array_sort(F.collect_list(F.struct("instrument", "jitter", "n", "norm", left.alias("p")))).alias("b"))
    kind = dict(rv.dtypes)
    fields = f"target_id {kind['target_id']}, e double, m0 double, active int, n long, k long, flat double, chi2_flat double, kepler double, chi2_kepler double, b array<double>, jitters array<struct<instrument: {kind['instrument']}, jitter: double>>"
    up = np.triu_indices(5)

    def search(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                names = list(dict.fromkeys(x["instrument"] for x in row.b))
                steps = len(row.b) // len(names)
                blocks = np.zeros((len(names), steps, 5, 5))
                blocks[:, :, up[0], up[1]] = np.array([x["p"] for x in row.b], float).reshape(len(names), steps, 15)
                blocks[:, :, up[1], up[0]] = blocks[:, :, up[0], up[1]]
                norms = np.array([x["norm"] for x in row.b], float).reshape(len(names), steps)
                kepler = jitter_search(blocks, norms, ORBIT)
                # the orbit's grid does not matter without an orbit
                flat = jitter_search(blocks, norms, FLAT) if row.e == eccentricities[0] and row.m0 == 0 else (None, None)
                chosen = [{"instrument": name, "jitter": row.b[i * steps + j]["jitter"]} for i, (name, j) in enumerate(zip(names, kepler[3]))]
                out.append((row.target_id, row.e, row.m0, row.active, sum(x["n"] for x in row.b[::steps]), len(names), flat[0], flat[1], kepler[0], kepler[1], kepler[2].tolist(), chosen))
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in fields.split(", ")][:12])

    found = fan_out(grid, "target_id", "e", "m0").mapInPandas(search, fields)
    best = found.groupBy("target_id").agg(
        F.first("n").alias("n"), F.first("k").alias("k"), F.first("active").alias("active"), F.min_by(F.struct("flat", "chi2_flat"), "flat").alias("f"),
        F.min_by(F.struct("kepler", "chi2_kepler", "e", "m0", "b", "jitters"), F.struct(F.round("kepler", 8), "e", "m0")).alias("g"))
    n, k = F.col("n"), F.col("k")
    q_flat = k * 2 + 1 + F.col("active")  # offsets, jitters, trend and activity
    q_kepler = q_flat + 4
    score = lambda fit, q: (q * 2 + fit, F.ln(n) * q + fit)
    aic0, bic0 = score(F.col("f.flat"), q_flat)
    aic1, bic1 = score(F.col("g.kepler"), q_kepler)
    b = lambda i: F.get("g.b", F.lit(i))
    return best.select("target_id", "n", F.col("f.chi2_flat").alias("chi2_constant"), F.col("g.chi2_kepler").alias("chi2_keplerian"), aic0.alias("aic_constant"),
                       aic1.alias("aic_keplerian"), bic0.alias("bic_constant"), bic1.alias("bic_keplerian"), (aic0 - aic1).alias("delta_aic"), (bic0 - bic1).alias("delta_bic"),
                       F.hypot(b(1), b(2)).alias("amplitude"), F.col("g.e").alias("eccentricity"), F.atan2(-b(2), b(1)).alias("omega"), b(0).alias("trend"),
                       F.when(F.col("active") == 1, b(3)).alias("activity_coefficient"), F.col("g.jitters").alias("jitters"))


# ---- spectral energy distribution ------------------------------------------------------------

# Pivot wavelength (micron), zero point (Jy) and A_lambda / A_V per band.
BANDS = {
    "J": (1.235, 1594.0, 0.282), "H": (1.662, 1024.0, 0.190), "Ks": (2.159, 666.7, 0.114), "W1": (3.3526, 309.540, 0.067),
    "W2": (4.6028, 171.787, 0.054), "W3": (11.5608, 31.674, 0.024), "W4": (22.0883, 8.363, 0.015),
}
PLANCK, LIGHT, BOLTZMANN, PARSEC, SOLAR_RADIUS = 6.62607015e-34, 299792458.0, 1.380649e-23, 3.0856775814913673e16, 6.957e8
MAG_FLOOR = 0.05


def band_value(position: int) -> Column:
    pairs = [v for name, row in BANDS.items() for v in (F.lit(name), F.lit(row[position]))]
    return F.element_at(F.create_map(*pairs), F.col("band"))


def blackbody_magnitude(teff: Column, av: Column) -> Column:
    """Vega magnitude of a unit angular radius at the band's pivot wavelength."""
    nu = F.lit(LIGHT) / (band_value(0) * 1e-6)
    intensity = nu * nu * nu * (2.0 * PLANCK / LIGHT / LIGHT) / (F.exp(nu * (PLANCK / BOLTZMANN) / teff) - 1.0)
    return F.log10(intensity * (math.pi / 1e-26) / band_value(1)) * -2.5 + av * band_value(2)


def sed_grid(photometry: DataFrame, stars: DataFrame, teff_step: float = 100.0, av_step: float = 0.025) -> DataFrame:
    """Normalised weight and radius of each (Teff, A_V) node per star.

    The angular scale has a closed form at every node. Priors: two temperature
    components 250 K apart (150 K wide), half-normal extinction, scale within a
    factor three of one solar radius at the parallax distance.
    """
    x = photometry.where(F.col("band").isin(*BANDS) & F.col("mag").isNotNull() & F.col("err").isNotNull())
    # dealt out by number, since a row becomes one per node; a star's nodes then stay in its task
    x = fan_out(attach(x, stars.where((F.col("parallax_mas") > 0)), TARGET, spread=["band"]), *TARGET)
    n_t, n_a = int(round(4500.0 / teff_step)) - 1, int(round(0.5 / av_step)) - 1
    x = x.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(n_t)))).withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(n_a))))
    x = x.withColumn("teff", F.col("_i") * teff_step + 3500.0).withColumn("av", F.col("_j") * av_step)
    w = 1.0 / (F.col("err") * F.col("err") + MAG_FLOOR * MAG_FLOOR)
    x = x.withColumn("w", w)
    # residual against a star of one solar radius at the parallax distance
    expected = F.lit(SOLAR_RADIUS / PARSEC / 1000.0) * F.col("parallax_mas")
    x = x.withColumn("r", F.col("mag") - blackbody_magnitude(F.col("teff"), F.col("av")) + F.log10(expected) * 5.0)
    node = ["target_id", "teff", "av"]
    s = x.groupBy(*node, "teff_prior", "parallax_mas").agg(F.count(F.lit(1)).alias("n_bands"), F.sum("w").alias("_w"), F.sum(F.col("w") * F.col("r")).alias("_wr"),
                                                           F.sum(F.col("w") * F.col("r") * F.col("r")).alias("_wrr"))
    mean = F.col("_wr") / F.col("_w")
    s = s.withColumn("radius_solar", F.pow(F.lit(10.0), mean / -5.0)).withColumn("chi2", F.col("_wrr") - mean * F.col("_wr"))
    s = s.where((F.col("radius_solar") > 1.0 / 3) & (F.col("radius_solar") < 3.0))
    bump = lambda shift: F.exp(F.pow((F.col("teff") - F.col("teff_prior") - shift) / 150.0, F.lit(2.0)) * -0.5)
    logp = F.col("chi2") * -0.5 + F.ln(bump(0.0) + bump(250.0) + 1e-300) - F.pow(F.col("av") / 0.05, F.lit(2.0)) * 0.5
    s = s.withColumn("logp", logp)
    top = F.max("logp").over(W.partitionBy("target_id"))  # over the nodes of one star
    return s.withColumn("weight", F.exp(F.col("logp") - top)).select(*node, "n_bands", "radius_solar", "chi2", "weight")


def sed_summary(grid: DataFrame) -> DataFrame:
    """Marginal percentiles of temperature, extinction and radius; one row per (star, parameter)."""
    values = F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).alias("value")) for c in ("teff", "av", "radius_solar")])
    x = grid.select("target_id", "weight", F.explode(values).alias("v")).select("target_id", "weight", "v.*")
    merged = x.groupBy("target_id", "param", "value").agg(F.sum("weight").alias("weight"))
    return weighted_percentiles(merged, ["target_id", "param"], "value", "weight")


TEFF_SUN, LOGG_SUN = 5772.0, 4.438  # fixed values
DISTANCE_NODES, DISTANCE_STEP = 8, 0.5  # nodes on either side of the parallax, and their distance in standard errors


def sed_posterior(grid: DataFrame, stars: DataFrame) -> DataFrame:
    """Percentiles of distance, radius, luminosity and surface gravity; one row per (star, parameter).

    The parallax error is spread over equally spaced nodes of a normal distribution; each node of ``grid`` is pushed through each
    of them with the product of the weights. ``stars`` has ``target_id, parallax_mas, parallax_mas_err, mass_solar``; a star without
    a positive parallax error has no such posterior, one without a mass has no surface gravity.
    """
    known = stars.where((F.col("parallax_mas") > 0) & (F.col("parallax_mas_err") > 0)).select("target_id", "parallax_mas", "parallax_mas_err", "mass_solar")
    rows = grid.select("target_id", "teff", "radius_solar", "weight")
    out = rows.groupBy("target_id").cogroup(fan_out(known, "target_id").groupBy("target_id")).applyInPandas(star_posterior, POSTERIOR)
    return out.withColumn("plus", F.col("p84") - F.col("median")).withColumn("minus", F.col("median") - F.col("p16"))


POSTERIOR = "target_id long, param string, n long, p16 double, median double, p84 double"


def star_posterior(nodes: pd.DataFrame, stars: pd.DataFrame) -> pd.DataFrame:
    """The products of one star's nodes and distances, as many as the two grids fix, in one task."""
    out = []
    if len(nodes) and len(stars):
        star = stars.iloc[0]
        k = np.arange(-DISTANCE_NODES, DISTANCE_NODES + 1)
        moved = star["parallax_mas"] + k * DISTANCE_STEP * star["parallax_mas_err"]
        k, moved = k[moved > 0], moved[moved > 0]
        share = np.exp((k * DISTANCE_STEP) ** 2 * -0.5)
        teff, scale, weight = (nodes[c].to_numpy(float) for c in ("teff", "radius_solar", "weight"))
        radius = np.outer(scale, star["parallax_mas"] / moved)
        every = np.outer(weight, share).ravel()
        named = {"radius_solar": (radius, every), "luminosity_solar": (radius * radius * ((teff / TEFF_SUN) ** 4)[:, None], every),
                 "distance_pc": (1000.0 / moved, share * weight.sum())}
        if star["mass_solar"] is not None and star["mass_solar"] > 0:
            named["logg_cgs"] = (np.log10(star["mass_solar"]) + LOGG_SUN - np.log10(radius) * 2.0, every)
        for name, (value, w) in named.items():
            value, at = np.unique(value.ravel(), return_inverse=True)
            w = np.bincount(at, w, len(value))
            c = np.cumsum(w if w.sum() > 0 else np.ones(len(w)))
            c /= c[-1]
            levels = []
            for level in LEVELS:
                high = int(np.searchsorted(c, level, side="right"))  # first point above the level
                if high == len(c) or high == 0:
                    levels.append(value[min(high, len(c) - 1)])
                else:
                    levels.append(value[high - 1] + (level - c[high - 1]) / (c[high] - c[high - 1]) * (value[high] - value[high - 1]))
            out.append((int(star["target_id"]), name, len(value), *levels))
    return pd.DataFrame(out, columns=[part.split()[0] for part in POSTERIOR.split(", ")])


def distinct_nodes(grid: DataFrame) -> DataFrame:
    """Complete nodes, of equal ones the first: no other of them can be the nearest."""
    known = grid.where(F.col("teff_k").isNotNull() & F.col("logg_cgs").isNotNull() & F.col("feh").isNotNull())
    return known.groupBy("teff_k", "logg_cgs", "feh").agg(F.min("node_id").alias("node_id"))


def nearest_atmosphere(stars: DataFrame, grid: DataFrame, steps: Sequence[float] = (250.0, 5000.0), parts: int = 16) -> DataFrame:
    """Nearest (Teff, logg, [Fe/H]) node of each star; every star stays, with a ``status``.

    A star outside the nodes' temperatures is looked up at the nearest end of their range. Stars meet the nodes
    of their own and the two adjoining temperature buckets; what is found no farther than a bucket beyond
    the way to that end beats any node outside them. The rest goes on to wider buckets, the last of
    which span the range. Stars are dealt over ``parts`` tasks per bucket.
    """
    known = settle(distinct_nodes(grid))
    span = known.agg(F.min("teff_k").alias("_min"), F.max("teff_k").alias("_max"))  # one row
    placed = stars.where(F.col("teff_k").isNotNull() & F.col("logg_cgs").isNotNull() & F.col("feh").isNotNull()).select("target_id", "teff_k", "logg_cgs", "feh").distinct()
    left = settle(placed.join(F.broadcast(span)).withColumn("_at", F.greatest(F.least("teff_k", "_max"), F.col("_min"))))
    found = None
    for step in [*map(F.lit, steps), F.col("_max") - F.col("_min") + 1]:
        nodes = known.join(F.broadcast(span)).select(F.floor((F.col("teff_k") - F.col("_min")) / step).alias("_b"), "node_id", F.col("teff_k").alias("_t"), F.col("logg_cgs").alias("_g"), F.col("feh").alias("_f"))
        home = F.floor((F.col("_at") - F.col("_min")) / step)
        x = attach(left.withColumn("_b", F.explode(F.sequence(home - 1, home + 1))), nodes, ["_b"], parts=parts, spread=["target_id", "teff_k"])
        square = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
        d = F.sqrt(square("teff_k", "_t") + square("logg_cgs", "_g") + square("feh", "_f"))
        key = ["target_id", "teff_k", "logg_cgs", "feh"]
        near = x.withColumn("distance", d).where(F.col("distance") <= F.abs(F.col("teff_k") - F.col("_at")) + step).groupBy(*key).agg(
            F.min_by(F.struct("node_id", "distance"), F.struct(F.round("distance", 9), "node_id")).alias("b")).select(*key, "b.*")
        near = settle(near)
        found = near if found is None else found.unionByName(near)
        left = left.join(near, key, "left_anti")
    whole = F.col("teff_k").isNotNull() & F.col("logg_cgs").isNotNull() & F.col("feh").isNotNull()
    status = F.when(~whole, "coordinate missing").when(F.col("node_id").isNull(), "no node").otherwise("matched")
    return stars.join(found, ["target_id", "teff_k", "logg_cgs", "feh"], "left").select("target_id", "node_id", "distance", status.alias("status"))


# ---- posterior chains --------------------------------------------------------------------------

G_CGS, RHO_SUN = 6.67430e-8, 1.408  # fixed values


def a_over_r(rho_solar: Column, period_days: Column) -> Column:
    seconds = period_days * 86400.0
    return F.pow(seconds * seconds * (G_CGS * RHO_SUN / (3.0 * math.pi)) * rho_solar, F.lit(1.0 / 3.0))


def derived_posteriors(chain: DataFrame, eph: DataFrame) -> DataFrame:
    """Percentiles of sampled and derived parameters of a long ``(step, param, value)`` chain."""
    wide = chain.groupBy("target_id", "step").agg(*[F.max(F.when(F.col("param") == p, F.col("value"))).alias(p) for p in ("rp", "log_rho", "b", "se_cos", "se_sin")])
    x = attach(wide, eph.select("target_id", "period"), TARGET, spread=["step"])
    rho = F.pow(F.lit(10.0), F.col("log_rho"))
    x = x.withColumn("rho_star", rho).withColumn("a_rs", a_over_r(F.col("rho_star"), F.col("period")))
    x = x.withColumn("eccentricity", F.col("se_cos") * F.col("se_cos") + F.col("se_sin") * F.col("se_sin"))
    omega = F.atan2("se_sin", "se_cos")
    low = 1 + F.col("eccentricity") * F.sin(omega)
    x = x.withColumn("distance_a_rs", F.when((F.col("eccentricity") < 1) & (low > 0), F.col("a_rs") * (1 - F.col("eccentricity") * F.col("eccentricity")) / F.when(low > 0, low)))
    ratio = F.least(F.greatest(F.col("b") / F.col("distance_a_rs"), F.lit(0.0)), F.lit(1.0))
    x = x.withColumn("inclination_deg", F.degrees(F.acos(ratio))).withColumn("omega_deg", F.degrees(omega)).withColumn("area_ppm", F.col("rp") * F.col("rp") * 1e6)
    names = ("rp", "log_rho", "b", "rho_star", "a_rs", "eccentricity", "omega_deg", "distance_a_rs", "inclination_deg", "area_ppm")
    long = x.select("target_id", F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).alias("value")) for n in names])).alias("v")).select("target_id", "v.*")
    return percentile_summary(long, ["target_id", "param"])
