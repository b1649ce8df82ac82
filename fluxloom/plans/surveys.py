"""Controls, injection recovery and verdicts (IDs C10, C11, D9, H16-H19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import controls as R
from fluxloom.operators import search as B
from fluxloom.operators import signals as G
from fluxloom.plans.registry import query
from fluxloom.session import cut
from fluxloom.sources import adapters as A

LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"
CFG = R.SurveyConfig()
# h18 injects every sixth of the default signals' cells: each period and depth, the longest duration, two phases
GRID = R.SensitivityGrid(durations_hours=(4.0,), phases=(0.125, 0.625))


@query("c10_injection_grid", f"""{LC16}, a AS (SELECT target_id, min(t) AS t0 FROM lc GROUP BY 1)
SELECT target_id, p AS period, t0 + f * p AS epoch, d AS duration_hours, q AS depth_ppm, f AS phase_offset
FROM a, (VALUES (0.75e0), (3e0), (10e0)) AS x(p), (VALUES (1e0), (2e0), (4e0)) AS y(d),
  (VALUES (250e0), (1000e0), (2500e0)) AS z(q), (VALUES (0.125e0), (0.375e0), (0.625e0), (0.875e0)) AS w(f)""")
def _(spark, folder):
    return R.injection_grid(A.cadence(spark, folder, A.SERIES16), R.SensitivityGrid())


def reference(spark, folder):
    lc = A.cadence(spark, folder, A.SERIES16)
    found = B.box_search(lc, ["target_id"], CFG.durations_hours, CFG.period_min, CFG.period_max, CFG.n_periods)
    return lc, B.select_duration(found, ["target_id"])


@query("c11_candidate_injections")
def _(spark, folder):
    out = R.candidate_injections(reference(spark, folder)[1])
    return out.select("target_id", F.round("period", 8).alias("period"), F.round("epoch", 7).alias("epoch"), "duration_hours",
                      F.round("depth_ppm", 3).alias("depth_ppm"), "phase_offset")


WILSON = """CASE WHEN k = 0 THEN 0e0 ELSE greatest((k / n + 1.959963984540054e0 * 1.959963984540054e0 / (2 * n)) / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) - hw, 0) END AS lower,
  CASE WHEN k = n THEN 1e0 ELSE least((k / n + 1.959963984540054e0 * 1.959963984540054e0 / (2 * n)) / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) + hw, 1) END AS upper"""


@query("d9_recovery_summary", f"""WITH t AS (SELECT l_suppkey % 20 AS target_id, CAST(l_linenumber AS DOUBLE) AS period, floor(l_discount * 50) AS duration_hours,
  floor(l_tax * 50) AS depth_ppm, l_returnflag = 'R' AS recovered FROM lineitem),
g AS (SELECT target_id, period, duration_hours, depth_ppm, count(*) AS n, count(*) FILTER (WHERE recovered) AS k FROM t
  GROUP BY GROUPING SETS ((target_id, period, duration_hours, depth_ppm), (target_id))),
w AS (SELECT *, 1.959963984540054e0 * sqrt((k / n * (1 - k / n) + 1.959963984540054e0 * 1.959963984540054e0 / (4 * n)) / n) / (1 + 1.959963984540054e0 * 1.959963984540054e0 / n) AS hw FROM g),
o AS (SELECT *, {WILSON} FROM w)
SELECT target_id, period, duration_hours, depth_ppm, n AS trials, k AS recovered, round(k / n, 9) AS fraction, round(lower, 9) AS lower, round(upper, 9) AS upper FROM o""")
def _(spark, folder):
    t = A.table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("target_id"), F.col("l_linenumber").cast("double").alias("period"),
        F.floor(F.col("l_discount") * 50).cast("double").alias("duration_hours"), F.floor(F.col("l_tax") * 50).cast("double").alias("depth_ppm"),
        (F.col("l_returnflag") == "R").alias("recovered"))
    return R.recovery_summary(t).select("target_id", "period", "duration_hours", "depth_ppm", "trials", "recovered",
                                        *[F.round(c, 9).alias(c) for c in ("fraction", "lower", "upper")])


@query("h16_robustness")
def _(spark, folder):
    out = R.robustness(A.cadence(spark, folder, A.SERIES16), CFG)
    return out.select("target_id", F.round("plain_period", 7).alias("plain_period"), F.round("plain_snr", 5).alias("plain_snr"), "plain_n_events",
                      F.round("flat_period", 7).alias("flat_period"), F.round("flat_snr", 5).alias("flat_snr"), "flat_n_events",
                      F.round("max_control_snr", 5).alias("max_control_snr"), "n_controls")


@query("h17_injection_recovery")
def _(spark, folder):
    lc, det = reference(spark, folder)
    det = cut(det)  # one row per target, for the injections and what they are held against
    out = R.injection_recovery(lc, R.candidate_injections(det), CFG, 10.0)
    return out.select("target_id", F.round("period", 7).alias("period"), F.round("epoch", 6).alias("epoch"), "duration_hours",
                      "phase_offset", "period_match", "epoch_match", "snr_pass", "recovered")


@query("h18_sensitivity")
def _(spark, folder):
    out = R.sensitivity(A.cadence(spark, folder, A.SERIES16), GRID, CFG, 10.0)
    return out.select("target_id", "period", "duration_hours", "depth_ppm", "trials", "recovered", *[F.round(c, 9).alias(c) for c in ("fraction", "lower", "upper")])


@query("h19_robustness_verdict")
def _(spark, folder):
    lc, det = reference(spark, folder)
    det = cut(det)
    recovery = R.injection_recovery(lc, R.candidate_injections(det), CFG, 10.0)
    return R.robustness_verdict(det, R.robustness(lc, CFG), recovery, 60.0, CFG)
