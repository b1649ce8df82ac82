"""Box-search queries (IDs H1-H4, F1, F2, B12, C10, C11, H16-H19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import search as B
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A

LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"


def grid_sql(source: str, series: str, durations, pmin="0.5e0", pmax="15e0", n_periods: int = 2000, extra: str = "") -> str:
    """CTEs ``facts`` and ``grid``."""
    values = ", ".join(f"({d}e0)" for d in durations)
    span = "(1 / period_min - 1 / period_max)"
    return f"""facts AS (SELECT {series}, min(t) AS t_start, max(t) - min(t) AS baseline, count(*) AS n_points, sum(1 / (flux_err * flux_err)) AS w_all,
  sum(1 / (flux_err * flux_err) * flux) AS wy_all FROM {source} WHERE flux IS NOT NULL GROUP BY {series} HAVING count(*) >= 50),
lim AS (SELECT facts.*, {pmin} AS period_min, {pmax} AS period_max FROM facts {extra}),
gr AS (SELECT lim.*, d AS duration_hours, d / 24 / (baseline * baseline) AS nat FROM lim, (VALUES {values}) AS v(d)),
gs AS (SELECT *, nat * least(1e0, greatest(2e0, ceil({span} / nat) + 1) / {n_periods}e0) AS step FROM gr),
grid AS (SELECT *, CAST(round_even({span} / step, 0) + 1 AS INTEGER) AS n_trials FROM gs)"""


def box_sql(source: str, series: str) -> str:
    """CTEs ``pgram`` (best box per trial) and ``peaks`` (selected peak per duration)."""
    return f"""tr AS (SELECT {series}, duration_hours, t_start, w_all, wy_all, n_trials, CAST(i AS INTEGER) AS trial, 1 / (1 / period_min - step * i) AS period
  FROM grid, LATERAL (SELECT unnest(range(0, n_trials)) AS i)),
tb AS (SELECT *, CAST(round_even(period / (duration_hours / 24 / 5), 0) AS INTEGER) AS bins FROM tr),
ex AS (SELECT {series}, duration_hours, trial, bins, (t - t_start) / period AS turns, flux, 1 / (flux_err * flux_err) AS w
  FROM tb JOIN (SELECT * FROM {source} WHERE flux IS NOT NULL) USING ({series})),
bn AS (SELECT {series}, duration_hours, trial, bins, least(CAST(floor((turns - floor(turns)) * bins) AS INTEGER), bins - 1) AS bin,
  sum(w) AS w, sum(w * flux) AS wy FROM ex GROUP BY ALL),
wn AS (SELECT {series}, duration_hours, trial, bins, (bin - j + bins) % bins AS start, sum(w) AS w, sum(wy) AS wy FROM bn, range(0, 5) AS r(j) GROUP BY ALL),
dp AS (SELECT {series}, duration_hours, trial, period, t_start, n_trials, wn.bins, start, w, (wy_all - wy) / (w_all - w) - wy / w AS depth,
  sqrt(1 / w + 1 / (w_all - w)) AS depth_err FROM wn JOIN tb USING ({series}, duration_hours, trial) WHERE w_all - w > w_all * 1e-12),
pk AS (SELECT *, row_number() OVER (PARTITION BY {series}, duration_hours, trial ORDER BY round(w * depth * depth * 0.5e0, 9) DESC, start) AS k FROM dp WHERE depth > 0),
pgram AS (SELECT {series}, duration_hours, trial, period, t_start + (start + 2.5e0) * (period / bins) AS epoch, depth, depth_err,
  round(w * depth * depth * 0.5e0, 9) AS power, n_trials FROM pk WHERE k = 1),
ev AS MATERIALIZED (SELECT {series}, duration_hours, trial, count(DISTINCT round_even((t - epoch) / period, 0)) AS n_events
  FROM pgram JOIN (SELECT * FROM {source} WHERE flux IS NOT NULL) USING ({series})
  WHERE abs({A.phase_sql()} * 24) <= duration_hours / 2 GROUP BY ALL HAVING count(DISTINCT round_even((t - epoch) / period, 0)) >= 2),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {series}, duration_hours ORDER BY power DESC, trial DESC) AS k
  FROM pgram JOIN ev USING ({series}, duration_hours, trial)) WHERE k = 1),
peaks AS (SELECT {series}, duration_hours, grid.n_trials, CASE WHEN depth / depth_err >= 7.1e0 THEN period END AS period,
  CASE WHEN depth / depth_err >= 7.1e0 THEN epoch END AS epoch, CASE WHEN depth / depth_err >= 7.1e0 THEN depth * 1e6 END AS depth_ppm,
  depth_err * 1e6 AS depth_err_ppm, depth / depth_err AS snr, coalesce(n_events, 0) AS n_events,
  CASE WHEN depth / depth_err >= 7.1e0 THEN 'detected' ELSE 'no-detection' END AS status FROM grid LEFT JOIN bb USING ({series}, duration_hours))"""


def box_sql_renamed(source: str, series: str) -> str:
    return box_sql(source, series).replace("ev AS MATERIALIZED", "evn AS MATERIALIZED").replace("JOIN ev USING", "JOIN evn USING")


PEAK = ["round(period, 8) AS period", "round(epoch, 7) AS epoch", "round(depth_ppm, 3) AS depth_ppm", "round(depth_err_ppm, 3) AS depth_err_ppm", "round(snr, 6) AS snr"]
PEAK_SQL = ", ".join(PEAK)


@query("h1_period_grid", f"""{LC16}, {grid_sql('lc', 'target_id', (3, 6))}
SELECT target_id, duration_hours, CAST(i AS INTEGER) AS trial, round(1 / (1 / period_min - step * i), 8) AS period
FROM grid, LATERAL (SELECT unnest(range(0, n_trials)) AS i)""")
def _(spark, folder):
    facts = B.series_facts(A.cadence(spark, folder, A.SERIES16), ["target_id"])
    facts = facts.withColumn("period_min", F.lit(0.5)).withColumn("period_max", F.lit(15.0))
    grid = B.period_grid(facts, (3.0, 6.0), 2000)
    trials = grid.withColumn("trial", F.explode(F.sequence(F.lit(0), F.col("n_trials") - 1)))
    return trials.select("target_id", "duration_hours", "trial", F.round(B.trial_period(F.col("trial")), 8).alias("period"))


@query("h2_box_periodogram", f"""{LC16}, {grid_sql('lc', 'target_id', (6,))}, {box_sql_renamed('lc', 'target_id')}
SELECT target_id, trial, round(period, 8) AS period, round(epoch, 7) AS epoch, round(depth * 1e6, 2) AS depth_ppm, round(power, 3) AS power FROM pgram""")
def _(spark, folder):
    lc = A.cadence(spark, folder, A.SERIES16)
    facts = B.series_facts(lc, ["target_id"]).withColumn("period_min", F.lit(0.5)).withColumn("period_max", F.lit(15.0))
    grid = B.period_grid(facts, (6.0,), 2000)
    return B.box_periodogram(lc, grid, ["target_id"]).select("target_id", "trial", F.round("period", 8).alias("period"),
        F.round("epoch", 7).alias("epoch"), F.round(F.col("depth") * 1e6, 2).alias("depth_ppm"), F.round("power", 3).alias("power"))


def h3(spark, folder, durations=(3.0, 6.0)):
    return B.box_search(A.cadence(spark, folder, A.SERIES16), ["target_id"], durations)


H3 = f"{LC16}, {grid_sql('lc', 'target_id', (3, 6))}, {box_sql_renamed('lc', 'target_id')}"


@query("h3_duration_grid", f"{H3} SELECT target_id, duration_hours, n_trials, n_events, status, {PEAK_SQL} FROM peaks")
def _(spark, folder):
    return h3(spark, folder).selectExpr("target_id", "duration_hours", "n_trials", "n_events", "status", *PEAK)


@query("f1_select_peak", f"""{LC16}, {grid_sql('lc', 'target_id', (6,))}, {box_sql_renamed('lc', 'target_id')}
SELECT target_id, n_events, status, {PEAK_SQL} FROM peaks""")
def _(spark, folder):
    return h3(spark, folder, (6.0,)).selectExpr("target_id", "n_events", "status", *PEAK)


BEST = """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY coalesce(round(snr, 9), -1e300) DESC, duration_hours) AS k FROM peaks) WHERE k = 1)"""


@query("f2_select_duration", f"{H3}, {BEST} SELECT target_id, duration_hours, n_events, status, {PEAK_SQL} FROM best")
def _(spark, folder):
    return B.select_duration(h3(spark, folder), ["target_id"]).selectExpr("target_id", "duration_hours", "n_events", "status", *PEAK)


@query("h4_targeted_search", f"""{LC16}, {grid_sql('lc', 'target_id', (6,), '(eph.period - 0.1e0)', '(eph.period + 0.1e0)', 2000, 'JOIN eph USING (target_id)')},
{box_sql_renamed('lc', 'target_id')} SELECT target_id, n_trials, n_events, status, {PEAK_SQL} FROM peaks""")
def _(spark, folder):
    bounds = B.targeted_bounds(A.ephemeris(spark, folder, A.SERIES16))
    out = B.box_search(A.cadence(spark, folder, A.SERIES16), ["target_id"], (6.0,), bounds=bounds)
    return out.selectExpr("target_id", "n_trials", "n_events", "status", *PEAK)


@query("b12_promote_detections", f"""{H3} SELECT target_id, duration_hours, CASE WHEN status <> 'detected' THEN 'not detected'
  WHEN depth_ppm <= 0 THEN 'non-positive field' WHEN duration_hours / 24 >= period THEN 'duration not shorter than period'
  WHEN snr < 20 THEN 'below SNR threshold' WHEN n_events < 2 THEN 'fewer than two events' END AS reason,
  status = 'detected' AND snr >= 20 AND n_events >= 2 AS promoted FROM peaks""")
def _(spark, folder):
    return B.promote_detections(h3(spark, folder), min_snr=20.0).select("target_id", "duration_hours", "reason", "promoted")
