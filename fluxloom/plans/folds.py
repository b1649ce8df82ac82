"""Folding and robust aggregates (IDs B1-B4, D1-D8, D21, E9, H15, H30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import folding as O
from fluxloom.operators import robust as R
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A

X = A.phase_sql()
HOURS = f"{X} * 24e0"
LC = f"WITH {A.cadence_sql()}"
LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"
FOLD = "FROM lc JOIN eph USING (target_id)"


def both(spark, folder, target="user_id"):
    return A.cadence(spark, folder, target), A.ephemeris(spark, folder, target)


@query("b1_with_phase", f"{LC} SELECT event_id, {HOURS} AS phase_hours {FOLD}")
def _(spark, folder):
    return O.with_phase(*both(spark, folder)).select("event_id", "phase_hours")


@query("b2_with_cycle", f"""{LC} SELECT event_id, CAST(round_even((t - epoch) / period, 0) AS BIGINT) AS cycle_rint,
  CAST(floor((t - epoch) / period + 0.5e0) AS BIGINT) AS cycle_floor,
  CAST(floor((t - epoch) / period + 0.5e0) AS BIGINT) % 2 = 0 AS is_even {FOLD}""")
def _(spark, folder):
    lc, eph = both(spark, folder)
    a = O.with_cycle(lc, eph, "floor").select("event_id", "t", "period", "epoch", F.col("cycle").alias("cycle_floor"), "is_even")
    return a.select("event_id", O.cycle_number("t", "period", "epoch", "rint").alias("cycle_rint"), "cycle_floor", "is_even")


def label_sql(hours: str) -> str:
    return (f"CASE WHEN abs({hours}) < duration_hours * 0.5e0 THEN 'in' WHEN abs({hours}) > duration_hours * 1.2e0 "
            f"AND abs({hours}) < duration_hours * 2.5e0 THEN 'baseline' END")


SHIFTED = A.phase_sql("t", "(period * 2e0)", "(epoch + 0.5e0 * period)")


@query("b3_with_window_label", f"""{LC} SELECT event_id, {label_sql(HOURS)} AS main_window,
  {label_sql(SHIFTED + ' * 24e0')} AS shifted_window {FOLD}""")
def _(spark, folder):
    lc, eph = both(spark, folder)
    main = O.with_window_label(lc, eph).select("target_id", "t", "flux", "event_id", F.col("window").alias("main_window"))
    return O.with_window_label(main, eph, shift=0.5, period_factor=2.0).select(
        "event_id", "main_window", F.col("window").alias("shifted_window"))


@query("b4_mask_transits", f"""{LC}, f AS (SELECT lc.*, abs({HOURS}) >= duration_hours * 0.75e0 AS far {FOLD}),
c AS (SELECT target_id, sum(CASE WHEN far THEN 1 ELSE 0 END) AS kept FROM f GROUP BY 1)
SELECT event_id, CASE WHEN kept < 55 THEN 'not-applied-insufficient-rows' ELSE 'applied' END AS mask_status
FROM f JOIN c USING (target_id) WHERE far OR kept < 55""")
def _(spark, folder):
    return O.mask_transits(*both(spark, folder), min_rows=55).select("event_id", "mask_status")


STATS = """count(*) FILTER (WHERE w = 'in') AS n_in, count(*) FILTER (WHERE w = 'baseline') AS n_out,
  median(flux) FILTER (WHERE w = 'in') AS m_in, median(flux) FILTER (WHERE w = 'baseline') AS m_out,
  stddev_pop(flux) FILTER (WHERE w = 'in') AS s_in, stddev_pop(flux) FILTER (WHERE w = 'baseline') AS s_out"""
DEPTH = "(m_out - m_in) * 1e6"
ERROR = "sqrt(pow(1.253e0 * s_in / sqrt(n_in), 2) + pow(1.253e0 * s_out / sqrt(n_out), 2)) * 1e6"


@query("d1_transit_depth", f"""{LC16}, f AS (SELECT target_id, flux, {label_sql(HOURS)} AS w {FOLD}),
s AS (SELECT target_id, {STATS} FROM f WHERE w IS NOT NULL GROUP BY 1)
SELECT target_id, round({DEPTH}, 4) AS depth_ppm, round({ERROR}, 4) AS uncertainty_ppm, n_in, n_out FROM s""")
def _(spark, folder):
    out = O.transit_depth(*both(spark, folder, A.SERIES16))
    return out.select("target_id", F.round("depth_ppm", 4).alias("depth_ppm"), F.round("uncertainty_ppm", 4).alias("uncertainty_ppm"), "n_in", "n_out")


def screen_sql(target: str = "user_id") -> str:
    """CTEs ``scr`` (one row per target and test) and ``wide`` (one row per target)."""
    parts = []
    for name, shift, factor, want in O.SCREEN_WINDOWS:
        h = A.phase_sql("t", f"(period * {factor}e0)", f"(epoch + period * {shift}e0)") + " * 24e0"
        keep = "" if want is None else f" WHERE abs(CAST(floor((t - epoch) / period + 0.5e0) AS BIGINT)) % 2 = {want}"
        parts.append(f"SELECT target_id, flux, '{name}' AS test, {label_sql(h)} AS w {FOLD}{keep}")
    names = ", ".join(f"('{w[0]}')" for w in O.SCREEN_WINDOWS)
    cells = ", ".join(f"max({c}) FILTER (WHERE test = '{w[0]}') AS {w[0]}_{c}" for w in O.SCREEN_WINDOWS
                      for c in ("depth_ppm", "uncertainty_ppm", "sigma", "status"))
    return f"""{A.cadence_sql(target)}, f AS ({' UNION ALL '.join(parts)}),
s AS (SELECT target_id, test, {STATS} FROM f WHERE w IS NOT NULL GROUP BY 1, 2),
e AS (SELECT target_id, test, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, {DEPTH} AS d, {ERROR} AS u
  FROM (SELECT target_id, n.test FROM eph, (VALUES {names}) AS n(test)) LEFT JOIN s USING (target_id, test)),
scr AS (SELECT target_id, test, n_in, n_out, CASE WHEN n_in >= 3 AND n_out >= 3 THEN d END AS depth_ppm,
  CASE WHEN n_in >= 3 AND n_out >= 3 AND u > 0 THEN u END AS uncertainty_ppm,
  CASE WHEN NOT (n_in >= 3 AND n_out >= 3) THEN 'insufficient_coverage' WHEN u > 0 THEN 'measured'
  ELSE 'uncertainty_unavailable' END AS status, CASE WHEN n_in >= 3 AND n_out >= 3 AND u > 0 THEN d / u END AS sigma FROM e),
wide AS (SELECT *, abs(odd_depth_ppm - even_depth_ppm) / sqrt(pow(odd_uncertainty_ppm, 2) + pow(even_uncertainty_ppm, 2)) AS odd_even_z
  FROM (SELECT target_id, {cells} FROM scr GROUP BY 1))"""


SCREEN_OUT = [f"{w[0]}_{c}" for w in O.SCREEN_WINDOWS for c in ("depth_ppm", "uncertainty_ppm", "sigma")]


@query("d2_screen", f"""WITH {screen_sql()} SELECT target_id, {', '.join(f'round({c}, 4) AS {c}' for c in SCREEN_OUT)},
  {', '.join(f'{w[0]}_status' for w in O.SCREEN_WINDOWS)}, round(odd_even_z, 6) AS odd_even_z,
  odd_even_z < 3e0 AS odd_even_consistent, CASE WHEN odd_even_z IS NULL THEN 'unresolved' ELSE 'measured' END AS odd_even_status
FROM wide""")
def _(spark, folder):
    out = O.screen(*both(spark, folder))
    return out.select("target_id", *[F.round(c, 4).alias(c) for c in SCREEN_OUT], *[f"{w[0]}_status" for w in O.SCREEN_WINDOWS],
                      F.round("odd_even_z", 6).alias("odd_even_z"), "odd_even_consistent", "odd_even_status")


@query("d3_phase_bins", f"""{LC16}, f AS (SELECT target_id, flux, {HOURS} AS h {FOLD}),
b AS (SELECT target_id, CAST(least(floor((h + 14e0) / (28e0 / 210)), 209) AS INTEGER) AS bin, count(*) AS n, median(flux) AS m,
  stddev_pop(flux) AS sd FROM f WHERE abs(h) <= 14 GROUP BY 1, 2)
SELECT target_id, CAST(r.bin AS INTEGER) AS bin, round((r.bin + 0.5e0) * (28e0 / 210) - 14, 6) AS centre_hours,
  coalesce(n, 0) AS n, round(CASE WHEN n >= 3 THEN m END, 9) AS median_flux,
  round(CASE WHEN n >= 3 THEN 1.253e0 * sd / sqrt(n) END, 9) AS error
FROM (SELECT target_id, i AS bin FROM eph, range(210) AS x(i)) r LEFT JOIN b USING (target_id, bin)""")
def _(spark, folder):
    out = O.phase_bins(*both(spark, folder, A.SERIES16), limit_hours=14.0, bin_minutes=8.0)
    return out.select("target_id", "bin", F.round("centre_hours", 6).alias("centre_hours"), "n",
                      F.round("median_flux", 9).alias("median_flux"), F.round("error", 9).alias("error"))


WBINS = f"""f AS (SELECT target_id, flux, 1 / (flux_err * flux_err) AS w, {X} AS x, period,
  least(100, count(*) OVER (PARTITION BY target_id)) AS b {FOLD}),
wb AS (SELECT target_id, CAST(least(floor((x + period / 2) / (period / b)), b - 1) AS INTEGER) AS bin, sum(w * x) / sum(w) AS phase_days,
  sum(w * flux) / sum(w) AS flux, sqrt(1 / sum(w)) AS error FROM f GROUP BY 1, 2)"""


@query("d4_weighted_phase_bins", f"""{LC16}, {WBINS}
SELECT target_id, bin, round(phase_days, 8) AS phase_days, round(flux, 9) AS flux, round(error, 9) AS error FROM wb""")
def _(spark, folder):
    out = O.weighted_phase_bins(*both(spark, folder, A.SERIES16))
    return out.select("target_id", "bin", F.round("phase_days", 8).alias("phase_days"), F.round("flux", 9).alias("flux"), F.round("error", 9).alias("error"))


@query("d4_binned_depth", f"""{LC}, {WBINS}, s AS (SELECT target_id, count(*) AS n_bins, avg(error) AS mean_error,
  count(*) FILTER (WHERE abs(phase_days) <= 0.125e0) AS n_in, count(*) FILTER (WHERE abs(phase_days) >= 0.25e0) AS n_out,
  (median(flux) FILTER (WHERE abs(phase_days) >= 0.25e0) - median(flux) FILTER (WHERE abs(phase_days) <= 0.125e0)) * 1e6 AS d
  FROM wb GROUP BY 1)
SELECT target_id, n_bins, n_in, n_out, round(mean_error, 9) AS mean_error, round(d, 4) AS depth_ppm,
  CASE WHEN n_bins < 10 THEN 'too few bins' WHEN n_in < 3 OR n_out < 3 THEN 'bins not populated'
  WHEN NOT (d > 0) THEN 'no positive depth' ELSE 'measured' END AS status FROM s""")
def _(spark, folder):
    lc, eph = both(spark, folder)
    out = O.binned_depth(O.weighted_phase_bins(lc, eph), eph)
    return out.select("target_id", "n_bins", "n_in", "n_out", F.round("mean_error", 9).alias("mean_error"),
                      F.round("depth_ppm", 4).alias("depth_ppm"), "status")


@query("d5_event_count", f"""{LC}, c AS (SELECT target_id, count(DISTINCT round_even((t - epoch) / period, 0)) AS k
  {FOLD} WHERE abs({HOURS}) <= duration_hours / 2 GROUP BY 1)
SELECT target_id, coalesce(k, 0) AS n_events FROM eph LEFT JOIN c USING (target_id)""")
def _(spark, folder):
    return O.event_count(*both(spark, folder))


@query("d6_weighted_summary", f"""WITH {A.raw_sql()}, v AS (SELECT target_id, value AS x, CASE WHEN target_id % 10 = 0 THEN 0e0 ELSE k * 1e0 END AS w FROM ev),
s AS (SELECT target_id, count(*) AS n, sum(w) AS sw, sum(w * x) AS wx, sum(w * x * x) AS wxx, sum(x) AS sx, sum(x * x) AS sxx FROM v GROUP BY 1),
m AS (SELECT target_id, n, CASE WHEN sw > 0 THEN wx / sw ELSE sx / n END AS mean, CASE WHEN sw > 0 THEN wxx / sw ELSE sxx / n END AS sq FROM s)
SELECT target_id, n, round(mean, 7) AS weighted_mean, round(sqrt(greatest(sq - mean * mean, 0)), 7) AS weighted_std FROM m""")
def _(spark, folder):
    out = R.weighted_summary(weighted_values(spark, folder), ["target_id"], "value", "weight")
    return out.select("target_id", "n", F.round("weighted_mean", 7).alias("weighted_mean"), F.round("weighted_std", 7).alias("weighted_std"))


def weighted_values(spark, folder):
    return A.events(spark, folder).withColumn("weight", F.when(F.col("target_id") % 10 == 0, 0.0).otherwise(F.col("k") * 1.0))


def wpct_sql(source: str, keys: str, cols: str) -> str:
    """Weighted percentiles of ``source(keys, x, w)``."""
    point = "struct_pack(x := x, c := c)"
    lo, hi = (lambda l: f"(max({point}) FILTER (WHERE c <= {l}))"), (lambda l: f"(min({point}) FILTER (WHERE c > {l}))")
    level = lambda l, n: (
        f"CASE WHEN {hi(l)} IS NULL THEN max(x) WHEN {lo(l)} IS NULL THEN {hi(l)}.x "
        f"ELSE {lo(l)}.x + ({l} - {lo(l)}.c) / ({hi(l)}.c - {lo(l)}.c) * ({hi(l)}.x - {lo(l)}.x) END AS {n}")
    return f"""wt AS (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS tw, count(*) OVER (PARTITION BY {keys}) AS tn FROM {source} WHERE w >= 0),
wc AS (SELECT *, sum(CASE WHEN tw > 0 THEN w ELSE 1e0 END) OVER (PARTITION BY {keys} ORDER BY x, w ROWS UNBOUNDED PRECEDING) / CASE WHEN tw > 0 THEN tw ELSE tn END AS c FROM wt),
wp AS (SELECT {keys}, count(*) AS n, {level('0.16e0', 'p16')}, {level('0.5e0', 'median')}, {level('0.84e0', 'p84')} FROM wc GROUP BY {cols})"""


@query("d7_weighted_percentiles", f"""WITH {A.raw_sql()}, v AS (SELECT target_id, value AS x, CASE WHEN target_id % 10 = 0 THEN 0e0 ELSE k * 1e0 END AS w FROM ev),
{wpct_sql('v', 'target_id', '1')}
SELECT target_id, n, round(p16, 9) AS p16, round(median, 9) AS median, round(p84, 9) AS p84,
  round(p84 - median, 9) AS plus, round(median - p16, 9) AS minus FROM wp""")
def _(spark, folder):
    out = R.weighted_percentiles(weighted_values(spark, folder), ["target_id"], "value", "weight")
    return out.select("target_id", "n", *[F.round(c, 9).alias(c) for c in ("p16", "median", "p84", "plus", "minus")])


@query("d8_percentile_summary", """WITH s AS (SELECT l_suppkey AS target_id, count(*) AS n, quantile_cont(l_extendedprice, 0.16) AS p16,
  quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.84) AS p84 FROM lineitem GROUP BY 1)
SELECT target_id, n, round(p16, 5) AS p16, round(median, 5) AS median, round(p84, 5) AS p84,
  round(p84 - median, 5) AS plus, round(median - p16, 5) AS minus FROM s""")
def _(spark, folder):
    v = A.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("target_id"), F.col("l_extendedprice").alias("value"))
    return R.percentile_summary(v, ["target_id"]).select("target_id", "n", *[F.round(c, 5).alias(c) for c in ("p16", "median", "p84", "plus", "minus")])


GAPS = "g AS (SELECT target_id, sector, t, t - lag(t) OVER (PARTITION BY target_id ORDER BY t) AS gap FROM lc)"


@query("d21_exposure", f"{LC}, {GAPS} SELECT target_id, count(*) AS n_gaps, round(median(gap), 9) AS exposure FROM g WHERE gap > 0 GROUP BY 1")
def _(spark, folder):
    return O.exposure(A.cadence(spark, folder)).select("target_id", "n_gaps", F.round("exposure", 9).alias("exposure"))


@query("e9_oc_residuals", f"""{LC} SELECT event_id, CAST(round_even((t - epoch) / period, 0) AS BIGINT) AS cycle,
  (t - (epoch + round_even((t - epoch) / period, 0) * period)) * 1440e0 AS oc_minutes {FOLD}""")
def _(spark, folder):
    lc, eph = both(spark, folder)
    out = O.oc_residuals(lc.withColumnRenamed("t", "t_obs"), eph)
    return out.select("event_id", "cycle", "oc_minutes")


@query("h30_transit_windows", f"""{LC16}, near AS (SELECT lc.*, {HOURS} AS h {FOLD} WHERE abs({HOURS}) <= 13),
g AS (SELECT target_id, sector, t - lag(t) OVER (PARTITION BY target_id, sector ORDER BY t) AS gap FROM lc),
x AS (SELECT target_id, sector, median(gap) AS exposure FROM g WHERE gap > 0 GROUP BY 1, 2),
i AS (SELECT target_id, sector, dense_rank() OVER (PARTITION BY target_id ORDER BY sector) - 1 AS k,
  sum(count(*)) OVER (PARTITION BY target_id) AS total FROM near GROUP BY 1, 2)
SELECT event_id, h AS phase_hours, CAST(k AS INTEGER) AS sector_index, round(exposure, 9) AS exposure
FROM near JOIN i USING (target_id, sector) JOIN x USING (target_id, sector) WHERE total >= 100""")
def _(spark, folder):
    out = O.transit_windows(*both(spark, folder, A.SERIES16))
    return out.select("event_id", "phase_hours", "sector_index", F.round("exposure", 9).alias("exposure"))
