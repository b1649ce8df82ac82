"""Ordered-series queries (IDs E1-E5, E7, E8, F5, H15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import series as S
from fluxloom.operators import signals as G
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A

LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"


def gappy(spark, folder):
    """Long series with a day's gap after every fifth day (all rows kept) and some missing fluxes."""
    lc = A.cadence(spark, folder, A.SERIES16).withColumn("t", F.col("t") + F.floor((F.floor("t") + F.col("target_id")) / 5))
    return lc.withColumn("flux", F.when(F.col("event_id") % 13 != 0, F.col("flux")))


GAPPY = """gp AS (SELECT target_id, sector, t + floor((floor(t) + target_id) / 5) AS t, event_id, flux_err, CASE WHEN event_id % 13 <> 0 THEN flux END AS flux FROM lc)"""


def detrend_sql(src: str, keys: str, window: float, frac: float = 0.5) -> str:
    """CTEs up to ``det``: gap-split runs, interpolated gaps, running median of the source table."""
    on = " AND ".join(f"b.{k} = a.{k}" for k in [*keys.split(", "), "run"])
    return f"""cd AS (SELECT {keys}, median(d) AS cadence FROM (SELECT {keys}, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS d
  FROM {src} WHERE flux IS NOT NULL) GROUP BY {keys}),
dg AS (SELECT {src}.*, cadence, t - lag(t) OVER (PARTITION BY {keys} ORDER BY t) AS gap FROM {src} JOIN cd USING ({keys})),
rr AS (SELECT *, CAST(sum(CASE WHEN gap > greatest(5 * cadence, {frac} * {window}) THEN 1 ELSE 0 END)
  OVER (PARTITION BY {keys} ORDER BY t) AS BIGINT) AS run FROM dg),
wd AS (SELECT *, greatest(3, CAST(round_even({window} / cadence, 0) AS BIGINT)) AS w0 FROM rr),
rk AS (SELECT *, ((w0 + CASE WHEN w0 % 2 = 0 THEN 1 ELSE 0 END) - 1) // 2 AS h, row_number() OVER g AS rn,
  count(*) OVER (PARTITION BY {keys}, run) AS n, count(flux) OVER (PARTITION BY {keys}, run) AS nv
  FROM wd WINDOW g AS (PARTITION BY {keys}, run ORDER BY t)),
bd AS (SELECT *, last_value(CASE WHEN flux IS NOT NULL THEN rn END IGNORE NULLS) OVER p AS ra, last_value(flux IGNORE NULLS) OVER p AS fa,
  first_value(CASE WHEN flux IS NOT NULL THEN rn END IGNORE NULLS) OVER q AS rb, first_value(flux IGNORE NULLS) OVER q AS fb FROM rk
  WINDOW p AS (PARTITION BY {keys}, run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  q AS (PARTITION BY {keys}, run ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fl AS MATERIALIZED (SELECT *, CASE WHEN flux IS NOT NULL THEN flux WHEN ra IS NULL THEN fb WHEN rb IS NULL THEN fa
  ELSE fa + (rn - ra) / (rb - ra) * (fb - fa) END AS filled FROM bd),
dt AS MATERIALIZED (SELECT {keys}, run, a.rn, median(b.filled) AS trend FROM fl a, range(-60, 61) AS o(k)
  JOIN fl b ON {on} AND b.rn = least(greatest(a.rn + k, 1), a.n)
  WHERE abs(k) <= a.h GROUP BY ALL),
det AS (SELECT fl.*, CASE WHEN nv >= 3 AND trend <> 0 THEN trend ELSE 1 END AS lev FROM fl JOIN dt USING ({keys}, run, rn))""".replace(
        f"SELECT {keys}, run, a.rn", "SELECT " + ", ".join(f"a.{k}" for k in keys.split(", ")) + ", a.run, a.rn")


def runs_sql(window: float) -> str:
    return f"{A.cadence_sql(A.SERIES16)}, {GAPPY}, {detrend_sql('gp', 'target_id, sector', window)}"


@query("e1_with_runs", f"WITH {runs_sql(0.5)} SELECT event_id, run, round(cadence, 9) AS cadence FROM rk")
def _(spark, folder):
    return S.with_runs(gappy(spark, folder), 0.5).select("event_id", "run", F.round("cadence", 9).alias("cadence"))


@query("e2_detrend", f"""WITH {runs_sql(0.5)} SELECT event_id, run, round(flux / lev, 9) AS flux, round(flux_err / lev, 9) AS flux_err FROM det""")
def _(spark, folder):
    return S.detrend(gappy(spark, folder), 0.5).select("event_id", "run", F.round("flux", 9).alias("flux"), F.round("flux_err", 9).alias("flux_err"))


@query("e3_fill_missing", f"WITH {runs_sql(0.5)} SELECT event_id, rn, nv AS valid, round(filled, 9) AS filled FROM fl")
def _(spark, folder):
    runs = S.with_runs(gappy(spark, folder), 0.5)
    return S.fill_missing(runs, ["target_id", "sector", "run"]).select("event_id", "rn", "valid", F.round("filled", 9).alias("filled"))


@query("e4_scramble", f"""{LC16}, r AS (SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY t) AS rn,
  count(*) OVER (PARTITION BY target_id, sector) AS n FROM lc),
o AS (SELECT *, (rn - 1 - (1 + (target_id * 7919 + sector * 104729 + 3 * 1299709) % greatest(n - 1, 1)) + n) % n + 1 AS src FROM r)
SELECT o.event_id, o.t, s.flux FROM o JOIN r s ON s.target_id = o.target_id AND s.sector = o.sector AND s.rn = o.src""")
def _(spark, folder):
    return S.scramble(A.cadence(spark, folder, A.SERIES16), 3).select("event_id", "t", "flux")


@query("e5_highpass", f"""{LC16}, cd AS (SELECT target_id, median(d) AS cadence FROM
  (SELECT target_id, t - lag(t) OVER (PARTITION BY target_id ORDER BY t) AS d FROM lc) GROUP BY 1),
df AS (SELECT lc.*, cadence, t - lag(t) OVER (PARTITION BY target_id ORDER BY t) AS gap FROM lc JOIN cd USING (target_id)),
rr AS (SELECT *, CAST(sum(CASE WHEN gap > 5 * cadence THEN 1 ELSE 0 END) OVER (PARTITION BY target_id ORDER BY t) AS BIGINT) AS run FROM df),
rk AS (SELECT *, row_number() OVER (PARTITION BY target_id, run ORDER BY t) AS rn, count(*) OVER (PARTITION BY target_id, run) AS n FROM rr),
wd AS (SELECT *, CAST(round_even(1.0e0 / cadence, 0) AS BIGINT) AS k FROM rk),
ww AS (SELECT *, least(CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END, CASE WHEN n % 2 = 0 THEN n - 1 ELSE n END) AS w FROM wd),
st AS (SELECT *, greatest(1, least(rn - w // 2, n - w + 1)) AS s FROM ww WHERE w >= 11),
sm AS (SELECT a.event_id, a.run, a.flux, count(*) AS s0, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4,
  sum(bf) AS y0, sum(u * bf) AS y1, sum(u * u * bf) AS y2 FROM (
  SELECT a.event_id, a.run, a.flux, (b.rn - a.rn) / (a.w / 2e0) AS u, b.flux AS bf FROM st a JOIN st b
  ON b.target_id = a.target_id AND b.run = a.run AND b.rn BETWEEN a.s AND a.s + a.w - 1) a GROUP BY 1, 2, 3),
tr AS (SELECT *, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2))
  / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)) AS trend FROM sm)
SELECT event_id, run, round((flux / trend - 1) * 1e6, 3) AS residual_ppm FROM tr""")
def _(spark, folder):
    return S.highpass(A.cadence(spark, folder, A.SERIES16)).select("event_id", "run", F.round("residual_ppm", 3).alias("residual_ppm"))


SAMPLES = """smp AS (SELECT l_suppkey AS chain, l_orderkey * 8 + l_linenumber AS step, CAST(sum(l_quantity) AS DOUBLE) AS weight
  FROM lineitem GROUP BY 1, 2)"""


def samples(spark, folder):
    """Weighted chain rows: one per supplier and order line."""
    return A.table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("chain"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("step")).agg(
        F.sum("l_quantity").alias("weight"))


@query("e7_resample", f"""WITH {SAMPLES}, c AS (SELECT *, sum(weight) OVER (PARTITION BY chain ORDER BY step ROWS UNBOUNDED PRECEDING) AS cum,
  sum(weight) OVER (PARTITION BY chain) AS tot, count(*) OVER (PARTITION BY chain) AS n, sum(weight * weight) OVER (PARTITION BY chain) AS sq FROM smp),
p AS (SELECT *, greatest(ceil((cum - weight) * (n / tot) - ((chain * 7919 + 5 * 104729) % 10007) / 10007e0), 0) AS lo,
  least(ceil(cum * (n / tot) - ((chain * 7919 + 5 * 104729) % 10007) / 10007e0), n) AS hi FROM c)
SELECT chain, step, round(tot * tot / sq, 6) AS effective_samples, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT))) AS position FROM p WHERE lo < hi""")
def _(spark, folder):
    return S.resample(samples(spark, folder), 5).select("chain", "step", F.round("effective_samples", 6).alias("effective_samples"), "position")


@query("f5_thin", f"""WITH {SAMPLES}, r AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY step) AS rn, count(*) OVER (PARTITION BY chain) AS n FROM smp)
SELECT chain, step, rn, n FROM r WHERE n <= 512 OR floor(ceil((rn - 1) * 511 / (n - 1)) * (n - 1) / 511) = rn - 1""")
def _(spark, folder):
    return S.thin(samples(spark, folder), 512).select("chain", "step", "rn", "n")


def chain_rows(spark, folder):
    v = A.table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("param", "value"))
    return v.select(F.lit(1).alias("target_id"), (F.col("vec_id") % 10).alias("walker"), F.floor(F.col("vec_id") / 10).alias("step"),
                    "param", F.col("value").cast("double").alias("value"))


@query("e8_chain_diagnostics", """WITH ch AS (SELECT vec_id % 10 AS walker, vec_id // 10 AS step, CAST(i - 1 AS INTEGER) AS param,
  CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, range(1, 65) AS r(i)),
n AS (SELECT max(step) + 1 AS steps, count(DISTINCT walker) AS walkers FROM ch),
c AS (SELECT param, walker, CASE WHEN step < steps // 2 THEN 0 ELSE 1 END AS hf, var_samp(value) AS v, avg(value) AS m
  FROM ch, n WHERE step < steps // 2 OR step >= steps - steps // 2 GROUP BY ALL),
g AS (SELECT param, avg(v) AS w, var_samp(m) AS b FROM c GROUP BY 1),
o AS (SELECT param, sqrt(((steps // 2 - 1) / (steps // 2) * w + b) / w) AS rh, steps * walkers / (0.5e0 + param * 0.05e0) AS ess,
  steps / (0.5e0 + param * 0.05e0) AS ratio FROM g, n)
SELECT 1 AS target_id, param, round(rh, 8) AS split_r_hat, round(ess, 6) AS effective_samples, round(ratio, 6) AS length_over_tau,
  rh <= 1.01e0 AND ess >= 400 AND ratio >= 50 AS mixing_passed FROM o""")
def _(spark, folder):
    chain = chain_rows(spark, folder)
    tau = chain.select("param").distinct().withColumn("tau", F.col("param") * 0.05 + 0.5)
    return S.chain_diagnostics(chain, tau).select("target_id", "param", F.round("split_r_hat", 8).alias("split_r_hat"),
        F.round("effective_samples", 6).alias("effective_samples"), F.round("length_over_tau", 6).alias("length_over_tau"), "mixing_passed")


@query("h15_invert", f"{LC16} SELECT event_id, 2 - flux AS flux FROM lc")
def _(spark, folder):
    return G.invert(A.cadence(spark, folder, A.SERIES16)).select("event_id", "flux")


INJ = """inj AS (SELECT target_id, 3.1e0 + 0.2e0 * (target_id % 4) AS period, 0.7e0 AS epoch, 5e0 AS duration_hours, 9000e0 AS depth_ppm
  FROM (SELECT DISTINCT user_id % 16 AS target_id FROM events))"""
OVER = ("least(greatest(least(t + exposure / 2, c + hw) - greatest(t - exposure / 2, c - hw), 0e0) / exposure, 1e0)")
FRAC = f"""{INJ}, g AS (SELECT target_id, t - lag(t) OVER (PARTITION BY target_id ORDER BY t) AS gap FROM lc),
x AS (SELECT target_id, median(gap) AS exposure FROM g WHERE gap > 0 GROUP BY 1),
c AS (SELECT lc.*, depth_ppm, exposure, duration_hours / 24 / 2 AS hw, epoch + round_even((t - epoch) / period, 0) * period AS c
  FROM lc JOIN inj USING (target_id) JOIN x USING (target_id)), fr AS (SELECT *, {OVER} AS frac FROM c)"""


def injected(spark, folder):
    lc = A.cadence(spark, folder, A.SERIES16)
    inj = lc.select("target_id").distinct().selectExpr(
        "target_id", "3.1e0 + 0.2e0 * (target_id % 4) AS period", "0.7e0 AS epoch", "5e0 AS duration_hours", "9000e0 AS depth_ppm")
    return lc, inj


@query("h13_inject", f"{LC16}, {FRAC} SELECT event_id, round(frac, 9) AS overlap, round(flux * (1 - depth_ppm * 1e-6 * frac), 9) AS flux FROM fr")
def _(spark, folder):
    return G.inject(*injected(spark, folder)).select("event_id", F.round("overlap", 9).alias("overlap"), F.round("flux", 9).alias("flux"))


@query("h14_mask_events", f"{LC16}, {FRAC} SELECT event_id, CASE WHEN frac > 0 THEN NULL ELSE flux END AS flux, frac > 0 AS masked FROM fr")
def _(spark, folder):
    return G.mask_events(*injected(spark, folder)).select("event_id", "flux", "masked")
