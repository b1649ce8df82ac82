"""Model queries (IDs H20-H28, D22, I1)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fluxloom.operators import models as M
from fluxloom.operators.parameters import derive_parameters
from fluxloom.plans.folds import wpct_sql
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A

LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


def trap(shift: str) -> str:
    return f"(1 - 0.04e0 * least(greatest((6e0 / 48 - abs(dt - ({shift}))) / (1e0 / 24), 0e0), 1e0))"


EVT = f"""nr0 AS (SELECT target_id, CAST(round_even((t - epoch) / period, 0) AS BIGINT) AS cycle, epoch + round_even((t - epoch) / period, 0) * period AS centre, t, flux, flux_err FROM lc JOIN eph USING (target_id)),
nr AS (SELECT *, t - centre AS dt FROM nr0 WHERE abs(t - centre) < 0.35e0),
gd AS (SELECT target_id, cycle, centre, j, count(*) AS n, sum(pow((flux - {trap('j * 0.001e0')}) / flux_err, 2)) AS x2 FROM nr, range(-20, 21) AS r(j) GROUP BY ALL HAVING count(*) >= 10),
lg AS (SELECT *, lag(x2) OVER w AS a, lead(x2) OVER w AS c, row_number() OVER (PARTITION BY target_id, cycle ORDER BY round(x2, 9), j) AS k FROM gd WINDOW w AS (PARTITION BY target_id, cycle ORDER BY j)),
ft AS (SELECT target_id, cycle, centre, n, coalesce(j * 0.001e0 + CASE WHEN abs(a - 2 * x2 + c) > 1e-12 THEN (a - c) / (a - 2 * x2 + c) * (0.5e0 * 0.001e0) ELSE 0 END, j * 0.001e0) AS shift FROM lg WHERE k = 1),
th AS (SELECT target_id, cycle, sum(pow((flux - {trap('shift - 0.001e0')}) / flux_err, 2)) AS x0, sum(pow((flux - {trap('shift')}) / flux_err, 2)) AS x1,
  sum(pow((flux - {trap('shift + 0.001e0')}) / flux_err, 2)) AS x2 FROM nr JOIN (SELECT target_id, cycle, shift FROM ft) USING (target_id, cycle) GROUP BY 1, 2)"""


def timing(spark, folder):
    template = A.ephemeris(spark, folder, A.SERIES16).withColumn("depth", F.lit(0.04)).withColumn("ingress_hours", F.lit(1.0))
    return M.event_times(A.cadence(spark, folder, A.SERIES16), template, min_points=10)


@query("h20_event_times", f"""{LC16}, {EVT} SELECT target_id, cycle, n, round(centre + shift, 7) AS t_obs, round(x1, 5) AS chi2,
  round(least(greatest(CASE WHEN x2 - 2 * x1 + x0 > 0 THEN sqrt(2 / ((x2 - 2 * x1 + x0) / (0.001e0 * 0.001e0))) ELSE 0.001e0 END, 0.0005e0), 0.05e0), 8) AS sigma FROM ft JOIN th USING (target_id, cycle)""")
def _(spark, folder):
    return rounded(rounded(rounded(timing(spark, folder), 7, "t_obs"), 5, "chi2"), 8, "sigma")


TIMES = """tm AS (SELECT l_suppkey AS target_id, l_orderkey % 400 AS cycle, 100e0 + 2.5e0 * (l_orderkey % 400) + (l_extendedprice - 30000) * 1e-7 AS t_obs, 0.001e0 * (1 + l_linenumber) AS sigma FROM lineitem)"""


@query("h21_linear_ephemeris", f"""WITH {TIMES}, md AS (SELECT target_id, count(*) AS n_events, CAST(round_even(median(cycle), 0) AS BIGINT) AS rc, min(t_obs) AS t0 FROM tm GROUP BY 1),
x AS (SELECT tm.*, n_events, rc, t0, CAST(cycle - rc AS DOUBLE) AS u, t_obs - t0 AS y, 1 / (sigma * sigma) AS w FROM tm JOIN md USING (target_id)),
s AS (SELECT target_id, max(n_events) AS n_events, max(rc) AS rc, max(t0) AS t0, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * y) AS y0, sum(w * u * y) AS y1 FROM x GROUP BY 1),
f AS (SELECT *, (s2 * y0 - s1 * y1) / (s0 * s2 - s1 * s1) AS a, (s0 * y1 - s1 * y0) / (s0 * s2 - s1 * s1) AS p FROM s),
c AS (SELECT target_id, sum(pow(t_obs - f.t0 - a - p * (cycle - f.rc), 2) / (sigma * sigma)) AS chi2, sqrt(avg(pow(t_obs - f.t0 - a - p * (cycle - f.rc), 2))) * 1440 AS rms FROM tm JOIN f USING (target_id) GROUP BY 1)
SELECT target_id, n_events, rc AS reference_cycle, round(t0 + a, 8) AS epoch, round(p, 9) AS period, round(sqrt(s2 / (s0 * s2 - s1 * s1)), 9) AS epoch_sigma,
  round(sqrt(s0 / (s0 * s2 - s1 * s1)), 10) AS period_sigma, round(chi2, 4) AS chi2, n_events - 2 AS dof, round(rms, 6) AS oc_rms_minutes, 'fit' AS status FROM f JOIN c USING (target_id)""")
def _(spark, folder):
    t = A.table(spark, folder, "lineitem").selectExpr("l_suppkey AS target_id", "l_orderkey % 400 AS cycle",
        "100e0 + 2.5e0 * (l_orderkey % 400) + (l_extendedprice - 30000) * 1e-7 AS t_obs", "0.001e0 * (1 + l_linenumber) AS sigma")
    out = M.linear_ephemeris(t).drop("covariance")
    return rounded(rounded(rounded(rounded(rounded(out, 8, "epoch"), 9, "period", "epoch_sigma"), 10, "period_sigma"), 4, "chi2"), 6, "oc_rms_minutes")


@query("h22_super_periods", """WITH x AS (SELECT l_partkey AS target_id, l_linenumber AS companion, max(l_quantity) AS companion_period, any_value(p_size) * 0.7e0 AS period FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT target_id, companion_period, CAST(j AS INTEGER) AS j, CASE WHEN abs(j / companion_period - (j - 1) / period) = 0 THEN 'infinity'::DOUBLE ELSE round(1 / abs(j / companion_period - (j - 1) / period), 6) END AS super_period
FROM x, (VALUES (2), (3), (4)) AS v(j) WHERE companion_period > period""")
def _(spark, folder):
    eph = A.table(spark, folder, "part").select(F.col("p_partkey").alias("target_id"), (F.col("p_size") * 0.7).alias("period"))
    comp = A.table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("target_id"), "l_linenumber").agg(F.max("l_quantity").alias("companion_period"))
    return rounded(M.super_periods(eph, comp), 6, "super_period")


@query("h23_h24_phase_curve")
def _(spark, folder):
    out = M.phase_curve(A.cadence(spark, folder, A.SERIES16), A.ephemeris(spark, folder, A.SERIES16))
    return rounded(out, 3, "amplitude_ppm", "error_ppm")


CHAIN = """ch AS (SELECT l_suppkey % 16 AS target_id, l_orderkey * 8 + l_linenumber AS step, max(l_discount) * 3 AS e, max(l_quantity) / 10 AS omega, max(l_tax) + 0.05e0 AS rp, max(l_linenumber) * 0.1e0 AS b FROM lineitem GROUP BY 1, 2)"""
GEO = """ck AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY step) AS rn, count(*) OVER (PARTITION BY target_id) AS n FROM ch),
tk AS (SELECT * FROM ck),
an AS (SELECT *, 2 * atan2(sqrt(1 - e) * sin((1.5e0 * pi() - omega) / 2), sqrt(1 + e) * cos((1.5e0 * pi() - omega) / 2)) AS eo,
  2 * atan2(sqrt(1 - e) * sin((0.5e0 * pi() - omega) / 2), sqrt(1 + e) * cos((0.5e0 * pi() - omega) / 2)) AS et FROM tk),
dm AS (SELECT *, eo - e * sin(eo) - (et - e * sin(et)) AS d, (1 + e * sin(omega)) / (1 - e * sin(omega)) AS ratio, (1 + rp) * (1 + rp) AS sz FROM an),
dr AS (SELECT target_id, step, (d - 2 * pi() * floor(d / (2 * pi()))) / (2 * pi()) AS phase, ratio * sqrt((sz - b * b * ratio * ratio) / (sz - b * b)) AS duration_ratio FROM dm
  WHERE sz - b * b > 0 AND sz - b * b * ratio * ratio > 0)"""


def draws(spark, folder):
    ch = A.table(spark, folder, "lineitem").groupBy((F.col("l_suppkey") % 16).alias("target_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("step")).agg(
        (F.max("l_discount") * 3).alias("e"), (F.max("l_quantity") / 10).alias("omega"), (F.max("l_tax") + 0.05).alias("rp"), (F.max("l_linenumber") * 0.1).alias("b"))
    return M.eclipse_draws(ch)


@query("h25_eclipse_template", f"""{LC16}, {CHAIN}, {GEO}, tot AS (SELECT target_id, count(*) AS total FROM tk GROUP BY 1),
q AS (SELECT event_id, {A.phase_sql()} / period AS x, duration_hours / 48 / period AS half, target_id FROM lc JOIN eph USING (target_id)),
h AS (SELECT q.event_id, count(*) AS c FROM q JOIN dr USING (target_id) WHERE abs((x - phase + 0.5e0) - floor(x - phase + 0.5e0) - 0.5e0) < half * duration_ratio GROUP BY 1)
SELECT q.event_id, coalesce(c, 0) / total AS template FROM q JOIN tot USING (target_id) LEFT JOIN h USING (event_id)""")
def _(spark, folder):
    return M.eclipse_template(A.cadence(spark, folder, A.SERIES16), A.ephemeris(spark, folder, A.SERIES16), draws(spark, folder)).select("event_id", "template")


@query("h25_circular_phase_summary", f"""WITH {CHAIN}, {GEO}, m0 AS (SELECT target_id, atan2(avg(sin(phase * 2 * pi())), avg(cos(phase * 2 * pi()))) / (2 * pi()) AS a FROM dr GROUP BY 1),
m AS (SELECT target_id, a - floor(a) AS ref FROM m0), o AS (SELECT target_id, ref, (phase - ref + 0.5e0) - floor(phase - ref + 0.5e0) - 0.5e0 AS v FROM dr JOIN m USING (target_id)),
s AS (SELECT target_id, count(*) AS n, any_value(ref) AS ref, quantile_cont(v, 0.16) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.84) AS c FROM o GROUP BY 1),
w AS (SELECT *, ref + a - floor(ref + a) AS lo, ref + b - floor(ref + b) AS mid, ref + c - floor(ref + c) AS hi FROM s)
SELECT target_id, n, round(mid, 8) AS median, round(lo, 8) AS p16, round(hi, 8) AS p84, lo > hi AS wraps, round((c - a) * 0.5, 8) AS half_width FROM w""")
def _(spark, folder):
    return rounded(M.circular_phase_summary(draws(spark, folder)), 8, "median", "p16", "p84", "half_width")


def eliminated(source, k, name):
    """One term taken out of the symmetric sums ``p``; the row of the term stays as ``r<k>``."""
    p = lambda i, j: f"p{min(i, j)}{max(i, j)}"
    cells = ", ".join(f"{p(i, j)} - {p(i, k)} * {p(k, j)} / {p(k, k)} AS {p(i, j)}" for i in range(5) for j in range(i, 5))
    return f"{name} AS (SELECT * EXCLUDE ({', '.join(p(i, j) for i in range(5) for j in range(i, 5))}), {', '.join(f'{p(k, j)} AS r{k}{j}' for j in range(5))}, {cells} FROM {source})"


RV_PAIRS = [(i, j) for i in range(5) for j in range(i, 5)]
RV_SUMS = ["norm", *[f"p{i}{j}" for i, j in RV_PAIRS]]
# every instrument's jitter against every other's: the product that the operator does not form
RV_CHAIN = ", ".join(
    f"c{m} AS (SELECT c{m - 1}.target_id, c{m - 1}.e, c{m - 1}.m0, c{m - 1}.n + coalesce(b.n, 0) AS n, c{m - 1}.k + CASE WHEN b.n IS NULL THEN 0 ELSE 1 END AS k, CASE WHEN b.n IS NULL THEN jits ELSE list_append(jits, b.jitter) END AS jits, "
    + ", ".join(f"c{m - 1}.{x} + coalesce(b.{x}, 0) AS {x}" for x in RV_SUMS) + f" FROM c{m - 1} LEFT JOIN bl b ON b.target_id = c{m - 1}.target_id AND b.e = c{m - 1}.e AND b.m0 = c{m - 1}.m0 AND b.place = {m})" for m in range(2, 6))


@query("h26_rv_compare", f"""WITH rv AS (SELECT user_id % 16 AS target_id, event_type AS instrument, (epoch_us(ts::TIMESTAMP) - 1704067200000000) / 86400e6 AS t, value::DOUBLE AS velocity,
  CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 + 2e0 AS sigma, sin(CAST(json_extract_string(props, '$.k') AS INTEGER) * 0.7e0) AS activity FROM events),
mid AS (SELECT target_id, avg(t) AS mid, avg(activity) AS level FROM rv GROUP BY 1),
gr AS (SELECT rv.*, mid, level, e, i, ((t - mid) / (target_id * 0.5e0 + 3) * 2 * pi() + i * 2 * pi() / 16) AS m FROM rv JOIN mid USING (target_id), (VALUES (0e0), (0.2e0), (0.4e0), (0.6e0)) ec(e), range(16) ph(i)),
an AS (SELECT *, m - floor(m / (2 * pi())) * 2 * pi() AS ma FROM gr), k0 AS (SELECT *, ma + e * sin(ma) AS x0 FROM an),
{", ".join(f"k{r} AS (SELECT * EXCLUDE (x{r - 1}), x{r - 1} - (x{r - 1} - e * sin(x{r - 1}) - ma) / (1 - e * cos(x{r - 1})) AS x{r} FROM k{r - 1})" for r in range(1, 9))},
nu AS (SELECT *, atan2(sqrt(1 + e) * sin(x8 / 2), sqrt(1 - e) * cos(x8 / 2)) * 2 AS nu FROM k8),
us AS (SELECT target_id, instrument, e, i AS m0, jitter, sigma * sigma + jitter * jitter AS var, t - mid AS u0, cos(nu) AS u1, sin(nu) AS u2, activity - level AS u3, velocity AS u4 FROM nu, (VALUES (0e0), (1e0), (3e0)) j(jitter)),
sm AS (SELECT target_id, e, m0, instrument, jitter, count(*) AS n, sum(1 / var) AS s, sum(ln(var * 2 * pi())) AS norm, {", ".join(f"sum(u{i} / var) AS s{i}" for i in range(5))}, {", ".join(f"sum(u{i} * u{j} / var) AS q{i}{j}" for i, j in RV_PAIRS)} FROM us GROUP BY ALL),
bl AS (SELECT target_id, e, m0, jitter, n, norm, {", ".join(f"q{i}{j} - s{i} * s{j} / s AS p{i}{j}" for i, j in RV_PAIRS)}, dense_rank() OVER (PARTITION BY target_id, e, m0 ORDER BY instrument) AS place FROM sm),
c1 AS (SELECT target_id, e, m0, n, 1 AS k, [jitter] AS jits, {", ".join(RV_SUMS)} FROM bl WHERE place = 1), {RV_CHAIN},
{eliminated("c5", 0, "d0")}, {eliminated("d0", 3, "d3")}, fl AS (SELECT *, p44 AS chi2_flat FROM d3), {eliminated("fl", 1, "d1")}, {eliminated("d1", 2, "d2")},
so AS (SELECT *, p44 AS chi2_kepler, r24 / r22 AS b2, (r14 - r12 * r24 / r22) / r11 AS b1 FROM d2),
ft AS (SELECT target_id, any_value(n) AS n, any_value(k) AS k, arg_min({{'f': chi2_flat + norm, 'c': chi2_flat}}, chi2_flat + norm) AS f, arg_min({{'g': chi2_kepler + norm, 'c': chi2_kepler, 'e': e, 'b1': b1, 'b2': b2, 'j': jits}}, chi2_kepler + norm) AS g FROM so GROUP BY 1)
SELECT target_id, n::BIGINT AS n, round(f.c, 4) AS chi2_constant, round(g.c, 4) AS chi2_keplerian, round((k * 2 + 2) * 2 + f.f, 4) AS aic_constant, round((k * 2 + 6) * 2 + g.g, 4) AS aic_keplerian,
  round((k * 2 + 2) * ln(n) + f.f, 4) AS bic_constant, round((k * 2 + 6) * ln(n) + g.g, 4) AS bic_keplerian, round(sqrt(g.b1 * g.b1 + g.b2 * g.b2), 5) AS amplitude, g.e AS eccentricity, g.j AS jitters FROM ft""")
def _(spark, folder):
    rv = A.events(spark, folder, A.SERIES16).select("target_id", F.col("event_type").alias("instrument"), "t", F.col("value").alias("velocity"), (F.col("k") % 5 + 2.0).alias("sigma"), F.sin(F.col("k") * 0.7).alias("activity"))
    periods = rv.select("target_id").distinct().withColumn("period", F.col("target_id") * 0.5 + 3.0)
    kept = M.rv_compare(rv, periods).drop("delta_aic", "delta_bic", "omega", "trend", "activity_coefficient").withColumn("jitters", F.transform("jitters", lambda j: j["jitter"]))
    return rounded(rounded(kept, 4, "chi2_constant", "chi2_keplerian", "aic_constant", "aic_keplerian", "bic_constant", "bic_keplerian"), 5, "amplitude")


PHOT = [(b, 6.0 + i * 0.03) for i, b in enumerate(M.BANDS)]
STAR = "5300e0 + (s_suppkey % 10) * 90e0"


def photometry(spark, folder):
    s = A.table(spark, folder, "supplier")
    rows = F.array(*[F.struct(F.lit(b).alias("band"), (F.col("s_acctbal") * 1e-4 + base + (F.col("s_suppkey") % (i + 2)) * 0.01).alias("mag"), F.lit(0.02 + 0.01 * i).alias("err")) for i, (b, base) in enumerate(PHOT)])
    phot = s.select(F.col("s_suppkey").alias("target_id"), F.explode(rows).alias("r")).select("target_id", "r.*")
    return phot, s.select(F.col("s_suppkey").alias("target_id"), F.expr(STAR).alias("teff_prior"), F.lit(18.0).alias("parallax_mas"))


BAND_ROWS = ", ".join(f"('{b}', {w}e0, {z}e0, {r}e0, {base}e0, {i}, {0.02 + 0.01 * i}e0)" for i, ((b, (w, z, r)), (_, base)) in enumerate(zip(M.BANDS.items(), PHOT)))
SED = f"""bd(band, wl, zp, ext, base, i, err) AS (VALUES {BAND_ROWS}),
ph AS (SELECT s_suppkey AS target_id, {STAR} AS teff_prior, wl, zp, ext, s_acctbal * 1e-4 + base + (s_suppkey % (i + 2)) * 0.01e0 AS mag, err FROM supplier, bd),
gn AS (SELECT ph.*, a * 100e0 + 3500 AS teff, c * 0.025e0 AS av, 299792458e0 / (wl * 1e-6) AS nu FROM ph, range(1, 45) AS x(a), range(1, 20) AS y(c)),
rs AS (SELECT target_id, teff, av, teff_prior, 1 / (err * err + 0.05e0 * 0.05e0) AS w, mag - (-2.5e0 * log10(nu * nu * nu * (2e0 * {M.PLANCK!r} / 299792458e0 / 299792458e0)
  / (exp(nu * ({M.PLANCK!r} / {M.BOLTZMANN!r}) / teff) - 1) * (pi() / 1e-26) / zp) + av * ext) + log10({M.SOLAR_RADIUS / M.PARSEC / 1000.0!r} * 18) * 5 AS r FROM gn),
nd AS (SELECT target_id, teff, av, teff_prior, count(*) AS n_bands, sum(w) AS w, sum(w * r) AS wr, sum(w * r * r) AS wrr FROM rs GROUP BY ALL),
sc AS (SELECT *, pow(10e0, wr / w / -5) AS radius_solar, wrr - wr / w * wr AS chi2 FROM nd),
lp AS (SELECT *, chi2 * -0.5e0 + ln(exp(pow((teff - teff_prior) / 150, 2) * -0.5e0) + exp(pow((teff - teff_prior - 250) / 150, 2) * -0.5e0) + 1e-300) - pow(av / 0.05e0, 2) * 0.5e0 AS logp FROM sc WHERE radius_solar > 1e0 / 3 AND radius_solar < 3),
sg AS (SELECT target_id, teff, av, n_bands, radius_solar, chi2, exp(logp - max(logp) OVER (PARTITION BY target_id)) AS weight FROM lp)"""


@query("h27_sed_grid", f"WITH {SED} SELECT target_id, teff, round(av, 4) AS av, n_bands, round(radius_solar, 7) AS radius_solar, round(chi2, 5) AS chi2, round(weight, 7) AS weight FROM sg")
def _(spark, folder):
    return rounded(rounded(rounded(M.sed_grid(*photometry(spark, folder)), 7, "radius_solar", "weight"), 5, "chi2"), 4, "av")


@query("h27_sed_summary", f"""WITH {SED}, mg AS (SELECT target_id, 'teff' AS param, teff AS x, sum(weight) AS w FROM sg GROUP BY 1, 3 UNION ALL SELECT target_id, 'av', av, sum(weight) FROM sg GROUP BY 1, 3
  UNION ALL SELECT target_id, 'radius_solar', radius_solar, sum(weight) FROM sg GROUP BY 1, 3), {wpct_sql('mg', 'target_id, param', '1, 2')}
SELECT target_id, param, round(p16, 5) AS p16, round(median, 5) AS median, round(p84, 5) AS p84 FROM wp""")
def _(spark, folder):
    return rounded(M.sed_summary(M.sed_grid(*photometry(spark, folder))), 5, "p16", "median", "p84").select("target_id", "param", "p16", "median", "p84")


@query("h27_sed_posterior", f"""WITH {SED}, ax AS (SELECT s_suppkey AS target_id, 0.6e0 + (s_suppkey % 7) * 0.1e0 AS mass, 1000 / (18 + k * 0.5e0 * err) AS distance_pc, 18 / (18 + k * 0.5e0 * err) AS far, exp(pow(k * 0.5e0, 2) * -0.5e0) AS pw
  FROM (SELECT s_suppkey, 0.05e0 * (s_suppkey % 5) AS err FROM supplier) s, range(-8, 9) AS d(k) WHERE err > 0),
px AS (SELECT target_id, teff, weight * pw AS w, radius_solar * far AS radius, mass FROM sg JOIN ax USING (target_id)),
lv AS (SELECT target_id, 'radius_solar' AS param, radius AS x, w FROM px UNION ALL SELECT target_id, 'luminosity_solar', radius * radius * pow(teff / 5772e0, 4), w FROM px
  UNION ALL SELECT target_id, 'logg_cgs', log10(mass) + 4.438e0 - log10(radius) * 2, w FROM px UNION ALL SELECT target_id, 'distance_pc', distance_pc, pw * g FROM ax JOIN (SELECT target_id, sum(weight) AS g FROM sg GROUP BY 1) USING (target_id)),
mg AS (SELECT target_id, param, x, sum(w) AS w FROM lv GROUP BY 1, 2, 3), {wpct_sql('mg', 'target_id, param', '1, 2')}
SELECT target_id, param, round(p16, 4) AS p16, round(median, 4) AS median, round(p84, 4) AS p84 FROM wp""")
def _(spark, folder):
    phot, stars = photometry(spark, folder)
    facts = stars.withColumns({"parallax_mas_err": F.col("target_id") % 5 * 0.05, "mass_solar": F.col("target_id") % 7 * 0.1 + 0.6})
    return rounded(M.sed_posterior(M.sed_grid(phot, stars), facts), 4, "p16", "median", "p84").select("target_id", "param", "p16", "median", "p84")



@query("h28_nearest_atmosphere", """WITH st AS (SELECT c_custkey AS target_id, 3000 + c_acctbal * 0.7e0 + CASE WHEN c_custkey % 13 = 0 THEN 400000 ELSE 0 END AS teff_k, 3.5e0 + (c_custkey % 15) * 0.1e0 AS logg_cgs, CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 7 - 3) * 0.1e0 END AS feh FROM customer),
g AS (SELECT p_partkey AS node_id, 3500e0 + (p_partkey % 24) * 100 AS teff_k, 3.5e0 + p_size % 4 * 0.5e0 AS logg_cgs, (p_partkey % 3 - 1) * 0.5e0 AS feh FROM part),
d AS (SELECT target_id, node_id, sqrt((st.teff_k - g.teff_k) * (st.teff_k - g.teff_k) + (st.logg_cgs - g.logg_cgs) * (st.logg_cgs - g.logg_cgs) + (st.feh - g.feh) * (st.feh - g.feh)) AS distance FROM st, g WHERE st.feh IS NOT NULL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY round(distance, 9), node_id) AS k FROM d) WHERE k = 1)
SELECT target_id, node_id, round(distance, 7) AS distance, CASE WHEN feh IS NULL THEN 'coordinate missing' ELSE 'matched' END AS status FROM st LEFT JOIN b USING (target_id)""")
def _(spark, folder):
    st = A.table(spark, folder, "customer").selectExpr("c_custkey AS target_id", "3000 + c_acctbal * 0.7e0 + CASE WHEN c_custkey % 13 = 0 THEN 400000 ELSE 0 END AS teff_k", "3.5e0 + (c_custkey % 15) * 0.1e0 AS logg_cgs", "CASE WHEN c_custkey % 11 > 0 THEN (c_custkey % 7 - 3) * 0.1e0 END AS feh")
    g = A.table(spark, folder, "part").selectExpr("p_partkey AS node_id", "3500e0 + (p_partkey % 24) * 100 AS teff_k", "3.5e0 + p_size % 4 * 0.5e0 AS logg_cgs", "(p_partkey % 3 - 1) * 0.5e0 AS feh")
    return rounded(M.nearest_atmosphere(st, g), 7, "distance")


D22_NAMES = ("rp", "log_rho", "b", "rho_star", "a_rs", "eccentricity", "omega_deg", "distance_a_rs", "inclination_deg", "area_ppm")


@query("d22_derived_posteriors", f"""WITH v AS (SELECT label AS target_id, vec_id AS step, 0.05e0 + abs(CAST(embedding[1] AS DOUBLE)) * 0.1e0 AS rp, CAST(embedding[2] AS DOUBLE) AS log_rho, abs(CAST(embedding[3] AS DOUBLE)) AS b,
  CAST(embedding[4] AS DOUBLE) AS c, CAST(embedding[5] AS DOUBLE) AS s, 3e0 + label * 0.5e0 AS period FROM embeddings),
w AS (SELECT *, pow(10e0, log_rho) AS rho_star, pow(period * 86400 * period * 86400 * (6.67430e-8 * 1.408e0 / (3e0 * pi())) * pow(10e0, log_rho), 1e0 / 3) AS a_rs, c * c + s * s AS eccentricity, degrees(atan2(s, c)) AS omega_deg, rp * rp * 1e6 AS area_ppm FROM v),
x AS (SELECT *, CASE WHEN eccentricity < 1 AND 1 + eccentricity * sin(radians(omega_deg)) > 0 THEN a_rs * (1 - eccentricity * eccentricity) / (1 + eccentricity * sin(radians(omega_deg))) END AS distance_a_rs FROM w),
y AS (SELECT *, degrees(acos(least(greatest(b / distance_a_rs, 0e0), 1e0))) AS inclination_deg FROM x),
z AS ({' UNION ALL '.join(f"SELECT target_id, '{n}' AS param, {n} AS v FROM y" for n in D22_NAMES)})
SELECT target_id, param, count(v) AS n, round(quantile_cont(v, 0.16), 6) AS p16, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.84), 6) AS p84 FROM z WHERE v IS NOT NULL GROUP BY 1, 2""")
def _(spark, folder):
    e = A.table(spark, folder, "embeddings")
    at = lambda i: F.col("embedding")[i].cast("double")
    params = (("rp", F.abs(at(0)) * 0.1 + 0.05), ("log_rho", at(1)), ("b", F.abs(at(2))), ("se_cos", at(3)), ("se_sin", at(4)))
    chain = e.select(F.col("label").alias("target_id"), F.col("vec_id").alias("step"), F.explode(F.array(*[F.struct(F.lit(n).alias("param"), v.alias("value")) for n, v in params])).alias("p"))
    eph = e.select(F.col("label").alias("target_id")).distinct().withColumn("period", F.col("target_id") * 0.5 + 3.0)
    return rounded(M.derived_posteriors(chain.select("target_id", "step", "p.*"), eph), 6, "p16", "median", "p84").select("target_id", "param", "n", "p16", "median", "p84")


CAT = [("period", "l_quantity - 1e0"), ("r_star", "0.5e0 + l_discount * 10"), ("m_star", "0.5e0 + l_tax * 10"), ("r_planet", "p_size / 5e0"), ("m_planet", "p_size * 1.5e0"), ("a_au", "0.02e0 + l_quantity * 0.01e0"),
       ("distance_pc", "p_retailprice / 10"), ("t_eq", "300e0 + p_size * 20"), ("e", "l_discount * 11"), ("omega_deg", "p_size * 7e0"), ("b", "l_linenumber * 0.2e0"), ("q1", "l_discount * 8"), ("q2", "l_tax * 13"),
       ("ra_offset", "l_linenumber * 0.3e0"), ("dec_offset", "p_size * 0.02e0"), ("dec", "p_size - 20e0"), ("sigma_arcsec", "l_tax * 20"), ("depth_odd", "l_quantity * 10"), ("depth_even", "l_quantity * 10 + p_size"), ("sigma_odd", "l_tax * 100"), ("sigma_even", "5e0"),
       ("insolation", "l_discount * 20"), ("m_star_err", "l_tax"), ("r_star_err", "0.02e0"), ("numax_uhz", "CASE WHEN l_linenumber % 3 = 0 THEN 0e0 ELSE 1000e0 + p_size * 40 END"), ("dnu_uhz", "CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 60e0 + p_size END"), ("teff_k", "5000e0 + p_size * 20")]
CAT_SQL = ", ".join(f"{e} AS {n}" for n, e in CAT)
FLOATS = ("k", "a_rs", "t14_hours", "t23_hours", "t12_hours", "distance_rs", "inclination_deg", "u1", "u2", "rv_semi_amplitude", "astrometric_uas", "scale_height_km", "transmission_ppm", "ellipsoidal_ppm",
          "centroid_z", "centroid_p", "odd_even_z", "log10_density_sigma", "seismic_mass_solar", "seismic_radius_solar")


@query("i1_derive_parameters", f"""WITH c0 AS (SELECT l_orderkey, l_linenumber AS line, {CAT_SQL} FROM lineitem JOIN part ON p_partkey = l_partkey),
c1 AS (SELECT *, CASE WHEN period <= 0 THEN 'non-positive physical input' WHEN e >= 1 THEN 'eccentricity outside [0, 1)' END AS reason, sin(radians(omega_deg)) AS sw FROM c0),
c2 AS (SELECT *, CASE WHEN reason IS NULL THEN r_planet * 0.0091577e0 / r_star END AS k, CASE WHEN reason IS NULL THEN pow(period * 86400 * period * 86400 * (6.67430e-8 * 1.408e0 / (3e0 * pi())) * (m_star / pow(r_star, 3)), 1e0 / 3) END AS a_rs,
  CASE WHEN reason IS NULL THEN sqrt(1 - e * e) / (1 + e * sw) END AS st FROM c1),
c3 AS (SELECT *, b > 1 - k AS grazing, CASE WHEN b >= 1 + k THEN 0 ELSE period * 24 / pi() / a_rs * sqrt(greatest(pow(1 + k, 2) - b * b, 0)) * st END AS t14_hours,
  CASE WHEN b > 1 - k THEN 0 ELSE period * 24 / pi() / a_rs * sqrt(greatest(pow(1 - k, 2) - b * b, 0)) * st END AS t23_hours,
  CASE WHEN reason IS NULL THEN a_rs * (1 - e * e) / (1 + e * sw) END AS distance_rs FROM c2),
c4 AS (SELECT *, CASE WHEN b / distance_rs < 1 THEN degrees(acos(CASE WHEN b / distance_rs < 1 THEN b / distance_rs END)) END AS inclination_deg, CASE WHEN q1 <= 1 AND q2 <= 1 THEN sqrt(q1) END AS sq,
  CASE WHEN reason IS NULL THEN t_eq * 1.380649e-23 / ((m_planet * (6.67430e-11 * 5.9722e24) / pow(r_planet * 6.3710e6, 2)) * (2.3e0 * 1.673557e-27)) / 1000 END AS scale_height_km,
  numax_uhz / 3090 AS nr, teff_k / 5772 AS tr, dnu_uhz / 135.1e0 AS dr, sqrt(sigma_odd * sigma_odd + 25e0) AS so FROM c3),
c5 AS (SELECT *, sin(radians(inclination_deg)) AS si, CASE WHEN sigma_arcsec > 0 THEN sqrt(pow(ra_offset * cos(radians(dec)), 2) + dec_offset * dec_offset) / sigma_arcsec END AS centroid_z FROM c4)
SELECT l_orderkey, line, reason, grazing, round(k, 9) AS k, round(a_rs, 7) AS a_rs, round(t14_hours, 7) AS t14_hours, round(t23_hours, 7) AS t23_hours, round((t14_hours - t23_hours) * 0.5e0, 7) AS t12_hours, round(distance_rs, 7) AS distance_rs,
  round(inclination_deg, 7) AS inclination_deg, round(sq * 2 * q2, 7) AS u1, round(sq * (1 - q2 * 2), 7) AS u2,
  round(m_planet * si * 0.0895e0 * CASE WHEN reason IS NULL THEN pow(m_star, -2e0 / 3) * pow(period, -1e0 / 3) / sqrt(1 - e * e) END, 7) AS rv_semi_amplitude,
  round(CASE WHEN reason IS NULL THEN m_planet * 3.00348e-6 / m_star * a_au / distance_pc * 1e6 END, 10) AS astrometric_uas, round(scale_height_km, 7) AS scale_height_km,
  round(r_planet * 6371 * 10 * scale_height_km / pow(r_star * 695700e0, 2) * 1e6, 7) AS transmission_ppm,
  round(CASE WHEN reason IS NULL THEN m_planet * 3.00348e-6 / m_star * pow(r_star * 0.00465047e0 / a_au, 3) * si * si * 1.2e6 END, 7) AS ellipsoidal_ppm,
  round(centroid_z, 7) AS centroid_z, round(exp(centroid_z * centroid_z * -0.5e0), 7) AS centroid_p, round(CASE WHEN sigma_odd > 0 THEN abs(depth_odd - depth_even) / so END, 7) AS odd_even_z,
  round(CASE WHEN reason IS NULL AND m_star_err > 0 THEN sqrt(pow(m_star_err / m_star, 2) + pow(3 * r_star_err / r_star, 2)) / ln(10) END, 9) AS log10_density_sigma,
  CASE WHEN insolation > 0 THEN insolation BETWEEN 0.32e0 AND 1.11e0 END AS habitable_zone,
  round(CASE WHEN dnu_uhz > 0 AND numax_uhz > 0 THEN pow(nr * sqrt(tr) / (dr * dr), 3) * dr * dr WHEN dnu_uhz > 0 THEN pow(r_star, 3) * dr * dr ELSE m_star END, 7) AS seismic_mass_solar,
  round(CASE WHEN dnu_uhz > 0 AND numax_uhz > 0 THEN nr * sqrt(tr) / (dr * dr) WHEN dnu_uhz > 0 THEN r_star WHEN numax_uhz > 0 THEN sqrt(m_star / (nr * sqrt(tr))) ELSE r_star END, 7) AS seismic_radius_solar,
  CASE WHEN dnu_uhz > 0 AND numax_uhz > 0 THEN 'full-numax-dnu-scaling' WHEN dnu_uhz > 0 THEN 'dnu-density-scaling-with-radius-prior' WHEN numax_uhz > 0 THEN 'numax-scaling-with-mass-prior' ELSE 'stellar-priors-only' END AS seismic_method FROM c5""")
def _(spark, folder):
    j = A.table(spark, folder, "lineitem").join(A.table(spark, folder, "part"), F.expr("p_partkey = l_partkey"))
    out = derive_parameters(j.selectExpr("l_orderkey", "l_linenumber AS line", *[f"{e} AS {n}" for n, e in CAT]))
    return out.select("l_orderkey", "line", "reason", "grazing", *[F.round(c, {"k": 9, "log10_density_sigma": 9, "astrometric_uas": 10}.get(c, 7)).alias(c) for c in FLOATS], "habitable_zone", "seismic_method")
