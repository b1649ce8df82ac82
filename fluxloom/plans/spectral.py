"""Spectral queries (IDs E6, H5-H12, H31, H32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import spectra as S
from fluxloom.plans.registry import query
from fluxloom.sources import adapters as A

LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"
KEYS = ["target_id", "sector"]
F_MIN, F_MAX = 0.05, 1.0


def grid_of(spark, folder):
    lc = A.cadence(spark, folder, A.SERIES16)
    return lc, S.frequency_grid(lc, KEYS, F_MIN, F_MAX, 10)


FG = f"""fg AS (SELECT target_id, sector, count(*) AS n, min(t) AS t_min, avg(t) AS t_mean, max(t) - min(t) AS baseline, var_pop(t) AS t_var,
  sum(1 / (flux_err * flux_err) * flux) / sum(1 / (flux_err * flux_err)) AS y_mean FROM lc GROUP BY 1, 2 HAVING count(*) >= 50),
fx AS (SELECT *, 1 / (baseline * 10) AS df, CAST(round_even((1.0e0 - 0.05e0) / (1 / (baseline * 10)), 0) + 1 AS INTEGER) AS nf FROM fg),
fr AS (SELECT fx.*, CAST(k AS INTEGER) AS k, 0.05e0 + df * k AS f FROM fx, LATERAL (SELECT unnest(range(0, nf)) AS k))"""


def gls_sql(cos: str = "cos(f * 2 * pi() * (t - t_min))", sin: str = "sin(f * 2 * pi() * (t - t_min))") -> str:
    return f"""tr AS (SELECT target_id, sector, k, f, 1 / (flux_err * flux_err) AS w, flux - y_mean AS y, {cos} AS c, {sin} AS s FROM fr JOIN lc USING (target_id, sector)),
sm AS (SELECT target_id, sector, k, f, sum(w) AS sw, sum(w * c) AS sc, sum(w * s) AS ss, sum(w * c * c) AS scc, sum(w * c * s) AS scs, sum(w * s * s) AS sss,
  sum(w * y) AS sy, sum(w * y * c) AS syc, sum(w * y * s) AS sys, sum(w * y * y) AS syy FROM tr GROUP BY ALL),
ce AS (SELECT *, scc - sc * sc / sw AS cc, scs - sc * ss / sw AS cs, sss - ss * ss / sw AS s2, syc - sy * sc / sw AS yc, sys - sy * ss / sw AS ys, syy - sy * sy / sw AS yy FROM sm),
pw AS (SELECT target_id, sector, k, f, ((yc * s2 - ys * cs) * yc + (ys * cc - yc * cs) * ys) / (cc * s2 - cs * cs) / yy AS power FROM ce)"""


@query("h5_gls", f"{LC16}, {FG}, {gls_sql()} SELECT target_id, sector, k, round(f, 9) AS frequency, round(power, 9) AS power FROM pw")
def _(spark, folder):
    return S.gls(*grid_of(spark, folder), KEYS).select("target_id", "sector", "k", F.round("frequency", 9).alias("frequency"), F.round("power", 9).alias("power"))


WP = """wp AS (SELECT target_id, sector, k, f, pow(avg(cos(f * 2 * pi() * (t - t_mean))), 2) + pow(avg(sin(f * 2 * pi() * (t - t_mean))), 2) AS power
  FROM fr JOIN lc USING (target_id, sector) GROUP BY ALL)"""


@query("h6_window_power", f"{LC16}, {FG}, {WP} SELECT target_id, sector, k, round(power, 9) AS power FROM wp")
def _(spark, folder):
    return S.window_power(*grid_of(spark, folder), KEYS).select("target_id", "sector", "k", F.round("power", 9).alias("power"))


def peaks_of(spark, folder):
    lc, grid = grid_of(spark, folder)
    spacing = grid.select(*KEYS, (1.0 / F.col("baseline")).alias("spacing"))
    return lc, grid, spacing, S.top_peaks(S.window_power(lc, grid, KEYS), spacing, KEYS)


def greedy_sql() -> str:
    """CTE ``sel5``: five rounds, each taking the strongest peak clear of the earlier ones."""
    text = """lo AS (SELECT target_id, sector, f, power, 1 / baseline AS spacing, lag(power) OVER w AS l, lead(power) OVER w AS r FROM wp JOIN (SELECT target_id, sector, baseline FROM fg) USING (target_id, sector)
  WINDOW w AS (PARTITION BY target_id, sector ORDER BY k)),
cd AS (SELECT * FROM lo WHERE power >= l AND power >= r), sel0 AS (SELECT target_id, sector, f, power, 0 AS rank FROM cd WHERE false)"""
    for i in range(1, 6):
        text += f""", c{i} AS (SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY power DESC, f) AS k FROM cd c WHERE NOT EXISTS
  (SELECT 1 FROM sel{i - 1} s WHERE s.target_id = c.target_id AND s.sector = c.sector AND abs(c.f - s.f) < spacing)),
sel{i} AS (SELECT * FROM sel{i - 1} UNION ALL SELECT target_id, sector, f, power, {i - 1} FROM c{i} WHERE k = 1)"""
    return text


@query("e6_top_peaks", f"{LC16}, {FG}, {WP}, {greedy_sql()} SELECT target_id, sector, CAST(rank AS INTEGER) AS rank, round(f, 9) AS frequency, round(power, 9) AS power FROM sel5")
def _(spark, folder):
    return peaks_of(spark, folder)[3].select(*KEYS, "rank", F.round("frequency", 9).alias("frequency"), F.round("power", 9).alias("power"))


@query("h7_window_proximity", f"""{LC16}, {FG}, {WP}, {greedy_sql()}, n AS (SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY abs(f - 0.4e0), rank) AS k FROM sel5)
SELECT target_id, sector, round(f, 9) AS window_frequency, round(power, 9) AS window_power, round(abs(f - 0.4e0), 9) AS difference, abs(f - 0.4e0) <= 1 / baseline AS within_resolution
FROM n JOIN (SELECT target_id, sector, baseline FROM fg) USING (target_id, sector) WHERE k = 1""")
def _(spark, folder):
    lc, grid, spacing, peaks = peaks_of(spark, folder)
    best = spacing.withColumn("best_frequency", F.lit(0.4))
    out = S.window_proximity(peaks, best, KEYS)
    return out.select(*KEYS, *[F.round(c, 9).alias(c) for c in ("window_frequency", "window_power", "difference")], "within_resolution")


SEG = [("target_id", "o_custkey"), ("sector", "o_orderkey"), ("best_period", "1e0 + (o_orderkey * 7 % 190) / 10e0"), ("baseline", "CASE WHEN o_orderkey % 40 = 0 THEN 0e0 ELSE 20e0 + o_orderkey % 7 END")]
HP = """sg AS (SELECT *, 1 / best_period AS f FROM s0 WHERE baseline > 0), rf AS (SELECT DISTINCT target_id, f / v AS ref FROM sg, (VALUES (0.5e0), (1e0), (2e0)) AS x(v)),
jn AS (SELECT rf.target_id, ref, f, baseline, f / ref AS q FROM rf JOIN sg USING (target_id)),
fc AS (SELECT *, CASE WHEN abs(q - 0.5e0) <= abs(q - 1) AND abs(q - 0.5e0) <= abs(q - 2) THEN 0.5e0 WHEN abs(q - 1) <= abs(q - 2) THEN 1e0 ELSE 2e0 END AS h FROM jn),
sc AS (SELECT target_id, ref, count(*) FILTER (WHERE abs(f - h * ref) <= 1 / baseline) AS consistent, round(sum(abs(f - h * ref) * baseline), 9) AS residual, count(*) AS segments FROM fc GROUP BY 1, 2),
hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY consistent DESC, residual, ref) AS k FROM sc) WHERE k = 1)"""


@query("h8_harmonic_persistence", f"""WITH s0 AS (SELECT {', '.join(f'{e} AS {n}' for n, e in SEG)} FROM orders), {HP}
SELECT target_id, segments, CASE WHEN segments >= 2 THEN round(ref, 9) END AS reference_frequency, CASE WHEN segments >= 2 THEN consistent ELSE 0 END AS consistent_segments,
  CASE WHEN segments >= 2 THEN 'descriptive-harmonic-consistency' ELSE 'unresolved-insufficient-segments' END AS status FROM hb""")
def _(spark, folder):
    seg = A.table(spark, folder, "orders").selectExpr(*[f"{e} AS {n}" for n, e in SEG])
    return S.harmonic_persistence(seg).select("target_id", "segments", F.round("reference_frequency", 9).alias("reference_frequency"), "consistent_segments", "status")


@query("h9_sinusoid_amplitude", f"""{LC16}, tr AS (SELECT target_id, 1 / (flux_err * flux_err) AS w, flux - 1 AS y, cos(t * 2 * pi() / (5e0 + target_id)) AS c, sin(t * 2 * pi() / (5e0 + target_id)) AS s FROM lc),
sm AS (SELECT target_id, count(*) AS n, sum(w) AS sw, sum(w * c) AS sc, sum(w * s) AS ss, sum(w * c * c) AS scc, sum(w * c * s) AS scs, sum(w * s * s) AS sss,
  sum(w * y) AS sy, sum(w * y * c) AS syc, sum(w * y * s) AS sys, sum(w * y * y) AS syy FROM tr GROUP BY 1),
ce AS (SELECT *, scc - sc * sc / sw AS cc, scs - sc * ss / sw AS cs, sss - ss * ss / sw AS s2, syc - sy * sc / sw AS yc, sys - sy * ss / sw AS ys, syy - sy * sy / sw AS yy FROM sm),
ab AS (SELECT *, (yc * s2 - ys * cs) / (cc * s2 - cs * cs) AS a, (ys * cc - yc * cs) / (cc * s2 - cs * cs) AS b FROM ce)
SELECT target_id, n, round(sqrt(a * a + b * b) * 1e6, 4) AS amplitude_ppm,
  round(sqrt((a * a * s2 - 2 * a * b * cs + b * b * cc) / (a * a + b * b) / (cc * s2 - cs * cs) * (yy - a * yc - b * ys) / (n - 3)) * 1e6, 4) AS sigma_ppm FROM ab""")
def _(spark, folder):
    lc = A.cadence(spark, folder, A.SERIES16)
    periods = lc.select("target_id").distinct().withColumn("period", F.col("target_id") + 5.0)
    return S.sinusoid_amplitude(lc, periods).select("target_id", "n", F.round("amplitude_ppm", 4).alias("amplitude_ppm"), F.round("sigma_ppm", 4).alias("sigma_ppm"))


@query("h10_activity")
def _(spark, folder):
    return S.activity(A.cadence(spark, folder, A.SERIES16), A.ephemeris(spark, folder, A.SERIES16))


def spectrum(spark, folder):
    return S.power_spectrum(A.cadence(spark, folder, A.SERIES16), 100.0, 220.0)


@query("h11_oscillation_envelope")
def _(spark, folder):
    return S.oscillation_envelope(spectrum(spark, folder))


@query("h12_spacing_correlation")
def _(spark, folder):
    s = S.cut(spectrum(spark, folder))
    return S.spacing_correlation(s, S.oscillation_envelope(s))


def stars(spark, folder):
    ids = A.table(spark, folder, "events").select((F.col("user_id") % 16).alias("target_id")).distinct()
    return ids.select("target_id", (F.col("target_id") * 50 + 5200.0).alias("teff_k"), F.lit(80.0).alias("teff_k_err"),
                      F.when(F.col("target_id") % 3 != 0, F.col("target_id") * 0.02 + 0.9).alias("mass_prior"), F.when(F.col("target_id") % 4 != 0, F.col("target_id") * 0.03 + 0.8).alias("radius_prior"))


@query("h31_seismic_draws")
def _(spark, folder):
    env = A.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("target_id"), (F.col("s_acctbal") / 10 + 1500.0).alias("numax_uhz"),
        (F.col("s_acctbal") / 300 + 80.0).alias("dnu_uhz"), F.lit(0.4).alias("rayleigh_uhz"))
    star = env.select("target_id", F.lit(5700.0).alias("teff_k"), F.lit(90.0).alias("teff_k_err"))
    return S.seismic_draws(env, star)


@query("h32_seismic")
def _(spark, folder):
    out = S.seismic(A.cadence(spark, folder, A.SERIES16), A.ephemeris(spark, folder, A.SERIES16), stars(spark, folder), 100.0, 220.0)
    return out.select("target_id", "numax_uhz", "dnu_uhz", "n_points", "mass_solar", "radius_solar", "method", F.array_join("reasons", ";").alias("reasons"), "status")
