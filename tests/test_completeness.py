"""Operators against brute force where the registered queries do not reach."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import evidence as J
from fluxloom.operators import models as M
from fluxloom.operators import records as R
from fluxloom.operators import series
from fluxloom.operators import spectra as S
from fluxloom.session import cut


def test_aliases_match_as_written_and_compact(spark):
    texts = ["see HD 209458 here", "HD209458 b", "hd-209458.", "xhd209458", "HD 2094", "TIC 1234567 x", "short ab", "kepler  ten"]
    lines = spark.createDataFrame([("p", k, t) for k, t in enumerate(texts)], "path string, line_number int, line string")
    aliases = spark.createDataFrame([("HD 209458",), ("ab",), ("Kepler Ten",), (None,), ("",)], "alias string")
    exceptions = spark.createDataFrame([], "path string, line_number int, finding string, expires date")
    got = {(r.line_number, r.finding) for r in J.scan_text(lines, aliases, exceptions, "2024-01-01").collect()}
    assert got == {(0, "alias"), (1, "alias"), (2, "alias"), (5, "target-id"), (7, "alias")}


def test_every_star_keeps_a_row(spark):
    schema = "target_id long, teff_k double, logg_cgs double, feh double"
    stars = spark.createDataFrame([(1, 5000.0, 4.4, 0.0), (2, 500000.0, 4.0, 0.0), (3, 5000.0, 4.4, None), (4, 10.0, 1.0, -1.0), (5, 21000.0, 4.0, 0.1)], schema)
    grid = spark.createDataFrame([(10, 4900.0, 4.5, 0.0), (11, 5200.0, 4.5, 0.0), (12, 60000.0, 4.0, 0.0), (13, 60000.0, 5.0, 0.0), (14, None, 5.0, 0.0)], "node_id long, teff_k double, logg_cgs double, feh double")
    got = {r.target_id: (r.node_id, r.status) for r in M.nearest_atmosphere(stars, grid).collect()}
    assert got == {1: (10, "matched"), 2: (12, "matched"), 3: (None, "coordinate missing"), 4: (10, "matched"), 5: (11, "matched")}
    assert {r.status for r in M.nearest_atmosphere(stars, grid.where("false")).collect()} == {"coordinate missing", "no node"}


def test_eclipse_template_counts_all_draws(spark):
    rng = np.random.default_rng(5)
    rows = [(1, float(t), k) for k, t in enumerate(rng.uniform(0, 40, 300))]
    draws = [(1, float(p) if k % 17 else None, float(r)) for k, (p, r) in enumerate(zip(rng.uniform(0, 1, 2000), rng.uniform(0.2, 9, 2000)))]
    df = spark.createDataFrame(rows, "target_id long, t double, event_id long")
    eph = spark.createDataFrame([(1, 3.1, 0.4, 6.0)], "target_id long, period double, epoch double, duration_hours double")
    got = {r.event_id: r.template for r in M.eclipse_template(df, eph, spark.createDataFrame(draws, "target_id long, phase double, duration_ratio double")).collect()}
    for _, t, k in rows:
        x = (t - 0.4) / 3.1
        hits = sum(p is not None and abs((x - p + 0.5) % 1.0 - 0.5) < 6.0 / 48 / 3.1 * r for _, p, r in draws)
        assert got[k] == pytest.approx(hits / 2000, abs=1e-12)


def test_eclipse_of_a_circular_orbit_lies_half_a_turn_away(spark):
    chain = spark.createDataFrame([(1, 0.0, 1.0, 0.1, 0.2), (1, 0.3, math.pi / 2, 0.1, 0.1), (1, 1.2, 0.0, 0.1, 0.1), (1, 0.3, 0.5, 0.1, 3.0)], "target_id long, e double, omega double, rp double, b double")
    got = M.eclipse_draws(chain).collect()
    assert got[0].phase == pytest.approx(0.5) and got[0].duration_ratio == pytest.approx(1.0)
    assert got[1].phase == pytest.approx(0.5) and got[1].duration_ratio > 1.0
    assert got[2].phase is None and got[3].phase is None


def test_whitening_equals_running_median_and_gaussian(spark):
    rng = np.random.default_rng(1)
    n, step = 5000, 2.0
    power = rng.exponential(1.0, n)
    spec = spark.createDataFrame([(1, k, 100.0 + step * k, float(p)) for k, p in enumerate(power)], "target_id long, k int, frequency_uhz double, power double")
    got = sorted(S.whitened(spec).collect(), key=lambda r: r.k)
    half = int(100 / step) // 2
    padded = np.pad(power, half, mode="edge")
    flat = power / np.array([np.median(padded[k : k + 2 * half + 1]) for k in range(n)])
    sigma = 20 / step
    reach = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    smooth = np.convolve(np.pad(flat, reach, mode="edge"), kernel / kernel.sum(), mode="valid")
    assert [r.k for r in got] == list(range(n))
    assert np.allclose([r.whitened for r in got], flat) and np.allclose([r.envelope for r in got], smooth)


def test_comb_of_peaks_gives_its_spacing(spark):
    freq = np.arange(100.0, 400.0, 0.5)
    comb = 1.0 + 20.0 * np.exp(-0.5 * ((freq - 250) / 60) ** 2) * np.exp(-0.5 * (((freq - 250 + 20) % 40 - 20) / 1.5) ** 2)
    spec = spark.createDataFrame([(1, k, float(f), float(p)) for k, (f, p) in enumerate(zip(freq, comb))], "target_id long, k int, frequency_uhz double, whitened double")
    env = spark.createDataFrame([(1, 250.0), (2, 250.0)], "target_id long, numax_uhz double")
    got = {r.target_id: r for r in S.spacing_correlation(spec, env).collect()}
    assert got[1].dnu_uhz == pytest.approx(40, abs=1.0) and got[1].correlation > 0.5
    assert got[2].dnu_uhz is None


def test_draws_of_a_star_stay_in_its_row(spark):
    """No expansion into rows and no shuffle behind the draws; percentiles of the draws as numpy gives them."""
    env = spark.createDataFrame([(i, 1500.0 + i, 80.0, 0.4) for i in range(3)], "target_id long, numax_uhz double, dnu_uhz double, rayleigh_uhz double")
    got = S.seismic_draws(env, env.selectExpr("target_id", "5700D AS teff_k", "90D AS teff_k_err"), n=101)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "percentile" not in plan and "Aggregate" not in plan
    x = env.selectExpr("*", "5700D AS teff_k", "90D AS teff_k_err").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(101))))
    draw = lambda name, sigma, tag: F.col(name) + sigma * S.normal_draw(F.col("target_id"), F.col("_i"), F.lit(410 + tag))
    nu, dn, te = draw("numax_uhz", 0.4, 1) / S.NUMAX_SUN, draw("dnu_uhz", 0.4, 2) / S.DNU_SUN, draw("teff_k", 90.0, 3) / S.TEFF_SUN
    rows = x.select("target_id", (nu * F.sqrt(te) / (dn * dn)).alias("r")).toPandas()
    for row in got.where("param = 'radius_solar'").collect():
        want = np.quantile(rows["r"][rows["target_id"] == row.target_id], [0.16, 0.5, 0.84])
        assert row.n == 101 and [row.p16, row.median, row.p84] == pytest.approx(want, rel=1e-12)


def test_equal_atmosphere_nodes_are_met_once(spark):
    """A thousand copies of each node cost one comparison, and the first of them is the match."""
    grid = spark.range(5000).selectExpr("id + 7 AS node_id", "4000D + id % 5 * 100 AS teff_k", "4D AS logg_cgs", "0D AS feh")
    stars = spark.createDataFrame([(1, 4210.0, 4.0, 0.0), (2, 9000.0, 4.0, 0.0)], "target_id long, teff_k double, logg_cgs double, feh double")
    got = M.nearest_atmosphere(stars, grid)
    assert {r.target_id: r.node_id for r in got.collect()} == {1: 9, 2: 11}
    assert M.distinct_nodes(grid).count() == 5


def test_a_repeated_target_has_one_super_period(spark):
    eph = spark.createDataFrame([(1, 2.0), (1, 2.0)], "target_id long, period double")
    assert M.super_periods(eph, spark.createDataFrame([(1, 5.0)], "target_id long, companion_period double")).count() == 3


def test_posterior_of_a_star_is_finished_in_one_task(spark):
    """Percentiles of the product grid as plain loops give them; no row per node and distance."""
    rng = np.random.default_rng(2)
    rows = [(i, 5000.0 + 100 * (k % 5), 0.1 * (k // 5), 1.0 + 0.1 * rng.random(), float(rng.random())) for i in (1, 2) for k in range(20)]
    grid = spark.createDataFrame(rows, "target_id long, teff double, av double, radius_solar double, weight double")
    stars = spark.createDataFrame([(1, 18.0, 0.1, 0.9), (2, 18.0, 0.1, None), (3, 18.0, 0.1, 1.0)], "target_id long, parallax_mas double, parallax_mas_err double, mass_solar double")
    out = M.sed_posterior(grid, stars)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.target_id, r.param): r for r in out.collect()}
    assert set(got) == {(i, p) for i in (1, 2) for p in ("radius_solar", "luminosity_solar", "distance_pc", "logg_cgs")} - {(2, "logg_cgs")}
    for i in (1, 2):
        points = {}
        for t, _, teff, _, r, w in ((*x[:1], *x) for x in rows if x[0] == i):
            for k in range(-8, 9):
                p = 18.0 + k * 0.05
                value = r * (18.0 / p)
                points[value] = points.get(value, 0.0) + w * math.exp(-0.5 * (k * 0.5) ** 2)
        x = sorted(points)
        c = np.cumsum([points[v] for v in x]) / sum(points.values())
        want = [np.interp(level, c, x) for level in (0.16, 0.5, 0.84)]
        row = got[i, "radius_solar"]
        assert [row.p16, row.median, row.p84] == pytest.approx(want, rel=1e-9) and row.n == len(x)


def test_nodes_of_a_star_are_made_behind_the_exchange(spark):
    """Photometry is dealt out by number ahead of the nodes, which are neither shuffled nor joined again."""
    phot = spark.createDataFrame([(1, "G", 10.0, 0.1), (2, "G", 11.0, 0.1)], "target_id long, band string, mag double, err double")
    stars = spark.createDataFrame([(1, 18.0, 5500.0), (2, 18.0, 5500.0)], "target_id long, parallax_mas double, teff_prior double")
    plan = M.sed_grid(phot, stars)._jdf.queryExecution().optimizedPlan().toString()
    first = plan[:plan.index("Generate")]
    assert plan.count("RepartitionByExpression") == 1 and "RepartitionByExpression" not in first and "Join" not in first


def test_velocity_sums_do_not_multiply_rows(spark, monkeypatch):
    """No row per grid point is made of a row; parts of a target and missing values add up to what the whole gives."""
    rng = np.random.default_rng(5)
    n = 400
    t = np.sort(rng.uniform(0, 30, n))
    velocity = [None if k % 50 == 7 else float(4 * np.sin(2 * np.pi * t[k] / 3 + 1) + rng.normal(0, 1)) for k in range(n)]
    rows = [(1, "ab"[k % 2], float(t[k]), velocity[k], 1.0 + k % 3, float(np.cos(k))) for k in range(n)]
    rv = spark.createDataFrame(rows, "target_id long, instrument string, t double, velocity double, sigma double, activity double")
    periods = spark.createDataFrame([(1, 3.0)], "target_id long, period double")
    out = M.rv_compare(rv, periods)
    assert "explode(array(0.0, 0.2" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "FlatMapGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
    whole = out.first()
    monkeypatch.setattr(M, "ORBIT_ROWS", 90)
    monkeypatch.setattr(M, "ORBIT_STEP", 17)
    parts = M.rv_compare(rv, periods).first()
    assert whole["n"] == n and whole["aic_keplerian"] < whole["aic_constant"]
    for name in ("n", "chi2_constant", "chi2_keplerian", "aic_keplerian", "amplitude", "eccentricity", "trend"):
        assert parts[name] == pytest.approx(whole[name], rel=1e-9), name


def test_grid_completeness_meets_its_rows_once(spark):
    """Neither a join nor a gathering ahead of the one shuffle, whose tasks are many; NULL keys of both sides stay apart."""
    grid = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (1, 3), (2, None)], "target_id long, cell long")
    trials = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (3, 1), (2, None)], "target_id long, cell long")
    out = R.grid_completeness(grid, trials, ["target_id", "cell"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and f", {R.CELL_TASKS})" in plan
    rows = sorted(map(tuple, out.select("target_id", "cell", "reported", "problem").collect()), key=str)
    assert rows == sorted([(1, 1, 2, "repeated"), (1, 3, 0, "missing"), (3, 1, 1, "not declared"), (2, None, 0, "missing"), (2, None, 1, "not declared")], key=str)


def test_whitening_does_not_run_in_lambdas_and_makes_the_spectrum_once(spark):
    """Neither a lambda per point and neighbour nor a second periodogram; a missing power counts as the largest."""
    rng = np.random.default_rng(7)
    lc = spark.createDataFrame([(1, float(t), float(f), 1.0) for t, f in zip(np.sort(rng.uniform(0, 12, 400)), rng.normal(0, 1, 400))], "target_id long, t double, flux double, flux_err double")
    plan = S.power_spectrum(lc, 100.0, 220.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "FlatMapGroupsInPandas" not in plan and "collect_list" not in plan
    power = rng.exponential(1.0, 400)
    power[100:190] = np.nan
    spec = spark.createDataFrame([(1, k, 100.0 + k, None if np.isnan(p) else float(p)) for k, p in enumerate(power)], "target_id long, k int, frequency_uhz double, power double")
    got = sorted(S.whitened(spec).collect(), key=lambda r: r.k)
    padded = np.pad(np.where(np.isnan(power), np.inf, power), 50, mode="edge")
    level = np.array([np.sort(padded[k:k + 101])[50] for k in range(400)])
    sure = np.flatnonzero(np.isfinite(level) & np.isfinite(power))
    assert np.allclose([got[k].whitened for k in sure], power[sure] / level[sure], rtol=1e-12)
    assert all(got[k].whitened is None for k in range(100, 190)) and got[145].envelope is None and got[0].envelope > 0


def test_highpass_numbers_its_rows_once(spark):
    """The cadence comes from the rows that are numbered anyway; a series of equal instants does not end the others."""
    rows = [(1, 0.05 * k, 1.0 + 0.01 * math.sin(k)) for k in range(60)] + [(2, 0.05 * (k // 20), 1.0 + 0.01 * math.cos(k)) for k in range(60)]
    out = series.highpass(spark.createDataFrame(rows, "target_id long, t double, flux double"))
    assert "lag(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.groupBy("target_id").agg(F.count("residual_ppm").alias("n"), F.countDistinct("run").alias("runs")).collect()
    assert {r.target_id: (r.n, r.runs) for r in got} == {1: (60, 1), 2: (60, 3)}


def test_seismic_reads_its_input_and_fits_its_trend_once(spark, monkeypatch):
    """The rows are settled ahead of the mask and behind the high-pass, which several later steps read."""
    lc = spark.range(400).selectExpr("id % 2 AS target_id", "id DIV 2 * 0.02D AS t", "1D + sin(id) * 0.001D AS flux", "1D AS flux_err")
    eph = spark.createDataFrame([(0, 3.1, 0.4, 6.0)], "target_id long, period double, epoch double, duration_hours double")
    stars = spark.createDataFrame([(0, 5700.0, None, 1.0), (1, 5700.0, 1.0, None)], "target_id long, teff_k double, mass_prior double, radius_prior double")
    settled = []
    monkeypatch.setattr(S, "cut", lambda df: settled.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    out = S.seismic(lc, eph, stars, 100.0, 220.0)
    lines = [line for plan in settled for line in plan.splitlines()]
    assert sum("Range (" in line for line in lines) == 1 and sum("MapInPandas" in line and "_trend" in line for line in lines) == 1
    assert sorted(r.target_id for r in out.collect()) == [0, 1]
