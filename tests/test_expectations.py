"""Small fixtures with known numbers."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.functions import fold
from fluxloom.operators import catalogs, controls, folding, models, pixels, search, series, signals, spectra


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def one_target(spark, t, flux, err=1e-4, sector=1):
    n = len(t)
    return frame(spark, target_id=np.ones(n, "int64"), sector=np.broadcast_to(np.asarray(sector, "int32"), n).copy(), t=np.asarray(t, float),
                 flux=np.asarray(flux, float), flux_err=np.full(n, float(err)))


def ephemeris(spark, period, epoch, hours):
    return spark.createDataFrame([(1, float(period), float(epoch), float(hours))], "target_id long, period double, epoch double, duration_hours double")


def test_fold(spark):
    rows = frame(spark, t=[0.0, 0.5, 1.0]).select(fold.phase_hours("t", F.lit(1.0), F.lit(0.0)).alias("h")).toPandas()
    assert rows["h"].tolist() == [0.0, -12.0, 0.0]


def test_depth_and_shift_by_one_period(spark):
    t = [0.0, 1.0, 2.0, 0.06, 0.94, 1.06, 1.94]
    lc = one_target(spark, t, [0.99] * 3 + [1.0] * 4)
    for epoch in (0.0, 1.0):
        row = folding.transit_depth(lc, ephemeris(spark, 1.0, epoch, 1.0)).first()
        assert row["depth_ppm"] == pytest.approx(10000, abs=1e-6) and row["uncertainty_ppm"] == pytest.approx(0, abs=1e-6)
        assert (row["n_in"], row["n_out"]) == (3, 4)


def test_phase_bins_count(spark):
    lc = one_target(spark, [0.0, 0.01, 0.02, 0.03, 0.04], [1.0] * 5)
    assert folding.phase_bins(lc, ephemeris(spark, 1, 0, 1), 1.0, 30.0).count() == 4


@pytest.mark.parametrize("depths,loud", [((1000, 1000), False), ((2600, 600), True)])
def test_odd_even(spark, depths, loud):
    rng = np.random.default_rng(47)
    t = np.arange(0, 30, 6 / 1440)
    cycle = np.floor((t - 0.75) / 2.6 + 0.5).astype(int)
    inside = np.abs((t - 0.75 + 1.3) % 2.6 - 1.3) < 0.05
    flux = 1 + rng.normal(0, 60e-6, t.size) - np.where(inside, np.where(cycle % 2 == 0, depths[0], depths[1]), 0) * 1e-6
    row = folding.screen(one_target(spark, t, flux), ephemeris(spark, 2.6, 0.75, 2.4)).first()
    assert (row["odd_even_z"] > 3) == loud
    if not loud:
        assert row["primary_depth_ppm"] == pytest.approx(1000, abs=120)
    else:
        assert row["double_primary_depth_ppm"] == pytest.approx(depths[0], abs=160)
        assert row["double_alternating_depth_ppm"] == pytest.approx(depths[1], abs=160)


def test_detrend_gap_split_and_trend(spark):
    lc = one_target(spark, [0, 0.1, 0.2, 10, 10.1, 10.2], [1.0] * 3 + [2.0] * 3)
    out = series.detrend(lc, 1.0).toPandas()
    assert out["flux"].tolist() == [1.0] * 6 and sorted(out["run"].unique()) == [0, 1]
    t = np.arange(400) * 0.05
    slope = one_target(spark, t, 1 + 0.01 * (t % 10), sector=np.where(t < 10, 1, 2))
    flat = series.detrend(slope, 1.0).toPandas()["flux"]
    assert abs(np.median(flat) - 1) < 0.001


def test_detrend_blocks_match_a_plain_filter(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 64)
    rng = np.random.default_rng(5)
    t = np.arange(700) * 0.01
    v = rng.normal(1, 0.01, t.size)
    out = series.detrend(one_target(spark, t, v), 0.21).toPandas().sort_values("t")
    padded = np.pad(v, 10, mode="edge")
    want = v / np.array([np.median(padded[i:i + 21]) for i in range(t.size)])
    np.testing.assert_allclose(out["flux"], want, rtol=1e-12)


def test_highpass_matches_polyfit(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 50)
    rng = np.random.default_rng(6)
    t = np.arange(200) * 0.05
    v = 1 + 0.01 * np.sin(t) + rng.normal(0, 0.001, t.size)
    out = series.highpass(one_target(spark, t, v), 1.05).toPandas().sort_values("t")
    want = []
    for i in range(t.size):
        s = min(max(i - 10, 0), t.size - 21)
        u = np.arange(s, s + 21) - i
        want.append((v[i] / np.polyval(np.polyfit(u, v[s:s + 21], 2), 0) - 1) * 1e6)
    np.testing.assert_allclose(out["residual_ppm"], want, atol=1e-4)


def test_controls_keep_the_sample(spark):
    lc = one_target(spark, np.arange(6.0), [0.99, 1.0, 1.01, 1.5, 1.6, 1.7], sector=[1, 1, 1, 2, 2, 2])
    assert signals.invert(lc).orderBy("t").toPandas()["flux"].round(9).tolist()[:3] == [1.01, 1.0, 0.99]
    mixed = series.scramble(lc, 5).toPandas().sort_values("t")
    assert sorted(mixed["flux"][:3]) == [0.99, 1.0, 1.01] and sorted(mixed["flux"][3:]) == [1.5, 1.6, 1.7]
    assert mixed["flux"].tolist() != [0.99, 1.0, 1.01, 1.5, 1.6, 1.7]


def test_box_overlap(spark):
    lc = one_target(spark, [0.0], [1.0]).withColumn("exposure", F.lit(0.1))
    eph = ephemeris(spark, 1.0, 0.0, 0.6).withColumn("depth_ppm", F.lit(1000.0))
    row = signals.inject(lc, eph).first()
    assert row["overlap"] == pytest.approx(0.25) and row["flux"] == pytest.approx(1 - 0.001 * 0.25)


def test_box_search_recovers_an_injected_signal(spark):
    rng = np.random.default_rng(11)
    t = np.arange(0, 20, 0.01)
    flux = 1 + rng.normal(0, 5e-4, t.size) - 0.005 * (np.abs((t - 1 + 2) % 4 - 2) < 0.06)
    lc = one_target(spark, t, flux, 5e-4)
    best = search.select_duration(search.box_search(lc, ["target_id"], (2.0, 3.0), 2.0, 6.0, 200), ["target_id"]).first()
    assert best["status"] == "detected" and best["period"] == pytest.approx(4.0, rel=0.01) and best["snr"] > 10
    assert best["depth_ppm"] == pytest.approx(5000, rel=0.2) and best["n_events"] == 5


def box_brute_force(t, flux, err, grid, hours):
    """All trials of one series by plain loops: {trial: (period, epoch, power, events)}."""
    w = 1.0 / (err * err)
    out = {}
    for i in range(grid["n_trials"]):
        period = 1.0 / (1.0 / grid["period_min"] - grid["step"] * i)
        bins = int(np.rint(period / (hours / 24.0 / search.K)))
        turns = (t - t.min()) / period
        cell = np.minimum(((turns - np.floor(turns)) * bins).astype(int), bins - 1)
        best = None
        for start in range(bins):
            inside = np.isin(cell, [(start + j) % bins for j in range(search.K)])
            if not inside.any() or inside.all():
                continue
            a, b = w[inside].sum(), w[~inside].sum()
            depth = (w * flux)[~inside].sum() / b - (w * flux)[inside].sum() / a
            power = round(a * depth * depth * 0.5, search.SCORE_DIGITS)
            if depth > 0 and (best is None or power > best[0]):
                best = (power, start)
        if best:
            epoch = t.min() + (best[1] + search.K / 2) * period / bins
            phase = (t - epoch + period / 2) % period - period / 2
            near = t[np.abs(phase) * 24 <= hours / 2]
            out[i] = (period, epoch, best[0], len(set(np.rint((near - epoch) / period))))
    return out


@pytest.mark.parametrize("held", [search.ROWS_PER_TASK, 40])
def test_box_search_equals_plain_loops(spark, monkeypatch, held):
    """Also for series in several parts (``held`` below their length), one of them with a single event."""
    monkeypatch.setattr(search, "ROWS_PER_TASK", held)
    monkeypatch.setattr(search, "TRIALS_PER_TASK", 7)
    monkeypatch.setattr(search, "TASK_WORK", 900)
    rng = np.random.default_rng(4)
    t = [np.sort(rng.uniform(0, 9, n)) for n in (90, 120, 60)]
    flux = [1 + rng.normal(0, 1e-3, len(x)) for x in t]
    flux[0][np.abs((t[0] - 0.7 + 1) % 2 - 1) < 0.15] -= 0.02
    flux[1][np.abs(t[1] - 4.4) < 0.2] -= 0.05
    lc = frame(spark, target_id=np.repeat([0, 1, 2], [90, 120, 60]), t=np.concatenate(t), flux=np.concatenate(flux), flux_err=np.full(270, 1e-3))
    facts = search.series_facts(lc, ["target_id"]).selectExpr("*", "1.5D AS period_min", "5.5D AS period_max")
    grid = search.period_grid(facts, (7.0, 9.0), 40)
    facts_of = {(r.target_id, r.duration_hours): r.asDict() for r in grid.collect()}
    got = {(r.target_id, r.duration_hours, r.trial): r for r in search.box_periodogram(lc, grid, ["target_id"]).collect()}
    peaks = {(r.target_id, r.duration_hours): r for r in search.select_peak(lc, grid, ["target_id"], 0.0).collect()}
    assert len(peaks) == 6
    for (target, hours), g in facts_of.items():
        want = box_brute_force(t[target], flux[target], np.full(len(t[target]), 1e-3), g, hours)
        assert {k[2] for k in got if k[:2] == (target, hours)} == set(want)
        for i, (period, epoch, power, _) in want.items():
            row = got[target, hours, i]
            assert (row.period, row.power) == pytest.approx((period, power), rel=1e-7)
        rank = sorted(((power, i) for i, (_, _, power, events) in want.items() if events >= 2), reverse=True)
        row = peaks[target, hours]
        assert row.n_trials == g["n_trials"]
        if rank:
            period, epoch, _, events = want[rank[0][1]]
            assert (row.period, row.epoch) == pytest.approx((period, epoch), rel=1e-9) and row.n_events == events
        else:
            assert row.status == "no-detection" and row.n_events == 0


@pytest.mark.parametrize("even", [False, True])
def test_box_sums_of_a_long_series_do_not_visit_its_rows(monkeypatch, even):
    """Running sums at the bin borders give what the rows give, also for equal times and rows on a border."""
    rng = np.random.default_rng(8)
    t = np.sort(np.round(rng.uniform(0, 12, 5000) * 48) / 48 if even else rng.uniform(0, 12, 5000)) + 3
    flux, w = 1 + rng.normal(0, 0.02, 5000) - 0.01 * (np.abs((t - 4) % 2.7) < 0.2), 1 / rng.choice([4e-3, 5e-3, 6e-3], 5000) ** 2
    g = SimpleNamespace(first=0, last=400, period_min=0.2, step=0.012, duration_hours=5.0, t_start=t[0], w_all=w.sum(), wy_all=(w * flux).sum())
    plain = search.window_sums
    monkeypatch.setattr(search, "window_sums", None)
    got = search.scan(t, flux, w, g)
    monkeypatch.setattr(search, "window_sums", plain)
    monkeypatch.setattr(search, "FEWEST_BITS", 1)
    want = search.scan(t, flux, w, g)
    assert len(want["trial"]) > 300 and (got["trial"] == want["trial"]).all()
    for name in want:
        assert got[name] == pytest.approx(want[name], rel=1e-9), name
    for i in range(0, len(got["trial"]), 7):
        phase = (t - got["epoch"][i] + got["period"][i] / 2) % got["period"][i] - got["period"][i] / 2
        near = t[np.abs(phase) * 24 <= 5.0 / 2]
        assert search.count_events(t, got["period"][i], got["epoch"][i], 5.0) == len(set(np.rint((near - got["epoch"][i]) / got["period"][i])))


def test_box_search_without_a_signal_keeps_a_row(spark):
    t = np.arange(0, 10, 0.05)
    lc = one_target(spark, t, 1 + 1e-4 * np.sin(t), 0.01)
    row = search.box_search(lc, ["target_id"], (3.0,), 1.0, 3.0, 50).first()
    assert row["status"] == "no-detection" and row["period"] is None and row["n_trials"] >= 50


def test_linear_ephemeris(spark):
    times = frame(spark, target_id=[1] * 4, cycle=[10, 11, 12, 13], t_obs=[100.0, 102.5, 105.0, 107.5], sigma=[0.001] * 4)
    row = models.linear_ephemeris(times).first()
    assert row["reference_cycle"] == 12 and row["period"] == pytest.approx(2.5) and row["chi2"] == pytest.approx(0, abs=1e-9)
    assert models.linear_ephemeris(times.limit(1)).first()["status"] == "not-fit-insufficient-transits"


def test_event_times(spark):
    rng = np.random.default_rng(17)
    t = np.arange(0, 35, 20 / 1440)
    dt = (t - 2 + 1.75) % 3.5 - 1.75
    flux = 1 - 0.01 * np.clip((0.1 - np.abs(dt)) / 0.02, 0, 1) + rng.normal(0, 1e-4, t.size)
    template = ephemeris(spark, 3.5, 2.0, 4.8).withColumn("depth", F.lit(0.01)).withColumn("ingress_hours", F.lit(0.48))
    got = models.event_times(one_target(spark, t, flux), template)
    fit = models.linear_ephemeris(got).first()
    assert got.count() >= 5 and fit["oc_rms_minutes"] < 2 and fit["period"] == pytest.approx(3.5, abs=1e-3)


def test_phase_curve_matches_dense_regression(spark):
    rng = np.random.default_rng(13)
    t = np.sort(rng.uniform(0, 26, 900))
    sector = np.where(t < 13, 1, 2)
    phase = (t - 1 + 1.6) % 3.2 - 1.6
    flux = 1 + 150e-6 * -np.cos(2 * np.pi * phase / 3.2) + rng.normal(0, 4e-4, t.size)
    got = models.phase_curve(one_target(spark, t, flux, 4e-4, sector), ephemeris(spark, 3.2, 1.0, 3.0)).toPandas().set_index("component")
    keep = np.abs(phase) > 0.65 * 3 / 24
    t, sector, phase, flux = t[keep], sector[keep], phase[keep], flux[keep]
    cols, cluster, start = [], np.zeros(t.size, int), 0
    for s in (1, 2):
        m = sector == s
        cols += [m.astype(float), np.where(m, t - np.median(t[m]), 0)]
        b = np.floor((t[m] - t[m].min()) / 0.5).astype(int)
        cluster[m] = b + start
        start += b.max() + 1
    a = 2 * np.pi * phase / 3.2
    far = np.abs((phase / 3.2 - 0.5 + 0.5) % 1 - 0.5)
    cols += [-np.cos(a), np.sin(a), -np.cos(2 * a), np.sin(2 * a), -(far < 0.5 * 0.125 / 3.2).astype(float)]
    x = np.column_stack(cols) / 4e-4
    beta = np.linalg.lstsq(x, flux / 4e-4, rcond=None)[0]
    r = flux / 4e-4 - x @ beta
    bread = np.linalg.pinv(x.T @ x)
    groups = np.unique(cluster)
    meat = sum(np.outer(x[cluster == g].T @ r[cluster == g], x[cluster == g].T @ r[cluster == g]) for g in groups)
    n, p, g = t.size, x.shape[1], groups.size
    err = np.sqrt(np.diag(g / (g - 1) * (n - 1) / (n - p) * bread @ meat @ bread))
    np.testing.assert_allclose(got.loc[list(models.PHYSICAL), "amplitude_ppm"], beta[-5:] * 1e6, rtol=1e-5, atol=1e-3)
    np.testing.assert_allclose(got.loc[list(models.PHYSICAL), "error_ppm"], err[-5:] * 1e6, rtol=1e-4)


def test_rv_compare_finds_the_orbit(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 60, 80))
    v = 50 * np.cos(2 * np.pi * t / 7 + 0.4) + np.where(np.arange(80) % 2, 10.0, -5.0) + 0.1 * t + rng.normal(0, 1, 80)
    rv = frame(spark, target_id=np.ones(80, "int64"), instrument=np.where(np.arange(80) % 2, "a", "b"), t=t, velocity=v, sigma=np.ones(80))
    row = models.rv_compare(rv, spark.createDataFrame([(1, 7.0)], "target_id long, period double")).first()
    assert row["amplitude"] == pytest.approx(50, rel=0.03) and row["eccentricity"] == 0.0 and row["delta_bic"] > 100
    assert row["chi2_keplerian"] < 200 < row["chi2_constant"]


def test_true_anomaly_solves_kepler(spark):
    m, e = np.linspace(0.1, 6.2, 20), 0.6
    nu = frame(spark, m=m).select(models.true_anomaly(F.col("m"), F.lit(e)).alias("nu")).toPandas()["nu"].to_numpy()
    big = 2 * np.arctan2(np.sqrt(1 - e) * np.sin(nu / 2), np.sqrt(1 + e) * np.cos(nu / 2))
    np.testing.assert_allclose(np.mod(big - e * np.sin(big), 2 * np.pi), m, atol=1e-9)


def test_rotation_period(spark):
    rng = np.random.default_rng(29)
    t = np.arange(0, 27, 0.02)
    lc = one_target(spark, t, 1 + 400e-6 * np.sin(2 * np.pi * t / 5) + rng.normal(0, 150e-6, t.size), 150e-6)
    row = spectra.activity_segments(lc).first()
    assert row["best_period"] == pytest.approx(5, rel=0.05) and row["fap"] < 1e-6
    amp = spectra.sinusoid_amplitude(lc, spark.createDataFrame([(1, 5.0)], "target_id long, period double")).first()
    assert amp["amplitude_ppm"] == pytest.approx(400, rel=0.1)


def test_top_peaks_greedy(spark):
    power = [0, 5, 1, 4, 0, 3, 0, 6, 0]
    spec = frame(spark, s=[1] * 9, k=np.arange(9), frequency=np.arange(9) * 1.0, power=np.array(power, float))
    got = spectra.top_peaks(spec, spark.createDataFrame([(1, 2.5)], "s long, spacing double"), ["s"]).orderBy("rank").toPandas()
    assert got["frequency"].tolist() == [7.0, 1.0]


def image(spark, source_x, source_y, s=pixels.PRF_SIGMA, amplitude=100.0):
    y, x = np.mgrid[0:11, 0:11]
    d = amplitude * np.exp(-((x - source_x) ** 2 + (y - source_y) ** 2) / (2 * s * s))
    return frame(spark, target_id=np.ones(121, "int64"), sector=np.ones(121, "int32"), x=x.ravel().astype("int32"), y=y.ravel().astype("int32"), difference=d.ravel())


def test_source_attribution_and_centroid(spark):
    sources = spark.createDataFrame([(1, 0, 5.0, 5.0, True), (1, 1, 8.0, 5.0, False)], "target_id long, source_index int, x_pix double, y_pix double, is_target boolean")
    amp = pixels.source_amplitudes(image(spark, 5, 5), sources).orderBy("source_index").toPandas()["amplitude"]
    assert amp[0] > 10 * max(amp[1], 1e-9)
    at = spark.createDataFrame([(1, 5.0, 5.0, 1.0)], "target_id long, target_x double, target_y double, cos_dec double")
    wide = image(spark, 5.3, 4.8, 1.2)
    row = pixels.difference_centroid(wide, at).first()
    assert row["ra_offset"] == pytest.approx(6.3, abs=2.5) and row["dec_offset"] == pytest.approx(-4.2, abs=2.5) and row["n_core"] >= 3


def test_contamination(spark):
    cone = spark.createDataFrame([(1, 0.0, 1.0, True, 10.0), (1, 5.0, 0.02, False, 14.0), (1, 9.0, None, False, 14.0)],
                                 "target_id long, separation_arcsec double, flux_ratio double, is_target boolean, g_mag double").withColumn("target_g_mag", F.lit(10.0))
    row = catalogs.contamination(cone).first()
    assert row["contamination"] == pytest.approx(0.02 + 10 ** -1.6) and row["n_neighbours"] == 2


def test_cone_search_wraps_and_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    ra, dec = (rng.uniform(-0.2, 0.2, 600)) % 360, rng.uniform(79.8, 80.2, 600)
    tra, tdec = (rng.uniform(-0.2, 0.2, 40)) % 360, rng.uniform(79.8, 80.2, 40)
    got = catalogs.cone_search(frame(spark, target_id=np.arange(40), t_ra=tra, t_dec=tdec), frame(spark, source_id=np.arange(600), ra=ra, dec=dec), 120.0)
    d_ra = (ra[None] - tra[:, None] + 180) % 360 - 180
    sep = np.hypot(d_ra * np.cos(np.radians(tdec))[:, None], dec[None] - tdec[:, None]) * 3600
    want = {(int(a), int(b)) for a, b in zip(*np.where(sep <= 120))}
    pairs = [(r["target_id"], r["source_id"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 50


def test_wilson_ends(spark):
    trials = frame(spark, target_id=[1] * 8, period=[1.0] * 4 + [2.0] * 4, duration_hours=[1.0] * 8, depth_ppm=[1.0] * 8, recovered=[True] * 4 + [False] * 4)
    got = controls.recovery_summary(trials).toPandas().set_index("period")
    assert got.loc[1.0, "upper"] == 1.0 and got.loc[2.0, "lower"] == 0.0 and got["trials"].max() == 8


def test_rv_compare_fits_activity_trend_and_a_jitter_per_instrument(spark):
    """An orbit of amplitude 7 with a trend of 0.12, activity of 2.5 a unit and two instruments, the second noisier than it says."""
    rng = np.random.default_rng(4)
    t = np.linspace(1170, 1230, 96)
    second = np.arange(96) % 2 == 1
    activity = np.sin(0.61 * t) + 0.31 * np.cos(0.17 * t)
    noise = np.where(second, rng.normal(0, 3.0, 96), rng.normal(0, 0.4, 96))
    v = np.where(second, -1.5, 2.0) + 0.12 * (t - 1200) + 2.5 * activity + 7 * np.cos(2 * np.pi * (t - 1200) / 5 + 0.8) + noise
    columns = dict(target_id=np.ones(96, "int64"), instrument=np.where(second, "b", "a"), t=t, velocity=v, sigma=np.full(96, 0.4))
    periods = spark.createDataFrame([(1, 5.0)], "target_id long, period double")
    row = models.rv_compare(frame(spark, **columns, activity=activity), periods).first()
    assert row["amplitude"] == pytest.approx(7, abs=0.4) and row["trend"] == pytest.approx(0.12, abs=0.03) and row["activity_coefficient"] == pytest.approx(2.5, abs=0.4)
    assert {j["instrument"]: j["jitter"] for j in row["jitters"]} == {"a": 0.0, "b": 3.0}
    # 2 offsets, 2 jitters, trend and activity; 4 more for the orbit
    assert row["bic_keplerian"] - row["aic_keplerian"] == pytest.approx(10 * (np.log(96) - 2)) and row["bic_constant"] - row["aic_constant"] == pytest.approx(6 * (np.log(96) - 2))
    plain = models.rv_compare(frame(spark, **columns), periods).first()
    partial = models.rv_compare(frame(spark, **columns, activity=np.where(np.arange(96) == 5, None, activity)).withColumn("activity", F.col("activity").cast("double")), periods).first()
    for other in (plain, partial):
        assert other["activity_coefficient"] is None and other["aic_keplerian"] > row["aic_keplerian"]
        assert other["bic_keplerian"] - other["aic_keplerian"] == pytest.approx(9 * (np.log(96) - 2))


def test_jitter_search_equals_the_product_of_all_jitters():
    import itertools

    rng = np.random.default_rng(8)
    jitters = np.array([0.0, 0.5, 1.0, 3.0, 9.0])
    for _ in range(40):
        blocks, norms = np.zeros((3, 5, 5, 5)), np.zeros((3, 5))
        for i in range(3):
            u = rng.normal(0, 1, (25, 4))
            y = u @ np.array([1.0, 3.0, -2.0, 0.5]) + rng.normal(0, rng.choice([0.3, 1.0, 4.0]), 25) + rng.normal()
            z = np.c_[u, y]
            for j, jitter in enumerate(jitters):
                var = np.full(25, 0.25) + jitter**2
                w = 1 / var
                centred = z - np.average(z, axis=0, weights=w)
                blocks[i, j], norms[i, j] = (centred * w[:, None]).T @ centred, np.log(2 * np.pi * var).sum()
        for use in (models.FLAT, models.ORBIT):
            want = min(models.solve_shared(blocks[range(3), list(c)].sum(0), use)[1] + norms[range(3), list(c)].sum() for c in itertools.product(range(5), repeat=3))
            got = models.jitter_search(blocks, norms, use)
            assert got[0] == pytest.approx(want, abs=1e-8)
        whole = blocks[:, 0].sum(0)
        np.testing.assert_allclose(models.solve_shared(whole, models.ORBIT)[0], np.linalg.solve(whole[:4, :4], whole[:4, 4]), rtol=1e-8)


def test_sed_posterior_recovers_a_star_and_its_distance(spark):
    """A solar twin at 100 pc with half a per cent of parallax error."""
    bands = spark.createDataFrame([(b,) for b in models.BANDS], "band string").withColumn("target_id", F.lit(1))
    scale = np.log10(models.SOLAR_RADIUS / models.PARSEC / 100)
    phot = bands.select("target_id", "band", (models.blackbody_magnitude(F.lit(5772.0), F.lit(0.02)) - float(scale) * 5.0).alias("mag"), F.lit(0.02).alias("err"))
    stars = spark.createDataFrame([(1, 5772.0, 10.0, 0.05, 1.0)], "target_id int, teff_prior double, parallax_mas double, parallax_mas_err double, mass_solar double")
    grid = models.sed_grid(phot, stars.select("target_id", "teff_prior", "parallax_mas"))
    got = {r["param"]: r for r in models.sed_posterior(grid, stars).collect()}
    assert got["radius_solar"]["median"] == pytest.approx(1, abs=0.1) and got["logg_cgs"]["median"] == pytest.approx(4.438, abs=0.1) and got["luminosity_solar"]["median"] == pytest.approx(1, abs=0.3)
    assert got["distance_pc"]["median"] == pytest.approx(100, abs=0.3) and got["distance_pc"]["p84"] - got["distance_pc"]["p16"] == pytest.approx(1.0, abs=0.3)
    wide = {r["param"]: r for r in models.sed_posterior(grid, stars.withColumn("parallax_mas_err", F.lit(2.0)).withColumn("mass_solar", F.lit(None).cast("double"))).collect()}
    assert "logg_cgs" not in wide or wide["logg_cgs"]["median"] is None
    assert wide["radius_solar"]["p84"] - wide["radius_solar"]["p16"] > 3 * (got["radius_solar"]["p84"] - got["radius_solar"]["p16"])
    assert models.sed_posterior(grid, stars.withColumn("parallax_mas_err", F.lit(0.0))).count() == 0


def test_active_set_equals_all_subsets():
    rng = np.random.default_rng(11)
    for n in (1, 2, 3, 5, 8):
        for turn in range(15):
            a = rng.normal(0, 1, (12, n))
            if turn % 5 == 4 and n > 1:
                a[:, -1] = a[:, 0]  # two sources at one place
            g, b = a.T @ a, a.T @ rng.normal(0, 1, 12)
            best = 0.0
            for mask in range(1, 1 << n):
                use = [i for i in range(n) if mask >> i & 1]
                x, *_ = np.linalg.lstsq(g[np.ix_(use, use)], b[use], rcond=None)
                if (x >= 0).all():
                    best = min(best, x @ g[np.ix_(use, use)] @ x - 2 * x @ b[use])
            x = pixels.nonnegative_solve(g, b)
            assert (x >= 0).all() and x @ g @ x - 2 * x @ b == pytest.approx(best, abs=1e-8)
    a = rng.normal(0, 1, (300, 20))
    truth = np.maximum(rng.normal(0, 1, 20), 0)
    np.testing.assert_allclose(pixels.nonnegative_solve(a.T @ a, a.T @ (a @ truth)), truth, atol=1e-8)
