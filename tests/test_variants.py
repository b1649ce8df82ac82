"""Variants made in the task that holds an observation, against the operators on rows of their own."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import controls as R
from fluxloom.operators import search as B
from fluxloom.operators import variants as V

CFG = R.SurveyConfig(durations_hours=(4.0, 6.0), period_min=2.5, period_max=3.0, n_periods=100, detrend_window_days=0.5, min_points=40)


@pytest.fixture(scope="module")
def survey(spark):
    """Two targets with dips, gaps, missing values and errors, a zero flux, equal instants and rows of no sector or target."""
    rng = np.random.default_rng(8)
    rows = []
    for target in (3, 4):
        t = np.sort(np.round(rng.uniform(0, 20, 500), 12 if target == 3 else 1))
        flux = 1 + rng.normal(0, 4e-3, 500) - 0.03 * (np.abs((t - 1) % 2.7) < 0.2)
        flux[10] = 0.0
        for k, (x, y) in enumerate(zip(t, flux)):
            rows.append((target, None if k % 83 == 5 else int(x // 10) + 1, float(x), None if k % 61 == 7 or 100 <= k < 104 else float(y), None if k % 97 == 3 else 4e-3 + 1e-3 * (k % 3)))
    rows += [(None, 1, float(x), 1.0, 5e-3) for x in range(60)] + [(5, 1, float(x), 1.0, 5e-3) for x in range(8)]
    return spark.createDataFrame(rows, "target_id long, sector int, t double, flux double, flux_err double").cache()


def same(got, want, keys):
    got, want = (x.sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(want) and list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-8)


def both_ways(monkeypatch, run):
    """``run`` with variants made in the tasks, and again with every target too long for a task."""
    whole = B.ROWS_PER_TASK
    with monkeypatch.context() as m:  # rows of the variants must not be needed
        m.setattr(R, "both_branches", lambda *a: pytest.fail("variants as rows"))
        here = run()
    with monkeypatch.context() as m:
        m.setattr(V, "ROWS_PER_TASK", 0)
        rows = run()
    assert B.ROWS_PER_TASK == whole
    return here, rows


def injections(survey):
    grid = R.SensitivityGrid(periods=(2.75,), durations_hours=(6.0,), depths_ppm=(10.0, 30000.0), phases=(0.125, 0.625))
    return R.injection_grid(survey, grid)


def test_recovery_of_variants_made_in_tasks_equals_rows_of_their_own(survey, monkeypatch):
    here, rows = both_ways(monkeypatch, lambda: R.injection_recovery(survey, injections(survey), CFG, 8.0).toPandas())
    assert here["recovered"].any() and not here["recovered"].all()
    same(here, rows, ["target_id", "depth_ppm", "phase_offset"])


def test_an_observation_is_shuffled_once_and_not_once_per_variant(survey, monkeypatch):
    sent = []
    keep = V.fan_out
    monkeypatch.setattr(V, "fan_out", lambda x, *a, **k: sent.append(x) or keep(x, *a, **k))
    R.injection_recovery(survey, injections(survey), CFG, 8.0)
    assert sent[0].count() == survey.where("target_id IS NOT NULL").count()


def test_parts_and_slices_of_trials_give_the_same_peaks(survey, monkeypatch):
    wanted = injections(survey)
    whole = R.injection_recovery(survey, wanted, CFG, 8.0).toPandas()
    sent = []
    keep = V.fan_out
    monkeypatch.setattr(V, "fan_out", lambda x, *a, **k: sent.append(x) or keep(x, *a, **k))
    monkeypatch.setattr(V, "PART_WORK", 50_000)
    same(R.injection_recovery(survey, wanted, CFG, 8.0).toPandas(), whole, ["target_id", "depth_ppm", "phase_offset"])
    assert sent[1].agg(F.max("slices")).first()[0] > 1


def test_controls_made_in_tasks_equal_rows_of_their_own(survey, monkeypatch):
    keys = ["target_id", "branch", "control"]
    columns = [*keys, "duration_hours", "n_trials", "period", "epoch", "depth_ppm", "depth_err_ppm", "snr", "n_events", "status"]
    # the order of several rows at an instant is open, for scrambles and running medians
    trials = lambda: R.robustness_trials(survey, CFG).where("target_id = 3 OR target_id = 4 AND branch = 'normalized' AND control NOT LIKE 'scramble%'")
    here, rows = both_ways(monkeypatch, lambda: trials().select(columns).toPandas())
    assert len(here) == 2 * 5 + 2 and here["snr"].nunique() > 8
    same(here, rows, keys)


def test_rows_of_no_target_are_reported_and_rows_of_no_time_left_out(spark, survey):
    row = R.robustness(survey.where("target_id IS NULL"), CFG).first()
    assert (row.target_id, row.plain_snr, row.plain_n_events, row.flat_n_events, row.max_control_snr, row.n_controls) == (None, None, 0, None, None, 0)
    few = survey.where("target_id = 3")
    timeless = few.unionByName(few.limit(20).withColumns({"t": F.lit(None).cast("double"), "sector": F.lit(None).cast("int")}))
    same(*(R.robustness(x, CFG).toPandas() for x in (timeless, few)), ["target_id"])
