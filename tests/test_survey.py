"""Controls, injections and verdicts of a survey against SQL over a narrow search of a small table.

The registered queries search the default range, which SQL does not finish in minutes.
"""

import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import controls as R
from fluxloom.operators import search as B
from fluxloom.plans.ordered import OVER, detrend_sql
from fluxloom.plans.searches import BEST, box_sql_renamed, grid_sql
from fluxloom.sources import adapters as A
from tests.conftest import SF

CFG = R.SurveyConfig(durations_hours=(4.0, 6.0), period_min=2.5, period_max=3.0, n_periods=100, detrend_window_days=0.5)
LC16 = f"WITH {A.cadence_sql(A.SERIES16)}"


def limits(source, series):
    return grid_sql(source, series, CFG.durations_hours, "2.5e0", "3.0e0", 100)


SIG = f"""{limits('lc', 'target_id')}, {box_sql_renamed('lc', 'target_id')}, {BEST}"""
CAND = """cand AS (SELECT target_id, period, epoch + f * period AS epoch, duration_hours, depth_ppm, f AS phase_offset
  FROM best, (VALUES (0.25e0), (0.5e0), (0.75e0)) AS x(f) WHERE status = 'detected' AND n_events >= 2)"""


SCRAMBLES = " UNION ALL ".join(f"""SELECT o.target_id, o.sector, o.t, o.event_id, s.flux, o.flux_err, 'scramble-{seed}' AS control FROM rn0 o JOIN rn0 s
  ON s.target_id = o.target_id AND s.sector = o.sector
  AND s.rn = (o.rn - 1 - (1 + (o.target_id * 7919 + o.sector * 104729 + {seed} * 1299709) % greatest(o.n - 1, 1)) + o.n) % o.n + 1""" for seed in CFG.scramble_seeds)
CONTROLS = f"""rn0 AS (SELECT *, row_number() OVER (PARTITION BY target_id, sector ORDER BY t) AS rn, count(*) OVER (PARTITION BY target_id, sector) AS n FROM lc),
ctl AS MATERIALIZED (SELECT target_id, sector, t, event_id, flux, flux_err, 'signal' AS control FROM lc
  UNION ALL SELECT target_id, sector, t, event_id, 2 - flux, flux_err, 'inverted' FROM lc UNION ALL {SCRAMBLES}),
{detrend_sql('ctl', 'target_id, sector, control', 0.5)},
var AS MATERIALIZED (SELECT target_id, control, 'normalized' AS branch, t, flux, flux_err FROM ctl
  UNION ALL SELECT target_id, control, 'running-median', t, flux / lev, flux_err FROM det)"""
ROB = f"""{CONTROLS}, {limits('var', 'target_id, branch, control')}, {box_sql_renamed('var', 'target_id, branch, control')}"""
ROB += f""", {BEST.replace('PARTITION BY target_id', 'PARTITION BY target_id, branch, control')}"""
ROBUST = """rob AS (SELECT target_id, max(period) FILTER (WHERE branch = 'normalized' AND control = 'signal') AS plain_period,
  max(snr) FILTER (WHERE branch = 'normalized' AND control = 'signal') AS plain_snr,
  max(n_events) FILTER (WHERE branch = 'normalized' AND control = 'signal') AS plain_n_events,
  max(period) FILTER (WHERE branch = 'running-median' AND control = 'signal') AS flat_period,
  max(snr) FILTER (WHERE branch = 'running-median' AND control = 'signal') AS flat_snr,
  max(n_events) FILTER (WHERE branch = 'running-median' AND control = 'signal') AS flat_n_events,
  max(snr) FILTER (WHERE control <> 'signal') AS max_control_snr, count(snr) FILTER (WHERE control <> 'signal') AS n_controls
  FROM best GROUP BY 1)"""


def recovery_sql(prefix: str, injections: str) -> str:
    """CTE ``{prefix}rec`` from a table of injections; every inner CTE gets the prefix."""
    text = f"""x0 AS (SELECT target_id, median(gap) AS exposure FROM (SELECT target_id, t - lag(t) OVER (PARTITION BY target_id ORDER BY t) AS gap FROM lc) WHERE gap > 0 GROUP BY 1),
ij AS (SELECT *, row_number() OVER (ORDER BY target_id, period, epoch, duration_hours, depth_ppm) AS iid FROM {injections}),
ic AS (SELECT lc.*, iid, depth_ppm, exposure, duration_hours / 24 / 2 AS hw, epoch + round_even((t - epoch) / period, 0) * period AS c
  FROM lc JOIN ij USING (target_id) JOIN x0 USING (target_id)),
dm AS MATERIALIZED (SELECT target_id, iid, sector, t, event_id, flux * (1 - depth_ppm * 1e-6 * {OVER}) AS flux, flux_err FROM ic),
{detrend_sql('dm', 'target_id, sector, iid', 0.5)},
var AS MATERIALIZED (SELECT target_id, iid, 'normalized' AS branch, t, flux, flux_err FROM dm
  UNION ALL SELECT target_id, iid, 'running-median', t, flux / lev, flux_err FROM det),
{limits('var', 'target_id, iid, branch')}, {box_sql_renamed('var', 'target_id, iid, branch')}, {BEST.replace('PARTITION BY target_id', 'PARTITION BY target_id, iid, branch')},
m AS (SELECT ij.*, coalesce(abs(pk2.period / ij.period - 1) <= 0.01e0, false) AS pm,
  coalesce(abs({A.phase_sql('pk2.epoch', 'ij.period', 'ij.epoch')} * 24) <= ij.duration_hours, false) AS em,
  coalesce(snr >= 10 AND n_events >= 2, false) AS sp
  FROM ij, (VALUES ('normalized'), ('running-median')) AS b(branch) LEFT JOIN best pk2 ON pk2.target_id = ij.target_id AND pk2.iid = ij.iid AND pk2.branch = b.branch),
rec AS (SELECT target_id, period, epoch, duration_hours, depth_ppm, phase_offset, bool_and(pm) AS period_match, bool_and(em) AS epoch_match,
  bool_and(sp) AS snr_pass, bool_and(pm AND em AND sp) AS recovered FROM m GROUP BY ALL)"""
    for name in ("x0", "ij", "ic", "dm", "cd", "dg", "rr", "wd", "rk", "bd", "fl", "dt", "det", "var", "facts", "lim", "gr", "gs", "grid",
                 "tr", "tb", "ex", "bn", "wn", "dp", "pk", "pgram", "evn", "bb", "peaks", "best", "m", "rec"):
        text = re.sub(rf"\b{name}\b(?=( AS (MATERIALIZED )?\()|\.|$|[ ,)\n])", prefix + name, text)
    return text


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.fixture(scope="module")
def cadences(spark):
    return A.cadence(spark, SF, A.SERIES16)


@pytest.fixture(scope="module")
def detections(cadences):
    found = B.box_search(cadences, ["target_id"], CFG.durations_hours, CFG.period_min, CFG.period_max, CFG.n_periods)
    return B.select_duration(found, ["target_id"])


def compare(df, con, sql, keys):
    want = con.execute(sql).fetchdf()
    got = df.toPandas()[list(want.columns)]
    got, want = (x.sort_values(keys).reset_index(drop=True).astype(object) for x in (got, want))
    assert len(want) and len(got) == len(want)
    for name in want.columns:
        for a, b in zip(got[name], want[name]):
            missing = a is None or a != a
            assert missing == (b is None or b != b), name
            assert missing or a == pytest.approx(b, rel=1e-7), name
    return want


def test_candidate_injections_equal_sql(detections, duck):
    compare(R.candidate_injections(detections), duck, f"{LC16}, {SIG}, {CAND} SELECT * FROM cand", ["target_id", "phase_offset"])


def test_robustness_equals_sql(cadences, duck):
    compare(R.robustness(cadences, CFG), duck, f"{LC16}, {ROB}, {ROBUST} SELECT * FROM rob", ["target_id"])


def test_injection_recovery_and_verdict_equal_sql(cadences, detections, duck):
    rows = R.injection_recovery(cadences, R.candidate_injections(detections), CFG, 10.0)
    cells = ["target_id", "phase_offset"]
    want = compare(rows, duck, f"{LC16}, {SIG}, {CAND}, {recovery_sql('q_', 'cand')} SELECT target_id, phase_offset, period, epoch, duration_hours, "
                   "period_match, epoch_match, snr_pass, recovered FROM q_rec", cells)
    assert want["target_id"].nunique() > 1
    quiet = {r.target_id: r for r in R.robustness(cadences, CFG).collect()}
    found = {r.target_id: r for r in detections.collect()}
    for review in (2.0, 8.0):
        for row in R.robustness_verdict(detections, R.robustness(cadences, CFG), rows, review, CFG).collect():
            ref, ctl = found[row.target_id], quiet[row.target_id]
            mine = want[want["target_id"] == row.target_id]
            k = int(mine["recovered"].sum())
            both = [(ctl.plain_period, ctl.plain_snr, ctl.plain_n_events), (ctl.flat_period, ctl.flat_snr, ctl.flat_n_events)]
            strong = ref.snr is not None and ref.snr >= review and all(snr is not None and snr >= review for _, snr, _ in both)
            seen = ref.n_events >= 2 and all((n or 0) >= 2 for _, _, n in both)
            agrees = ref.period is not None and all(p is not None and abs(p / ref.period - 1) <= 0.01 for p, _, _ in both)
            silent = ctl.max_control_snr is not None and ctl.max_control_snr < review
            enough = len(mine) == 3 and k >= 2
            assert (row.trials, row.recovered) == (len(mine), k)
            assert (row.strong, row.seen, row.agrees, row.quiet, row.recovered_enough) == (strong, seen, agrees, silent, enough)
            assert row.passed == (strong and seen and agrees and silent and enough)


def test_sensitivity_counts_every_cell(cadences):
    """A deep signal is found at both phases, a faint one is not; the overall row adds the cells up."""
    grid = R.SensitivityGrid(periods=(2.75,), durations_hours=(6.0,), depths_ppm=(10.0, 300000.0), phases=(0.125, 0.625))
    rows = R.sensitivity(cadences.where("target_id < 3"), grid, CFG, 8.0).collect()
    for target in {r.target_id for r in rows}:
        cells = {r.depth_ppm: r for r in rows if r.target_id == target}
        assert set(cells) == {10.0, 300000.0, None}
        assert cells[None].trials == 4 and cells[None].recovered == cells[10.0].recovered + cells[300000.0].recovered
        assert cells[300000.0].recovered >= cells[10.0].recovered
        assert all(0 <= r.lower <= r.fraction <= r.upper <= 1 for r in cells.values())


def test_variants_of_an_observation_are_searched_together(cadences, monkeypatch):
    """Series with equal times and weights share a scan, those of other weights or times keep their own; none differs from a search alone."""
    few = cadences.where("target_id < 2").withColumn("variant", F.lit("a"))
    for name, flux, err, kept in (("b", "2 - flux", "flux_err", "true"), ("c", "flux", "flux_err * (1 + 0.1 * (event_id % 3))", "true"), ("d", "flux", "flux_err", "event_id % 9 > 0")):
        few = few.unionByName(cadences.where(f"target_id < 2 AND {kept}").withColumns({"flux": F.expr(flux), "flux_err": F.expr(err), "variant": F.lit(name)}))
    keys = ["target_id", "variant"]

    def found(shared):
        out = B.box_search(few, keys, CFG.durations_hours, CFG.period_min, CFG.period_max, CFG.n_periods, min_points=20, shared=shared)
        return {(r.target_id, r.variant, r.duration_hours): r for r in out.collect()}

    alone = found(None)
    assert len(alone) == 16
    for held in (B.ROWS_PER_TASK, 150):  # one bundle, several
        monkeypatch.setattr(B, "ROWS_PER_TASK", held)
        together = found(["target_id"])
        assert together.keys() == alone.keys()
        for key, row in alone.items():
            assert (together[key].status, together[key].n_events, together[key].n_trials) == (row.status, row.n_events, row.n_trials)
            assert (together[key].snr, together[key].period) == pytest.approx((row.snr, row.period), rel=1e-9), key


def test_a_scan_of_variants_bins_their_rows_once(monkeypatch):
    rng = np.random.default_rng(3)
    for n in (80, 3000):  # rows one by one, running sums at the borders
        t = np.sort(rng.uniform(0, 12, n))
        w, fluxes = 1 / rng.choice([4e-3, 5e-3], n) ** 2, [1 + rng.normal(0, 0.01, n) for _ in range(4)]
        g = SimpleNamespace(first=0, last=200, period_min=0.5, step=0.005, duration_hours=4.0, t_start=t[0], w_all=w.sum())
        sums = [(w * flux).sum() for flux in fluxes]
        alone = [B.scan(t, flux, w, SimpleNamespace(**vars(g), wy_all=wy)) for flux, wy in zip(fluxes, sums)]
        floors, plain = [], np.floor
        binned, columns = [], B.Running.ahead
        monkeypatch.setattr(B.Running, "ahead", lambda self, *a: binned.append(1) or columns(self, *a))
        monkeypatch.setattr(np, "floor", lambda x, *a, **k: floors.append(1) or plain(x, *a, **k))
        B.scan_together(t, fluxes[:1], w, g, sums[:1])
        once = len(floors), len(binned)
        together = B.scan_together(t, fluxes, w, g, sums)
        monkeypatch.undo()
        assert once != (0, 0) and (len(floors), len(binned)) == (2 * once[0], 2 * once[1])
        for one, both in zip(alone, together):
            for name in one:
                assert (one[name] == both[name]).all()
