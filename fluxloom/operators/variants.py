"""Variants of an observation (controls, injections), made and searched in the task that holds its rows.

A box search with ``shared`` writes every variant as rows of its own, which cost disk in proportion to the
variants, and again for each block of trials. Here only the observation's own rows are shuffled, once per
``PART_WORK`` steps of its searches; the task makes a few variants at a time and keeps one row per
(series, duration). Observations of more than ``ROWS_PER_TASK`` rows are left to the operators on DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fluxloom.operators import search, series
from fluxloom.operators.search import BOX, LEAST_TASKS, ROWS_PER_TASK, TASK_WORK, TRIALS_PER_TASK
from fluxloom.operators.spread import attach, fan_out
from fluxloom.session import cut

ROWS = ("sector", "t", "flux", "flux_err")
PART_WORK = 1_250_000_000  # rows or bin borders x trials x series for which an observation is copied once more
HELD = "n_trials int, " + BOX + ", n_events bigint"


class Observation:
    """Rows of one target by sector and time; rows without a sector stand last, and rows without a time are not searched."""

    def __init__(self, key, sector: np.ndarray, placed: np.ndarray, t: np.ndarray, flux: np.ndarray, known: np.ndarray, weight: np.ndarray):
        order = np.lexsort((flux, t, sector, ~placed))
        self.key, self.sector, self.placed, self.t, self.flux, self.known, self.weight = (
            key, sector[order], placed[order], t[order], flux[order], known[order], weight[order])
        n = int(placed.sum())
        starts = np.flatnonzero(np.r_[True, self.sector[1:n] != self.sector[:n - 1]]) if n else np.zeros(0, np.int64)
        self.groups = [(int(a), int(b)) for a, b in zip(starts, np.r_[starts[1:], n])]
        self.by_time = np.argsort(self.t, kind="stable")
        self.found_runs: list[tuple] = []

    @classmethod
    def read(cls, key, rows: pa.Table) -> Observation:
        held = rows.filter(rows.column("t").is_valid())
        number = lambda name, kind: held.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
        there = lambda name: held.column(name).is_valid().to_numpy()
        err = number("flux_err", float)
        usable = there("flux_err") & ((err > 0) | np.isnan(err))  # Spark holds NaN to be above all numbers
        with np.errstate(divide="ignore"):
            weight = np.where(usable, 1.0 / (err * err), -1.0)
        return cls(key, number("sector", np.int64), there("sector"), number("t", float), number("flux", float), there("flux"), weight)

    def repeated(self, times: int) -> Observation:
        return Observation(self.key, *(np.repeat(x, times) for x in (self.sector, self.placed, self.t, self.flux, self.known, self.weight)))

    def exposure(self) -> float | None:
        """Median positive spacing."""
        gaps = np.diff(self.t[self.by_time])
        return series.middle(gaps[gaps > 0])

    def flat(self, flux: np.ndarray, known: np.ndarray, window_days: float, gap_fraction: float) -> np.ndarray:
        """The flux with a running-median trend divided out; variants with the same known rows share their runs."""
        runs = next((r for k, r in self.found_runs if np.array_equal(k, known)), None)
        if runs is None:
            runs = series.held_runs(self.t, known, self.groups, window_days, gap_fraction)
            self.found_runs.append((known, runs))
        return flux / series.held_levels(flux, known, runs)


Series = tuple[tuple, Observation, np.ndarray, np.ndarray]  # labels, observation, flux, rows with a flux


def grid_of(t: np.ndarray, hours: float, period_min: float, period_max: float, n_periods: int) -> tuple[float, int]:
    """Step and number of trials as in ``period_grid``."""
    baseline = t.max() - t.min()
    natural, span = hours / 24.0 / (baseline * baseline), 1.0 / period_min - 1.0 / period_max
    step = natural * min(1.0, max(2.0, np.ceil(span / natural) + 1) / n_periods)
    return step, int(np.rint(span / step) + 1)


def strongest(found: list[Series], cfg, part: int, parts: int) -> Iterator[tuple]:
    """Strongest peak with two events of each series and duration in one of ``parts`` equal slices of the trials."""
    alike: list[tuple] = []  # usable rows in time order with the series that have them
    for labels, seen, flux, known in found:
        order = seen.by_time[(known & ~(seen.weight < 0))[seen.by_time]]
        if len(order) < cfg.min_points or not seen.t[order[-1]] > seen.t[order[0]]:
            continue
        same = next((x for x in alike if x[0] is seen and np.array_equal(x[1], order)), None)
        if same is None:
            alike.append(same := (seen, order, []))
        same[2].append((labels, flux[order]))
    for seen, order, members in alike:
        t, w = seen.t[order], seen.weight[order]
        fluxes, baseline = [flux for _, flux in members], t[-1] - t[0]
        sums = [(w * flux).sum() for flux in fluxes]
        for hours in cfg.durations_hours:
            step, n = grid_of(t, hours, cfg.period_min, cfg.period_max, cfg.n_periods)
            size = max(TRIALS_PER_TASK, TASK_WORK // int(min(len(t), np.ceil(search.borders(baseline, hours)))))
            best: list[tuple | None] = [None] * len(members)
            end = n * (part + 1) // parts
            for first in range(n * part // parts, end, size):
                g = SimpleNamespace(first=first, last=min(first + size, end) - 1, period_min=cfg.period_min, step=step, duration_hours=hours, t_start=t[0], w_all=w.sum())
                for i, peaks in enumerate(search.scan_together(t, fluxes, w, g, sums)):
                    peak = search.strongest_peak(peaks, t, hours)
                    if len(peak["trial"]):
                        x = tuple(peak[name][0].item() for name in ("trial", "period", "epoch", "depth", "depth_err", "power", "n_events"))
                        best[i] = x if best[i] is None else max(best[i], x, key=lambda y: (y[5], y[0]))
            for (labels, _), peak in zip(members, best):
                yield (seen.key, *labels, float(hours), n, *(peak or (None,) * 7))


def sizes(df: DataFrame) -> DataFrame:
    """Rows and time span of each target; read several times, so written once."""
    return cut(df.where(F.col("target_id").isNotNull() & F.col("t").isNotNull()).groupBy("target_id").agg(
        F.count(F.lit(1)).alias("n_points"), (F.max("t") - F.min("t")).alias("baseline")))


def box_search_variants(df: DataFrame, facts: DataFrame, wanted: DataFrame, label: str, make: Callable[[Observation, list[dict]], Iterator[Series]], branches: int, cfg) -> DataFrame:
    """As ``box_search`` over the series (target, ``label``, branch) that ``make`` gives for the rows of ``wanted``.

    ``facts`` are the ``sizes`` of the targets to search; ``wanted`` has one or more rows per variant of a target.
    """
    limits = facts.where((F.col("baseline") > 0) & (F.col("n_points") <= ROWS_PER_TASK)).withColumns({"period_min": F.lit(float(cfg.period_min)), "period_max": F.lit(float(cfg.period_max))})
    grid = search.period_grid(limits, cfg.durations_hours, cfg.n_periods)
    steps = F.least(F.col("n_points"), F.ceil(search.borders(F.col("baseline"), F.col("duration_hours")))) * F.col("n_trials")
    work = grid.groupBy("target_id").agg((F.sum(steps.cast("double")) * branches).alias("_work"))
    target = W.partitionBy("target_id")  # one row per variant
    dealt = wanted.join(work, "target_id").withColumns({
        "_v": F.dense_rank().over(target.orderBy(label)) - 1,
        "_per": F.greatest(F.lit(1.0), F.floor(F.lit(float(PART_WORK)) / F.col("_work"))).cast("long"),
        "slices": F.ceil(F.col("_work") / F.lit(float(PART_WORK))).cast("int")})
    dealt = dealt.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumn("part", (F.floor(F.col("_v") / F.col("_per")) * F.col("slices") + F.col("slice")).cast("int")).drop("_v", "_per", "_work")
    parts = dealt.groupBy("target_id").agg(F.max("part").alias("_last"))
    rows = attach(df.where(F.col("t").isNotNull()).select("target_id", *ROWS), parts, ["target_id"], spread=["t"])
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_last")))).select("target_id", "part", *ROWS)
    kinds = dict(wanted.dtypes)
    schema = f"target_id {kinds['target_id']}, `{label}` {kinds[label]}, branch string, duration_hours double, {HELD}"
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        orders: dict[object, list[dict]] = {}
        for order in right.to_pylist():
            orders.setdefault(order[label], []).append(order)
        first = next(iter(orders.values()))[0]
        seen = Observation.read(first["target_id"], left)
        out: list[tuple] = []
        held: list[Series] = []
        for order in orders.values():
            held += make(seen, order)
            if (len(held) + branches) * len(seen.t) > ROWS_PER_TASK:
                out += strongest(held, cfg, first["slice"], first["slices"])
                held = []
        out += strongest(held, cfg, first["slice"], first["slices"])
        return pa.Table.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*out), shape)], schema=shape) if out else shape.empty_table()

    task = ["target_id", "part"]
    dealt = dealt.toDF(*dealt.columns)  # columns of its own, since both sides stem from the same rows
    rows, dealt = (fan_out(x, *task, least=LEAST_TASKS).groupBy(*task) for x in (rows, dealt))
    peaks = rows.cogroup(dealt).applyInArrow(run, schema)
    group = ["target_id", label, "branch", "duration_hours"]
    power = F.when(F.col("power").isNotNull(), F.struct("power", "trial"))
    best = peaks.groupBy(*group).agg(F.max("n_trials").alias("n_trials"), F.max_by(F.struct("trial", "period", "epoch", "depth", "depth_err", "power", "n_events"), power).alias("b"))
    return search.graded(best, group)
