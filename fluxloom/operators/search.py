"""Box periodogram over exploded period grids and peak selection (IDs H1-H4, F1, F2, B12).

The period grid is cut into blocks of about ``TASK_WORK`` steps. ``K`` bins span one
duration, so a window is K consecutive bins, wrapping at the end of the period.

* A series of up to ``ROWS_PER_TASK`` rows is copied once per ``BLOCKS_PER_COPY`` blocks of all durations (once per
  block if every trial is wanted). Its task sums the phase bins of a few trials at a time (``scan``), slides the window over them and
  returns finished trials, or only the block's strongest peak with two observed
  events, counted on the rows at hand. Rows x trials never become rows, and nothing
  is shuffled behind the copies but one row per block. A trial costs as many steps as
  the series has rows, or bin borders over its whole time span if those are fewer:
  the weights between two borders are a difference of running sums. Variants of one
  observation with the same times and weights (``shared``) find their bins once.
* A longer series is split into parts: each part is expanded by a generator and
  collapsed at once to phase-bin sums, which a shuffle by trial adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.functions.fold import phase_hours
from fluxloom.operators.spread import attach, fan_out

K = 5
TRIALS_PER_TASK = 256  # least number of trial periods of one task
TASK_WORK = 64_000_000  # rows or bin borders x trials of one task
BLOCKS_PER_COPY = 4  # blocks of each duration that one copy of a series serves when only peaks are wanted
LEAST_TASKS = 96  # Spark tasks of a search, so that few long ones do not meet in one
SCAN_CELLS = 1 << 17  # rows or bin borders x trials worked on at once, so that they stay in cache
ROWS_PER_TASK = 4_000_000  # a longer series is split over several tasks per trial block
LOOKUP_CELLS = 1 << 23  # most entries of the table of times
FEWEST_BITS = 36  # a series with a weight below 2 ** -36 of their sum keeps to plain sums
MIN_SNR = 7.1
SCORE_DIGITS = 9


def series_facts(df: DataFrame, series: Sequence[str], min_points: int = 50) -> DataFrame:
    """Time span and total weights of each series long enough to search."""
    w = 1.0 / (F.col("flux_err") * F.col("flux_err"))
    good = df.where(F.col("t").isNotNull() & F.col("flux").isNotNull() & (F.col("flux_err") > 0))
    return good.groupBy(*series).agg(
        F.min("t").alias("t_start"), (F.max("t") - F.min("t")).alias("baseline"), F.count(F.lit(1)).alias("n_points"),
        F.sum(w).alias("w_all"), F.sum(w * F.col("flux")).alias("wy_all"),
    ).where((F.col("n_points") >= min_points) & (F.col("baseline") > 0))


def frequency_step(duration_hours: Column, n_periods: int, period_min: Column, period_max: Column) -> Column:
    """Step no coarser than duration / baseline^2, finer where more trials are asked for."""
    natural = duration_hours / 24.0 / (F.col("baseline") * F.col("baseline"))
    span = 1.0 / period_min - 1.0 / period_max
    trials = F.greatest(F.lit(2.0), F.ceil(span / natural) + 1)
    return natural * F.least(F.lit(1.0), trials / float(n_periods))


def period_grid(facts: DataFrame, durations_hours: Sequence[float], n_periods: int) -> DataFrame:
    """Grid parameters per (series, duration): trial i has frequency 1/period_min - i * step."""
    x = facts.withColumn("duration_hours", F.explode(F.array(*[F.lit(float(d)) for d in durations_hours])))
    x = x.withColumn("step", frequency_step(F.col("duration_hours"), n_periods, F.col("period_min"), F.col("period_max")))
    span = 1.0 / F.col("period_min") - 1.0 / F.col("period_max")
    return x.withColumn("n_trials", (F.rint(span / F.col("step")) + 1).cast("int"))


def trial_period(i: Column) -> Column:
    return 1.0 / (1.0 / F.col("period_min") - F.col("step") * i)


def box_bins(df: DataFrame, grid: DataFrame, series: Sequence[str]) -> DataFrame:
    """Weight sums per (series, duration, trial, phase bin); the parts of a long series add up later."""
    good = df.where(F.col("flux").isNotNull() & (F.col("flux_err") > 0)).select(
        *series, "t", "flux", (1.0 / (F.col("flux_err") * F.col("flux_err"))).alias("w"))
    packed = grid.groupBy(*series).agg(
        F.max("t_start").alias("t_start"), F.max("period_min").alias("period_min"), F.max("n_points").alias("n_points"),
        F.collect_list(F.struct("duration_hours", "step", "n_trials")).alias("_g"))  # one entry per duration
    x = attach(good, packed, series, spread=["t"]).withColumn("_g", F.explode("_g"))
    blocks = F.sequence(F.lit(0), F.floor((F.col("_g.n_trials") - 1) / TRIALS_PER_TASK).cast("int"))
    part = F.pmod(F.xxhash64("t"), F.ceil(F.col("n_points") / ROWS_PER_TASK)).cast("int")
    x = x.select(*series, "t", "flux", "w", "t_start", "period_min", "_g.*", part.alias("part"), F.explode(blocks).alias("block"))
    task = [*series, "duration_hours", "block", "part"]
    x = fan_out(x, *task)
    first = F.col("block") * TRIALS_PER_TASK
    x = x.withColumn("trial", F.explode(F.sequence(first, F.least(first + TRIALS_PER_TASK, F.col("n_trials")) - 1))).withColumn("period", trial_period(F.col("trial")))
    turns = (F.col("t") - F.col("t_start")) / F.col("period")
    x = x.withColumn("bins", F.rint(F.col("period") / (F.col("duration_hours") / 24.0 / K)).cast("int")).withColumn("cycle", F.floor(turns))
    x = x.withColumn("bin", F.least(F.floor((turns - F.col("cycle")) * F.col("bins")).cast("int"), F.col("bins") - 1))
    # grouped by the task columns as well, so no shuffle separates expansion and collapse
    return x.groupBy(*task, "trial", "bin").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("flux")).alias("wy"),
        F.min("cycle").alias("c_min"), F.max("cycle").alias("c_max"), F.max("bins").alias("bins"))


def window_sums(since: np.ndarray, values: Sequence[np.ndarray], period: np.ndarray, bins: np.ndarray):
    """Slices of trials with the sums, one table per column of values, of the windows that start at each bin, from the rows."""
    low, fit = 0, lambda last: max(1, SCAN_CELLS // max(len(since), int(bins[min(last, len(bins) - 1)])))
    while low < len(period):
        here = slice(low, min(low + fit(low + fit(low) - 1), len(period)))  # bins rise with the trials
        n = bins[here, None]
        rows, width = np.arange(len(n))[:, None], int(n.max())
        room, behind = width + K - 1, np.arange(K - 1)
        turns = since / period[here, None]
        turns -= np.floor(turns)
        turns *= n
        cell = (np.minimum(turns.astype(np.int64), n - 1) + rows * room).ravel()
        sums = (np.bincount(cell, np.tile(x, len(n)), len(n) * room).reshape(len(n), room) for x in values)
        tables = []
        for x in sums:  # the bins behind the last one are the first ones again
            x[rows, n + behind] = x[rows, behind % n]
            tables.append(sum(x[:, j:j + width] for j in range(K)))
        yield here, tables
        low = here.stop


def whole_numbers(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The values as multiples of a power of two so small that all of them together just fit 62 bits."""
    scale = 2.0 ** (61 - np.frexp(np.abs(x).sum())[1])
    return np.rint(x * scale).astype(np.int64), scale


class Running:
    """Running sums of a series in time order, as whole numbers, whose differences are exact."""

    def __init__(self, since: np.ndarray, values: Sequence[np.ndarray]):
        at = np.flatnonzero(np.r_[True, since[1:] != since[:-1]])  # first rows of equal times
        self.since, self.slack = since[at], 1e-12 * since[-1]
        size = int(np.clip(8 * len(at), 1 << 16, LOOKUP_CELLS))  # cells of an even time grid, the last one behind all rows
        self.per_cell = (size - 2) / since[-1]
        self.taken = np.zeros(size, bool)  # whether a row lies in the cell or next to it
        for shift in (-self.slack, 0.0, self.slack):
            self.taken[(np.maximum(self.since + shift, 0.0) * self.per_cell).astype(np.int64)] = True
        self.first = np.r_[0, np.cumsum(np.bincount((self.since * self.per_cell).astype(np.int64), minlength=size))[:-1]]
        self.columns = []
        for x in values:
            number, scale = whole_numbers(x)
            self.columns.append((np.r_[0, np.cumsum(number)][np.r_[at, len(x)]], scale))

    def ahead(self, time: np.ndarray, near: np.ndarray, period: np.ndarray, bins: int) -> np.ndarray:
        """Rows ahead of the borders ``near`` in the table ``time`` of borders x periods; a row's own bin decides."""
        exact = time.ravel()[near]
        found, last = np.searchsorted(self.since, exact), len(self.since) - 1
        gap = np.minimum(np.abs(self.since[np.minimum(found, last)] - exact), np.abs(self.since[np.maximum(found - 1, 0)] - exact))
        close = np.flatnonzero(gap <= self.slack)
        if len(close):
            wanted, trial = np.divmod(near[close], len(period))
            here = found[close]

            def bin_of(row: np.ndarray) -> np.ndarray:
                turns = self.since[np.clip(row, 0, last)] / period[trial]
                cycle = np.floor(turns)
                return cycle.astype(np.int64) * bins + np.minimum(((turns - cycle) * bins).astype(np.int64), bins - 1)

            while (back := (here > 0) & (bin_of(here - 1) >= wanted)).any():
                here = here - back
            while (on := (here <= last) & (bin_of(here) < wanted)).any():
                here = here + on
            found[close] = here
        return found

    def window_sums(self, period: np.ndarray, bins: np.ndarray):
        """As the function of that name, for as many steps as there are borders."""
        ends = np.flatnonzero(np.diff(bins, append=-1)) + 1  # trials with equal numbers of bins stand together
        first = 0
        for end in ends:
            n = int(bins[first])
            around, behind = np.divmod(np.arange(n + K), n)
            low = first
            while low < end:
                cycles = int(self.since[-1] / period[low]) + 1  # periods rise
                here = slice(low, min(end, low + max(1, SCAN_CELLS // (cycles * n))))
                time = np.multiply.outer(np.arange(cycles * n) / n, period[here])  # neighbours are close in time
                cell = (time * self.per_cell).astype(np.int64)
                near = np.flatnonzero(np.take(self.taken, cell, mode="clip"))
                ahead = np.take(self.first, cell, mode="clip")
                ahead.ravel()[near] = self.ahead(time, near, period[here], n)
                tables = []
                for column, scale in self.columns:
                    # sums of all ahead of a border; wrapped additions do not hurt their differences
                    total = np.take(column, ahead, mode="clip").reshape(cycles, n, -1).sum(axis=0)
                    total = total[behind] + around[:, None] * column[-1]
                    tables.append(((total[K:] - total[:-K]) * (1.0 / scale)).T)
                yield here, tables
                low = here.stop
            first = end


def best_starts(fits: np.ndarray, win: np.ndarray, out: np.ndarray, weight: np.ndarray, win_y: np.ndarray, w_all: float, wy_all: float):
    """Start, depth and score of the best window of each trial, the earliest of equal scores; a score of -1 without a dip.

    A cheap score, ``weight`` times a square, leaves the few windows of a trial whose score is then taken from its formula.
    """
    rough = win * (wy_all / w_all)
    rough -= win_y
    np.maximum(rough, 0.0, out=rough)
    rough *= rough
    rough *= weight
    least = rough.max(axis=1) * (1.0 - 1e-6) - 2.0 * 10.0 ** -SCORE_DIGITS
    likely = rough >= least[:, None]
    trial, start = np.nonzero(likely) if likely.flags.c_contiguous else np.nonzero(likely.T)[::-1]
    near, far, y = win[trial, start], out[trial, start], win_y[trial, start]
    depth = (wy_all - y) / far - y / near
    score = np.round(near * depth * depth * 0.5, SCORE_DIGITS)
    score[~(fits[trial, start] & (depth > 0))] = -1.0
    order = np.lexsort((start, -score, trial))
    trial = trial[order]
    best = order[np.flatnonzero(np.diff(trial, prepend=-1))]  # the first of each trial
    return start[best], depth[best], score[best]


def scan(t: np.ndarray, flux: np.ndarray, w: np.ndarray, g) -> dict[str, np.ndarray]:
    """Best box of each trial ``g.first .. g.last`` over rows in time order, positive depths only."""
    return scan_together(t, [flux], w, g, [g.wy_all])[0]


def scan_together(t: np.ndarray, fluxes: Sequence[np.ndarray], w: np.ndarray, g, wy_alls: Sequence[float]) -> list[dict[str, np.ndarray]]:
    """As ``scan`` for series with the same times and weights, whose rows are put into bins once."""
    trials = np.arange(g.first, g.last + 1)
    period = 1.0 / (1.0 / g.period_min - g.step * trials)
    bins = np.rint(period / (g.duration_hours / 24.0 / K)).astype(np.int64)
    found = [[np.full(len(trials), -1.0) for _ in range(4)] for _ in fluxes]
    since = t - g.t_start
    if borders(since[-1], g.duration_hours) < len(since) and w.min() > g.w_all * 2.0 ** -FEWEST_BITS:
        values = [w * (flux - wy_all / g.w_all) for flux, wy_all in zip(fluxes, wy_alls)]
        wy_alls = [wy.sum() for wy in values]
        windows = Running(since, [w, *values]).window_sums(period, bins)
    else:
        windows = window_sums(since, [w, *(w * flux for flux in fluxes)], period, bins)
    for here, (win, *win_ys) in windows:
        out = g.w_all - win
        fits = (np.arange(win.shape[1]) < bins[here, None]) & (win > 0) & (out > g.w_all * 1e-12)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            weight = np.where(fits, (g.w_all / out) ** 2 * 0.5 / win, 0.0)
        for (start, depth, depth_err, power), win_y, wy_all in zip(found, win_ys, wy_alls):
            with np.errstate(divide="ignore", invalid="ignore"):
                at, depth[here], power[here] = best_starts(fits, win, out, weight, win_y, g.w_all, wy_all)
                pick = (np.arange(len(at)), at)
                start[here], depth_err[here] = at, np.sqrt(1.0 / win[pick] + 1.0 / out[pick])
    every = []
    for start, depth, depth_err, power in found:
        epoch = g.t_start + (start + K / 2.0) * (period / bins)
        columns = {"trial": trials, "period": period, "epoch": epoch, "depth": depth, "depth_err": depth_err, "power": power}
        every.append({name: x[power >= 0] for name, x in columns.items()})
    return every


def borders(baseline, hours):
    """Bin borders of one trial over the whole time span, about; for numbers and columns."""
    return baseline / (hours / 24.0 / K)


def count_events(t: np.ndarray, period: float, epoch: float, hours: float) -> int:
    """Distinct observed events: cadences (in time order) within half a duration, inclusive."""
    cycle = np.arange(np.floor((t[0] - epoch) / period) - 1, np.ceil((t[-1] - epoch) / period) + 2)
    reach = hours / 48.0 + 1e-9 * period + 8 * np.spacing(np.abs(t[[0, -1]]).max() + abs(epoch))
    low, high = (np.searchsorted(t, epoch + cycle * period + side * reach) for side in (-1, 1))
    high = np.maximum(high, low)
    low[1:] = np.maximum(low[1:], high[:-1])  # windows that meet
    high = np.maximum(high, low)
    t = np.concatenate([t[a:b] for a, b in zip(low, high)])  # only rows around an event; the formula decides
    x = t - epoch + period / 2
    phase = x - period * np.floor(x / period) - period / 2
    near = t[np.abs(phase * 24.0) <= hours / 2]
    return len(np.unique(np.rint((near - epoch) / period)))


def strongest_peak(found: dict[str, np.ndarray], t: np.ndarray, hours: float) -> dict[str, np.ndarray]:
    """First trial by falling power, then falling number, with at least two events."""
    for i in np.lexsort((found["trial"], found["power"]))[::-1]:
        events = count_events(t, found["period"][i], found["epoch"][i], hours)
        if events >= 2:
            return {**{name: x[[i]] for name, x in found.items()}, "n_events": np.array([events])}
    return {**{name: x[:0] for name, x in found.items()}, "n_events": np.array([], np.int64)}


BOX = "trial int, period double, epoch double, depth double, depth_err double, power double"


def bundles(grid: DataFrame, series: Sequence[str], shared: Sequence[str]) -> DataFrame:
    """Number the series of a ``shared`` key (``member``) and cut them into bundles that one task can hold."""
    if list(shared) == list(series):
        return grid.withColumns({"bundle": F.lit(0), "member": F.lit(0)})
    along = W.partitionBy(*shared)  # one row per series and duration
    member = F.dense_rank().over(along.orderBy(*[c for c in series if c not in shared])) - 1
    numbered = grid.withColumns({"member": member, "_most": F.greatest(F.lit(1), F.floor(F.lit(ROWS_PER_TASK) / F.max("n_points").over(along)))})
    return numbered.withColumn("bundle", F.floor(F.col("member") / F.col("_most")).cast("int")).drop("_most")


def scan_blocks(df: DataFrame, grid: DataFrame, series: Sequence[str], peaks: bool, shared: Sequence[str] | None = None) -> DataFrame:
    """Trials of the series that one task can hold, or with ``peaks`` each block's strongest valid one.

    Series with equal values of ``shared`` columns meet in a task, which bins those with the same times and weights together.
    """
    series, shared = list(series), list(shared or series)
    task = [*shared, "bundle", "part"]
    steps = F.least(F.col("n_points"), F.ceil(borders(F.col("baseline"), F.col("duration_hours"))))
    size = F.greatest(F.lit(TRIALS_PER_TASK), F.floor(F.lit(TASK_WORK) / steps)).cast("int")
    sized = bundles(grid, series, shared).withColumn("size", size)
    last = F.floor((F.col("n_trials") - 1) / F.col("size")).cast("int")
    part = lambda block: F.floor(block / (BLOCKS_PER_COPY if peaks else 1)).cast("int")
    first = F.col("block") * F.col("size")
    others = [c for c in series if c not in shared]
    tasks = sized.withColumn("block", F.explode(F.sequence(F.lit(0), last))).withColumn("part", part(F.col("block"))).select(
        *task, "duration_hours", "member", *others, "t_start", "period_min", "step", "w_all", "wy_all", first.alias("first"),
        (F.least(first + F.col("size"), F.col("n_trials")) - 1).alias("last"))
    good = df.where(F.col("t").isNotNull() & F.col("flux").isNotNull() & (F.col("flux_err") > 0)).select(
        *series, "t", "flux", (1.0 / (F.col("flux_err") * F.col("flux_err"))).alias("w"))
    packed = sized.groupBy(*series, "bundle", "member").agg(F.max(part(last)).alias("_last"))
    copies = attach(good, packed, series, spread=["t"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_last")))).select(*task, "member", "t", "flux", "w")

    def run(rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(block):
            return pd.DataFrame(columns=names)
        member, t, flux, w = (rows[c].to_numpy(kind) for c, kind in (("member", int), ("t", float), ("flux", float), ("w", float)))
        order = np.lexsort((w, t, member))
        member, t, flux, w = member[order], t[order], flux[order], w[order]
        alike: list[tuple] = []  # limits, times and weights with the series that have them
        for g in block.itertuples(index=False):
            own = slice(*np.searchsorted(member, [g.member, g.member + 1]))
            limits = (g.duration_hours, g.first, g.last, g.period_min, g.step, g.t_start)
            same = next((x for x in alike if x[0] == limits and np.array_equal(x[1], t[own]) and np.array_equal(x[2], w[own])), None)
            if same is None:
                alike.append(same := (limits, t[own], w[own], []))
            same[3].append((g, flux[own]))
        out = []
        for _, times, weights, members in alike:
            results = scan_together(times, [x for _, x in members], weights, members[0][0], [g.wy_all for g, _ in members])
            for (g, _), found in zip(members, results):
                part = pd.DataFrame(strongest_peak(found, times, g.duration_hours) if peaks else found)
                for name in (*series, "duration_hours"):
                    part[name] = getattr(g, name)
                out.append(part[names])
        return pd.concat(out, ignore_index=True)

    kinds = dict(grid.select(*series, "duration_hours").dtypes)
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in kinds.items()), BOX, *(["n_events bigint"] if peaks else [])])
    names = [*kinds, *(part.split()[0] for part in BOX.split(", ")), *(["n_events"] if peaks else [])]
    tasks = tasks.toDF(*tasks.columns)  # columns of its own, since both sides stem from the same rows
    copies, tasks = (fan_out(x, *task, least=LEAST_TASKS).groupBy(*task) for x in (copies, tasks))
    return copies.cogroup(tasks).applyInPandas(run, schema)


def box_periodogram(df: DataFrame, grid: DataFrame, series: Sequence[str]) -> DataFrame:
    """Best box per (series, duration, trial period) by likelihood, positive depths only."""
    held, split = F.col("n_points") <= ROWS_PER_TASK, F.col("n_points") > ROWS_PER_TASK
    short = scan_blocks(df, grid.where(held), series, False)
    return short.unionByName(split_periodogram(df, grid.where(split), series).select(short.columns))


def split_periodogram(df: DataFrame, grid: DataFrame, series: Sequence[str]) -> DataFrame:
    """Best box per trial of series in several parts.

    ``two_events`` is a certificate: the inner bins of the window alone already
    hold cadences of two different events.
    """
    series = list(series)
    trial = [*series, "duration_hours", "trial"]
    bins = fan_out(box_bins(df, grid, series), *trial)
    spread = bins.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(K - 1))))
    offset = F.col("bin") - F.col("j")
    inner = F.col("j").between(1, K - 2)
    late = F.when(offset < 0, 1).otherwise(0)
    windows = spread.withColumn("start", F.pmod(offset, F.col("bins"))).groupBy(*trial, "start").agg(
        F.sum("w").alias("w"), F.sum("wy").alias("wy"), F.max("bins").alias("bins"),
        F.min(F.when(inner, F.col("c_min") - late)).alias("first"), F.max(F.when(inner, F.col("c_max") - late)).alias("last"))
    x = windows.join(grid, [*series, "duration_hours"])
    w_out = F.col("w_all") - F.col("w")
    x = x.where(w_out > F.col("w_all") * 1e-12)
    x = x.withColumn("depth", (F.col("wy_all") - F.col("wy")) / w_out - F.col("wy") / F.col("w"))
    x = x.withColumn("depth_err", F.sqrt(1.0 / F.col("w") + 1.0 / w_out)).where(F.col("depth") > 0)
    x = x.withColumn("power", F.round(F.col("w") * F.col("depth") * F.col("depth") * 0.5, SCORE_DIGITS))
    best = x.groupBy(*trial).agg(F.max_by(
        F.struct("start", "depth", "depth_err", "power", "bins", "t_start", "period_min", "step", "n_trials",
                 F.coalesce(F.col("last") > F.col("first"), F.lit(False)).alias("two_events")),
        F.struct("power", -F.col("start"))).alias("b")).select(*trial, "b.*")
    period = trial_period(F.col("trial"))
    epoch = F.col("t_start") + (F.col("start") + K / 2.0) * (period / F.col("bins"))
    return best.select(*trial, period.alias("period"), epoch.alias("epoch"), "depth", "depth_err", "power", "two_events", "n_trials")


def events_in_box(df: DataFrame, boxes: DataFrame, series: Sequence[str]) -> DataFrame:
    """Boxes with their distinct observed events: cadences within half a duration, inclusive."""
    rows = attach(df.where(F.col("flux").isNotNull()).select(*series, "t"), boxes, series, spread=["t"])
    near = rows.where(F.abs(phase_hours("t", "period", "epoch")) <= F.col("duration_hours") / 2)
    cycle = F.rint((F.col("t") - F.col("epoch")) / F.col("period"))
    return near.groupBy(*boxes.columns).agg(F.countDistinct(cycle).alias("n_events"))


def split_peaks(df: DataFrame, grid: DataFrame, series: Sequence[str]) -> DataFrame:
    """First peak, by falling power, with at least two observed events, of series in several parts.

    Only trials at least as strong as the strongest certified one can win, so the
    exact event count runs on those few; no trial is ever dropped by a cap.
    """
    group = [*series, "duration_hours"]
    periodogram = split_periodogram(df, grid, series)
    sure = periodogram.groupBy(*group).agg(F.max(F.when(F.col("two_events"), F.col("power"))).alias("_sure"))
    rivals = attach(periodogram, sure, group, spread=["trial"]).where(F.col("_sure").isNull() | (F.col("power") >= F.col("_sure")))
    return events_in_box(df, rivals.drop("_sure", "two_events", "n_trials"), series).where(F.col("n_events") >= 2)


def select_peak(df: DataFrame, grid: DataFrame, series: Sequence[str], min_snr: float = MIN_SNR, shared: Sequence[str] | None = None) -> DataFrame:
    """First peak, by falling power, that covers at least two observed events; one row per (series, duration)."""
    group = [*series, "duration_hours"]
    held, split = F.col("n_points") <= ROWS_PER_TASK, F.col("n_points") > ROWS_PER_TASK
    short = scan_blocks(df, grid.where(held), series, True, shared)
    valid = short.unionByName(split_peaks(df, grid.where(split), series).select(short.columns))
    best = valid.groupBy(*group).agg(F.max_by(
        F.struct("trial", "period", "epoch", "depth", "depth_err", "power", "n_events"),
        F.struct("power", F.col("trial"))).alias("b"))
    return graded(grid.select(*group, "n_trials").join(best, group, "left"), group, min_snr)


def graded(x: DataFrame, group: Sequence[str], min_snr: float = MIN_SNR) -> DataFrame:
    """The result of a search from the strongest peak ``b`` of each (series, duration), which may be missing."""
    b = F.col("b")
    snr = b["depth"] / b["depth_err"]
    found = snr >= min_snr
    return x.select(
        *group, "n_trials", F.when(found, b["period"]).alias("period"), F.when(found, b["epoch"]).alias("epoch"),
        F.when(found, b["depth"] * 1e6).alias("depth_ppm"), (b["depth_err"] * 1e6).alias("depth_err_ppm"), snr.alias("snr"),
        F.coalesce(b["n_events"], F.lit(0)).alias("n_events"),
        F.when(found, "detected").otherwise("no-detection").alias("status"))


def select_duration(results: DataFrame, series: Sequence[str]) -> DataFrame:
    """Best duration of each series by SNR; a missing SNR ranks last, ties go to the shorter one."""
    rank = F.struct(F.coalesce(F.round("snr", SCORE_DIGITS), F.lit(float("-inf"))), -F.col("duration_hours"))
    columns = [c for c in results.columns if c not in series]
    return results.groupBy(*series).agg(F.max_by(F.struct(*columns), rank).alias("b")).select(*series, "b.*")


def box_search(df: DataFrame, series: Sequence[str], durations_hours: Sequence[float], period_min: float = 0.5,
               period_max: float = 15.0, n_periods: int = 2000, bounds: DataFrame | None = None,
               min_points: int = 50, min_snr: float = MIN_SNR, shared: Sequence[str] | None = None) -> DataFrame:
    """One result per (series, duration); ``bounds`` gives period limits per series instead of constants.

    Series that agree in the ``shared`` columns, variants of one observation, are searched together.
    """
    facts = series_facts(df, series, min_points)
    if bounds is None:
        facts = facts.withColumn("period_min", F.lit(float(period_min))).withColumn("period_max", F.lit(float(period_max)))
    else:
        facts = facts.join(bounds, list(series))
    grid = period_grid(facts, durations_hours, n_periods)
    return select_peak(df, grid, list(series), min_snr, shared)


def targeted_bounds(priors: DataFrame, half_width: float = 0.1) -> DataFrame:
    """Period limits around a prior for ``box_search``."""
    return priors.select("target_id", F.greatest(F.col("period") - half_width, F.lit(half_width)).alias("period_min"),
                         (F.col("period") + half_width).alias("period_max"))


def promote_detections(det: DataFrame, min_snr: float = MIN_SNR) -> DataFrame:
    """Ephemerides from detections; ``reason`` tells why a row is not promoted."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    every = finite("period") & finite("epoch") & finite("depth_ppm") & finite("duration_hours")
    reason = (F.when(F.col("status") != "detected", "not detected").when(~every, "missing or non-finite field")
              .when((F.col("depth_ppm") <= 0) | (F.col("period") <= 0) | (F.col("duration_hours") <= 0), "non-positive field")
              .when(F.col("duration_hours") / 24.0 >= F.col("period"), "duration not shorter than period")
              .when(~(F.col("snr") >= min_snr) | F.col("snr").isNull(), "below SNR threshold")
              .when(F.col("n_events") < 2, "fewer than two events"))
    return det.withColumn("reason", reason).withColumn("promoted", F.col("reason").isNull())
