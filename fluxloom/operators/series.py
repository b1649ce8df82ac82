"""Ordered-series operators (IDs E1-E5, E7, E8, F5).

Rows are numbered with ``rank_rows`` and filtered in blocks with a halo, so one
long series is spread over many tasks. The running median and the local
quadratic have a width that differs per series, which a window frame cannot
express; those two finish in numpy on blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.operators.spread import attach, blocks, fan_out, medians, ordered, previous_value, rank_rows, running_sum, time_piece
from fluxloom.session import cut

GROUP = ("target_id", "sector")
BLOCK = 4096
BUDGET = 2_000_000  # window elements held at once by the numpy helpers
NARROW = 24  # half width from which windows are no longer looked at one by one


def median_spacing(df: DataFrame, keys: Sequence[str], name: str = "cadence") -> DataFrame:
    gaps = previous_value(df.select(*keys, "t"), keys, "t", time_piece("t"))
    return medians(gaps, keys, F.col("t") - F.col("previous"), name).drop("n")


def number_runs(x: DataFrame, keys: Sequence[str], starts: Column) -> DataFrame:
    """Run number and row number within the run, from ``rn`` and a start-of-run condition."""
    keys = list(keys)
    flagged = x.withColumn("_p", F.floor(F.col("rn") / BLOCK)).withColumn("_s", F.when(starts, F.col("rn")))
    ends = flagged.groupBy(*keys, "_p").agg(F.count("_s").alias("_k"), F.max("_s").alias("_m"))
    along = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*keys, "_p", F.sum("_k").over(along).alias("_runs"), F.max("_m").over(along).alias("_at"))
    here = W.partitionBy(*keys, "_p").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    y = flagged.withColumn("_k", F.count("_s").over(here)).withColumn("_m", F.max("_s").over(here)).join(ends, [*keys, "_p"])
    return y.withColumn("run", F.col("_k") + F.coalesce("_runs", F.lit(0))).withColumn(
        "rn", F.col("rn") - F.coalesce("_m", "_at", F.lit(1)) + 1).drop("_p", "_s", "_k", "_m", "_runs", "_at")


def with_runs(df: DataFrame, window_days: float, frac: float = 0.5, keys: Sequence[str] = GROUP) -> DataFrame:
    """Number the contiguous runs of each group: a new one after each gap above
    ``max(5 cadences, frac * window)``; ``rn`` counts rows inside the run."""
    keys = list(keys)
    spacing = median_spacing(df.where(F.col("flux").isNotNull()), keys)
    x = attach(ordered(df, keys, ["t"], time_piece("t"), previous="previous"), spacing, keys, "left", spread=["t"])
    limit = F.greatest(F.col("cadence") * 5.0, F.lit(frac * window_days))
    return number_runs(x, keys, F.col("t") - F.col("previous") > limit).drop("previous", "n")


def fill_missing(ranked: DataFrame, keys: Sequence[str], value: str = "flux", name: str = "filled", valid: str = "valid") -> DataFrame:
    """Interpolate NULL values linearly in row number; ends repeat the nearest value.

    Also gives the number of non-NULL values of the group.
    """
    keys = list(keys)
    x = ranked.withColumn("_p", F.floor(F.col("rn") / BLOCK)).withColumn(
        "_pt", F.when(F.col(value).isNotNull(), F.struct(F.col("rn").alias("r"), F.col(value).alias("v"))))
    ends = x.groupBy(*keys, "_p").agg(F.min("_pt").alias("_first"), F.max("_pt").alias("_last"), F.count("_pt").alias("_c"))
    # backwards as well as forwards: a frame that shrinks row by row is read anew for each row
    along, back = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.col("_p"), F.col("_p").desc()))
    ends = ends.select(
        *keys, "_p", F.sum("_c").over(W.partitionBy(*keys)).alias(valid), F.last("_last", True).over(along).alias("_before"),
        F.last("_first", True).over(back).alias("_after"))
    here, there = (W.partitionBy(*keys, "_p").orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.col("rn"), F.col("rn").desc()))
    local = x.withColumn("_lp", F.last("_pt", True).over(here)).withColumn("_ln", F.last("_pt", True).over(there))
    y = local.join(ends, [*keys, "_p"]).withColumn("_a", F.coalesce("_lp", "_before")).withColumn("_b", F.coalesce("_ln", "_after"))
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (F.col("rn") - a["r"]) / (b["r"] - a["r"]) * (b["v"] - a["v"])
    filled = F.coalesce(F.col(value), F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line))
    return y.withColumn(name, filled).drop("_p", "_pt", "_lp", "_ln", "_before", "_after", "_a", "_b")


def running_medians(v: np.ndarray, half: int) -> np.ndarray:
    """Median over ``2 half + 1`` samples with repeated edge values."""
    padded = np.pad(v, half, mode="edge")
    if half < NARROW or np.isnan(v).any():
        frames = sliding_window_view(padded, 2 * half + 1)
        step = max(1, BUDGET // (2 * half + 1))
        return np.concatenate([np.median(frames[i:i + step], axis=1) for i in range(0, len(v), step)])
    # the middle rank of every window, bit by bit: each step sorts the ranks by one more bit, so the cost does not grow with the width
    order = np.argsort(padded, kind="stable")
    ranks = np.empty(len(padded), np.int64)
    ranks[order] = np.arange(len(padded))
    low = np.arange(len(v))
    high, wanted, middle = low + 2 * half + 1, np.full(len(v), half), np.zeros(len(v), np.int64)
    for bit in reversed(range(len(padded).bit_length())):
        ones = (ranks >> bit & 1).astype(bool)
        zeros = np.r_[0, np.cumsum(~ones)]
        a, b = zeros[low], zeros[high]
        upper = wanted >= b - a
        middle |= upper.astype(np.int64) << bit
        wanted = np.where(upper, wanted - (b - a), wanted)
        low, high = np.where(upper, zeros[-1] + low - a, a), np.where(upper, zeros[-1] + high - b, b)
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return padded[order[middle]]


def block_size(reach: Column) -> Column:
    """Rows of a block: several times the halo, so that a wide one does not multiply the rows."""
    return F.greatest(F.lit(BLOCK), reach * 4)


def per_block(df: DataFrame, keys: Sequence[str], column: str, fn) -> DataFrame:
    """Run ``fn(block)`` on every block sorted by ``rn``; keep the block's own rows.

    A task takes its blocks one after the other from sorted rows, since most runs of a broken series are short.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.DoubleType())])
    group = [*keys, "_block"]

    def finish(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ends = np.r_[starts[1:], len(rows)]
        values = np.concatenate([fn(rows.iloc[a:b]) for a, b in zip(starts, ends)])
        return rows.assign(**{column: values})[rows["_own"].to_numpy(bool)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the block that the next batch may go on with
        for batch in batches:
            if not len(batch):
                continue
            whole = pd.concat([held[-1].iloc[-1:], batch], ignore_index=True) if held else batch
            new = np.zeros(len(whole), bool)
            new[0] = not held
            for name in group:
                now, before = whole[name].iloc[1:].reset_index(drop=True), whole[name].iloc[:-1]
                new[1:] |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(bool)
            starts = np.flatnonzero(new[1:] if held else new)
            if held and not len(starts):
                held.append(batch)
                continue
            last = int(starts[-1])
            ready = pd.concat([*held, batch.iloc[:last]], ignore_index=True)
            if len(ready):
                before = sum(map(len, held))
                firsts = starts[:-1] + before
                yield finish(ready, np.r_[0, firsts] if held else firsts)
            held = [batch.iloc[last:]]
        if held:
            yield finish(pd.concat(held, ignore_index=True), np.zeros(1, np.int64))

    return fan_out(df, *group).sortWithinPartitions(*group, "rn").mapInPandas(work, schema).drop("_block", "_own")


def detrend(df: DataFrame, window_days: float, split_gaps: bool = True, frac: float = 0.5,
            keys: Sequence[str] = GROUP) -> DataFrame:
    """Divide flux and flux error by a running median inside each contiguous run.

    The odd width is the window over the median cadence, at least 3. Runs with
    under three samples pass through, and a zero trend counts as one.
    """
    keys = list(keys)
    if split_gaps:
        runs = with_runs(df, window_days, frac, keys)
    else:
        spacing = median_spacing(df.where(F.col("flux").isNotNull()), keys)
        numbered = ordered(df, keys, ["t"], time_piece("t")).drop("n").withColumn("run", F.lit(0).cast("long"))
        runs = attach(numbered, spacing, keys, "left", spread=["t"])
    run_keys = [*keys, "run"]
    samples = F.greatest(F.lit(3), F.rint(F.lit(float(window_days)) / F.col("cadence")).cast("int"))
    width = F.when(F.col("cadence") > 0, samples + F.when(samples % 2 == 0, 1).otherwise(0)).otherwise(3)
    # numbered runs feed two more passes; written once, the plan stays short
    sized = cut(runs.withColumn("_half", ((width - 1) / 2).cast("int")).drop("cadence"))
    filled = fill_missing(sized, run_keys, "flux", "_filled", "_valid")
    framed = blocks(filled, F.col("_half"), block_size(F.col("_half")))
    trend = per_block(framed, run_keys, "_trend",
                      lambda b: running_medians(b["_filled"].to_numpy(float), int(b["_half"].iloc[0])))
    level = F.when((F.col("_valid") >= 3) & (F.col("_trend") != 0) & ~F.isnan("_trend"), F.col("_trend")).otherwise(F.lit(1.0))
    out = trend.withColumn("flux", F.col("flux") / level)
    if "flux_err" in df.columns:
        out = out.withColumn("flux_err", F.col("flux_err") / level)
    return out.select(*df.columns, "run")


def middle(x: np.ndarray) -> float | None:
    """Median by the formula of ``quantiles``; None without a value."""
    x = np.sort(x[~np.isnan(x)])
    if not len(x):
        return None
    h = (len(x) - 1) * 0.5
    k = int(h)
    return float(x[k] + (h - k) * (x[min(k + 1, len(x) - 1)] - x[k]))


def held_runs(t: np.ndarray, known: np.ndarray, groups: Sequence[tuple[int, int]], window_days: float, frac: float = 0.5) -> list[tuple[int, int, int]]:
    """First row, end and half window of each contiguous run as in ``detrend``; ``groups`` are slices in time order."""
    out = []
    for a, b in groups:
        cadence = middle(np.diff(t[a:b][known[a:b]]))
        limit = max(frac * window_days, 0.0 if cadence is None else cadence * 5.0)
        half = 1
        if cadence is not None and cadence > 0:
            samples = max(3, int(np.rint(window_days / cadence)))
            half = (samples + (samples % 2 == 0) - 1) // 2
        starts = a + np.r_[0, np.flatnonzero(np.diff(t[a:b]) > limit) + 1]
        out += [(int(x), int(y), half) for x, y in zip(starts, np.r_[starts[1:], b])]
    return out


def held_fill(flux: np.ndarray, known: np.ndarray) -> np.ndarray:
    """As ``fill_missing`` for one run with at least one known value."""
    if known.all():
        return flux
    at, row = np.flatnonzero(known), np.arange(len(flux))
    after = np.searchsorted(at, row)
    a, b = at[np.maximum(after - 1, 0)], at[np.minimum(after, len(at) - 1)]
    inside = (after > 0) & (after < len(at))
    line = flux[a] + (row - a) / np.where(inside, b - a, 1) * (flux[b] - flux[a])
    return np.where(known, flux, np.where(after == 0, flux[b], np.where(after == len(at), flux[a], line)))


def held_levels(flux: np.ndarray, known: np.ndarray, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """What ``detrend`` divides each row of a series by, whose rows one task holds; the same blocks."""
    level = np.ones(len(flux))
    for a, b, half in runs:
        if known[a:b].sum() < 3:
            continue
        filled, size = held_fill(flux[a:b], known[a:b]), max(BLOCK, half * 4)
        for low in range(0, b - a, size):
            high, first = min(low + size, b - a), max(low - half, 0)
            level[a + low:a + high] = running_medians(filled[first:high + half], half)[low - first:high - first]
    level[(level == 0) | np.isnan(level)] = 1.0
    return level


def held_scramble(key: int, sectors: np.ndarray, groups: Sequence[tuple[int, int]], seed: int) -> np.ndarray:
    """Row from which ``scramble`` takes the flux of each row; ``groups`` are the sectors' slices in time order."""
    source = np.arange(len(sectors))
    for a, b in groups:
        offset = 1 + (int(key) * 7919 + int(sectors[a]) * 104729 + seed * 1299709) % max(b - a - 1, 1)
        if b - a > 1:
            source[a:b] = a + (np.arange(b - a) - offset) % (b - a)
    return source


def scramble(df: DataFrame, seed: int, keys: Sequence[str] = GROUP, shift_key: str = "target_id") -> DataFrame:
    """Rotate the flux of each sector by an offset fixed by (target, sector, seed), never zero."""
    keys = list(keys)
    ranked = rank_rows(df, keys, ["t"], time_piece("t"))
    offset = F.lit(1) + F.pmod(F.col(shift_key) * 7919 + F.col("sector") * 104729 + F.lit(seed) * 1299709, F.greatest(F.col("n") - 1, F.lit(1)))
    values = ranked.select(*keys, "rn", F.col("flux").alias("_flux"))
    source = F.pmod(F.col("rn") - 1 - offset, F.col("n")) + 1
    moved = ranked.withColumn("_from", F.when(F.col("n") < 2, F.col("rn")).otherwise(source)).drop("flux", "rn", "n")
    joined = moved.join(values.withColumnRenamed("rn", "_from"), [*keys, "_from"])
    return joined.withColumnRenamed("_flux", "flux").select(*df.columns)


def local_quadratic(v: np.ndarray, rn: np.ndarray, n: int, width: int) -> np.ndarray:
    """Quadratic fitted to ``width`` neighbours; edge rows use the first or last full window."""
    first = int(rn[0])
    start = np.clip(rn - width // 2, 1, n - width + 1) - first
    usable = (start >= 0) & (start + width <= len(v))
    out = np.full(len(v), np.nan)
    u = np.linspace(-1.0, 1.0, width)
    basis, _ = np.linalg.qr(np.vander(u, 3))
    position = rn - first - start
    inner = usable & (position == width // 2)
    for s in np.unique(start[usable & ~inner]):  # the full windows at the ends of the run
        rows = np.flatnonzero(usable & ~inner & (start == s))
        out[rows] = basis[position[rows]] @ (basis.T @ v[s:s + width])
    rows = np.flatnonzero(inner)
    weights = basis @ basis[width // 2]
    if width > NARROW and np.isfinite(v).all():
        size, level = 1 << (len(v) + width).bit_length(), v.mean()  # the weights add up to one
        moved = np.fft.irfft(np.fft.rfft(v - level, size) * np.conj(np.fft.rfft(weights, size)), size)
        out[rows] = moved[start[rows]] + level
        return out
    frames = sliding_window_view(v, width) if len(v) >= width else np.empty((0, width))
    step = max(1, BUDGET // width)
    for i in range(0, len(rows), step):
        out[rows[i:i + step]] = frames[start[rows[i:i + step]]] @ weights
    return out


def highpass(df: DataFrame, window_days: float = 1.0) -> DataFrame:
    """ppm residual from a local quadratic per contiguous segment; short segments drop out."""
    keys = ["target_id"]
    numbered = cut(ordered(df, keys, ["t"], time_piece("t"), previous="previous").drop("n"))  # one sort for the cadence and the runs
    spacing = medians(numbered, keys, F.col("t") - F.col("previous"), "cadence").drop("n")
    x = attach(numbered, spacing, keys, spread=["t"])
    runs = number_runs(x, keys, F.col("t") - F.col("previous") > F.col("cadence") * 5.0).drop("previous")
    sizes = runs.groupBy("target_id", "run").agg(F.count(F.lit(1)).alias("n"))
    ranked = attach(runs, sizes, ["target_id", "run"], spread=["t"])
    nominal = F.rint(F.try_divide(F.lit(float(window_days)), F.col("cadence"))).cast("long")  # NULL where most instants are equal: the whole run
    odd = lambda c, less: F.when(c % 2 == 0, c - 1 if less else c + 1).otherwise(c)
    sized = ranked.withColumn("_width", F.least(odd(nominal, False), odd(F.col("n"), True)).cast("int")).where(F.col("_width") >= 11)
    framed = blocks(sized, F.col("_width"), block_size(F.col("_width")))
    fit = per_block(framed, ["target_id", "run"], "_trend", lambda b: local_quadratic(
        b["flux"].to_numpy(float), b["rn"].to_numpy(), int(b["n"].iloc[0]), int(b["_width"].iloc[0])))
    return fit.where(F.col("_trend").isNotNull() & (F.col("_trend") != 0)).withColumn(
        "residual_ppm", (F.col("flux") / F.col("_trend") - 1.0) * 1e6).select(*df.columns, "run", "residual_ppm")


def seed_fraction(key: Column, seed: int) -> Column:
    """Deterministic stand-in for a uniform draw in [0, 1)."""
    return F.pmod(key * 7919 + F.lit(seed) * 104729, F.lit(10007)) / F.lit(10007.0)


def resample(chain: DataFrame, seed: int, key: str = "chain", step: str = "step", piece_width: int = 10000) -> DataFrame:
    """Systematic resampling: row j repeats once per position inside its cumulative weight."""
    totals = chain.groupBy(key).agg(F.sum("weight").alias("_total"), F.count(F.lit(1)).alias("_n"),
                                    F.sum(F.col("weight") * F.col("weight")).alias("_sq"))
    piece = F.floor(F.col(step) / piece_width)
    cum = attach(running_sum(chain, [key], [step], piece, "weight", "_cum"), totals.where(F.col("_total") > 0), [key])
    scale = F.col("_n") / F.col("_total")
    u = seed_fraction(F.col(key), seed)
    low = F.greatest(F.ceil((F.col("_cum") - F.col("weight")) * scale - u), F.lit(0)).cast("long")
    high = F.least(F.ceil(F.col("_cum") * scale - u), F.col("_n")).cast("long")
    ess = F.col("_total") * F.col("_total") / F.col("_sq")
    return cum.where(low < high).select(*chain.columns, ess.alias("effective_samples"),
                                        F.explode(F.sequence(low, high - 1)).alias("position"))


def thin(chain: DataFrame, rows: int = 512, key: str = "chain", step: str = "step", piece_width: int = 10000) -> DataFrame:
    """At most ``rows`` evenly spaced rows per chain, first and last included."""
    ranked = rank_rows(chain, [key], [step], F.floor(F.col(step) / piece_width))
    r, n = F.col("rn") - 1, F.col("n")
    i = F.ceil(r * (rows - 1) / (n - 1))
    return ranked.where((n <= rows) | (F.floor(i * (n - 1) / (rows - 1)) == r)).select(*chain.columns, "rn", "n")


def chain_diagnostics(chain: DataFrame, tau: DataFrame) -> DataFrame:
    """Split R-hat, effective samples and length ratio per (target, parameter)."""
    size = chain.groupBy("target_id").agg((F.max("step") + 1).alias("_steps"), F.countDistinct("walker").alias("_walkers"))
    half = F.floor(F.col("_steps") / 2)
    part = F.when(F.col("step") < half, 0).when(F.col("step") >= F.col("_steps") - half, 1)
    halves = attach(chain, size, ["target_id"]).withColumn("_half", part).where(F.col("_half").isNotNull())
    cells = halves.groupBy("target_id", "param", "walker", "_half").agg(
        F.var_samp("value").alias("_var"), F.avg("value").alias("_mean"), F.max("_steps").alias("_steps"), F.max("_walkers").alias("_walkers"))
    m = F.floor(F.col("_steps") / 2)
    g = cells.groupBy("target_id", "param").agg(F.avg("_var").alias("_w"), F.var_samp("_mean").alias("_b"),
                                               F.max("_steps").alias("_steps"), F.max("_walkers").alias("_walkers"))
    plus = (m - 1) / m * F.col("_w") + F.col("_b")
    x = g.join(tau, "param", "left")
    out = x.select(
        "target_id", "param", F.when(F.col("_w") > 0, F.sqrt(plus / F.col("_w"))).alias("split_r_hat"),
        F.when(F.col("tau") > 0, F.col("_steps") * F.col("_walkers") / F.col("tau")).alias("effective_samples"),
        F.when(F.col("tau") > 0, F.col("_steps") / F.col("tau")).alias("length_over_tau"), "_steps", "_walkers")
    passed = ((F.col("_steps") >= 4) & (F.col("_walkers") >= 2) & (F.col("split_r_hat") <= 1.01)
              & (F.col("effective_samples") >= 400.0) & (F.col("length_over_tau") >= 50.0))
    return out.withColumn("mixing_passed", F.coalesce(passed, F.lit(False))).drop("_steps", "_walkers")
