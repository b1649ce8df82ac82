"""Column expressions for folding times on an ephemeris."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floored_mod(x: Column, m: Column) -> Column:
    """Modulo whose result has the sign of the divisor (SQL ``%`` truncates)."""
    return x - m * F.floor(x / m)


def phase_days(t, period, epoch) -> Column:
    """Signed days from the nearest event centre, in [-P/2, P/2)."""
    t, period, epoch = col(t), col(period), col(epoch)
    return floored_mod(t - epoch + period / 2, period) - period / 2


def phase_hours(t, period, epoch) -> Column:
    return phase_days(t, period, epoch) * F.lit(24.0)


def cycle_number(t, period, epoch, rule: str = "rint") -> Column:
    """Event number: ``rint`` is half-even, ``floor`` rounds halves up."""
    x = (col(t) - col(epoch)) / col(period)
    if rule == "rint":
        return F.rint(x).cast("long")
    if rule == "floor":
        return F.floor(x + F.lit(0.5)).cast("long")
    raise ValueError("rule must be 'rint' or 'floor'")


def window_label(hours, duration_hours) -> Column:
    """``in`` within half a duration, ``baseline`` from 1.2 to 2.5 durations, else NULL."""
    a, d = F.abs(col(hours)), col(duration_hours)
    return F.when(a < d * 0.5, F.lit("in")).when((a > d * 1.2) & (a < d * 2.5), F.lit("baseline"))


def box_overlap(t, exposure, period, epoch, duration_hours) -> Column:
    """Fraction of each exposure that lies inside the nearest box event."""
    t, exposure, period, epoch = col(t), col(exposure), col(period), col(epoch)
    half = col(duration_hours) / 24.0 / 2
    centre = epoch + F.rint((t - epoch) / period) * period
    shared = F.least(t + exposure / 2, centre + half) - F.greatest(t - exposure / 2, centre - half)
    return F.least(F.greatest(shared, F.lit(0.0)) / exposure, F.lit(1.0))
