"""Skew-proof building blocks.

One key may hold a third of all rows, so nothing here sorts or collects a whole
group in one task:

* ``attach`` joins per-key facts to rows over ``(key, salt)``; the salt is a hash
  of the row, so a hot key is spread over ``SALTS`` tasks whatever join Spark picks.
* ``rank_rows`` numbers the rows of a group through ordered pieces: rows are
  sorted per piece only, and a small table of piece sizes carries the offsets.
* ``blocks`` turns row ranks into fixed-size blocks with a halo, so lag/lead and
  ``rowsBetween`` frames run on bounded partitions.
* ``quantiles`` brackets each wanted rank with a mergeable sketch, then counts and
  sorts exactly only the few rows inside the bracket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 16
HOUR = 1.0 / 24.0


def row_salt(df: DataFrame, keys: Sequence[str], parts: int = SALTS, spread: Sequence[str] | None = None) -> Column:
    """Hash of the row's own values; equal rows share a salt, which is harmless."""
    if spread is None:
        spread = [c for c, kind in df.dtypes if c not in keys and "map<" not in kind][:4] or list(keys)
    return F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int")


def fan_out(df: DataFrame, *columns: str | Column, least: int = 1) -> DataFrame:
    """Shuffle ahead of a row-multiplying step, into a number of tasks that adaptive
    execution does not shrink by the (still small) input size."""
    return df.repartition(max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *columns)


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner",
           parts: int = SALTS, spread: Sequence[str] | None = None) -> DataFrame:
    """Join one or few fact rows per key to many rows per key."""
    keys = list(keys)
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    salted = rows.withColumn("_salt", row_salt(rows, keys, parts, spread))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], piece: Column,
            rank: str = "rn", size: str = "n", previous: str | None = None) -> DataFrame:
    """Exact 1-based row number, group size and the previous row's first order column.

    ``piece`` must not decrease along ``order``. One pass sorts each piece; a table
    with one row per piece carries counts and last values across pieces.
    """
    keys = list(keys)
    pieces = df.withColumn("_piece", piece)
    aggs = [F.count(F.lit(1)).alias("_c")]
    here, along, group = W.partitionBy(*keys, "_piece").orderBy(*order), W.partitionBy(*keys).orderBy("_piece"), W.partitionBy(*keys)
    carried = [
        (F.sum("_c").over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
        F.sum("_c").over(group).alias(size)]
    local = pieces.withColumn("_local", F.row_number().over(here))
    if previous:
        first = order[0]
        aggs.append(F.max(first).alias("_end"))
        carried.append(F.lag("_end").over(along).alias("_prior"))
        local = local.withColumn("_lag", F.lag(first).over(here))
    facts = pieces.groupBy(*keys, "_piece").agg(*aggs).select(*keys, "_piece", *carried)
    out = local.join(facts, [*keys, "_piece"]).withColumn(rank, F.col("_before") + F.col("_local"))
    if previous:
        out = out.withColumn(previous, F.coalesce("_lag", "_prior")).drop("_lag", "_prior")
    return out.drop("_piece", "_before", "_local")


def rank_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], piece: Column) -> DataFrame:
    return ordered(df, keys, order, piece)


def time_piece(t: str | Column = "t", width_days: float = HOUR) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    return F.floor(t / F.lit(width_days)).cast("long")


def blocks(df: DataFrame, reach: int | Column, size: int | Column = 4096, rank: str = "rn") -> DataFrame:
    """Copy every row into each block whose frames may touch it (``_block``, ``_own``).

    Windows then use ``partitionBy(keys, _block).orderBy(rank)`` and hold at most
    ``size + 2 * reach`` rows; keep only rows with ``_own`` afterwards.
    """
    zero = F.col(rank) - 1
    reach = F.lit(reach) if isinstance(reach, int) else reach
    home = F.floor(zero / size)
    return (
        df.withColumn("_block", F.explode(F.sequence(
            F.greatest(F.floor((zero - reach) / size), F.lit(0)).cast("long"),
            F.floor((zero + reach) / size).cast("long"))))
        .withColumn("_own", F.col("_block") == home)
    )


# Accuracy of the bracketing sketch and the bracket half-widths used below it.
SKETCH_ACCURACY = 10000
NARROW, WIDE = 4.0 / SKETCH_ACCURACY, 0.02
WHOLE_BELOW, WIDE_BELOW = 100, SKETCH_ACCURACY


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: Sequence[float],
              names: Sequence[str], size: str = "n", extra: Sequence[Column] = ()) -> DataFrame:
    """Exact interpolated quantiles per group, with the count of non-missing values.

    Groups under 100 rows are sorted whole; larger groups sort only the rows whose
    value lies in the sketch bracket (4 % under 10,000 rows, 0.08 % above). The
    number of rows below the bracket is counted exactly, so the sketch never
    decides the result; a bracket that misses the rank raises an error. ``extra``
    aggregates over the column ``_v`` ride along in the same pass.
    """
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    x = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    marks: list[float] = []
    for p in probs:
        marks += [max(p - WIDE, 0.0), max(p - NARROW, 0.0), min(p + NARROW, 1.0), min(p + WIDE, 1.0)]
    sketch = x.groupBy(*keys).agg(
        F.count("_v").alias("_n"),
        F.percentile_approx("_v", [float(m) for m in marks], SKETCH_ACCURACY).alias("_b"),
    )
    n = F.col("_n")
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    facts = sketch.select(*keys, "_n", *[
        part for i in range(len(probs)) for part in (
            F.when(n < WHOLE_BELOW, low).when(n < WIDE_BELOW, F.col("_b")[4 * i]).otherwise(F.col("_b")[4 * i + 1]).alias(f"_lo{i}"),
            F.when(n < WHOLE_BELOW, high).when(n < WIDE_BELOW, F.col("_b")[4 * i + 3]).otherwise(F.col("_b")[4 * i + 2]).alias(f"_hi{i}"),
        )])
    joined = attach(x, facts, keys, spread=["_v"])
    aggs = []
    for i in range(len(probs)):
        inside = (F.col("_v") >= F.col(f"_lo{i}")) & (F.col("_v") <= F.col(f"_hi{i}"))
        aggs += [
            F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}"),
            F.sort_array(F.collect_list(F.when(inside, F.col("_v")))).alias(f"_in{i}"),
        ]
    picked = joined.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs, *extra)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        h = (n - 1) * F.lit(float(p))
        k = F.floor(h)
        first = F.get(F.col(f"_in{i}"), (k - F.col(f"_below{i}")).cast("int"))
        second = F.get(F.col(f"_in{i}"), (F.least(k + 1, n - 1) - F.col(f"_below{i}")).cast("int"))
        q = first + (h - k) * (second - first)
        out.append(F.when(q.isNull(), F.raise_error(F.lit("quantile bracket missed its rank"))).otherwise(q).cast("double").alias(name))
    fixed = {*keys, "_n", *(f"_below{i}" for i in range(len(probs))), *(f"_in{i}" for i in range(len(probs)))}
    return picked.select(*keys, n.alias(size), *out, *[c for c in picked.columns if c not in fixed])


def medians(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "median", size: str = "n") -> DataFrame:
    return quantiles(df, keys, value, [0.5], [name], size)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], piece: Column,
                value: str | Column, name: str = "running") -> DataFrame:
    """Inclusive running sum along ``order`` within each group, summed piece by piece."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    pieces = df.withColumn("_piece", piece).withColumn("_v", v)
    totals = pieces.groupBy(*keys, "_piece").agg(F.sum("_v").alias("_s"))
    along = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_piece", F.sum("_s").over(along).alias("_before"))
    here = W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = pieces.withColumn("_local", F.sum("_v").over(here)).drop("_v")
    joined = local.join(offsets, [*keys, "_piece"])
    return joined.withColumn(name, F.col("_local") + F.coalesce(F.col("_before"), F.col("_local") * 0)).drop(
        "_piece", "_local", "_before")


def previous_value(df: DataFrame, keys: Sequence[str], order: str, piece: Column, name: str = "previous") -> DataFrame:
    """Value of ``order`` in the row before, also across pieces."""
    return ordered(df, keys, [order], piece, "_rn", "_n", name).drop("_rn", "_n")


def value_piece(df: DataFrame, keys: Sequence[str], value: str, parts: int = 256) -> DataFrame:
    """Add ``_vp``: the value's position among ``parts`` equal steps of its group's exact range."""
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = F.when(F.col("_hi") > F.col("_lo"),
                  F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts), F.lit(parts - 1)))
    return attach(df, span, keys, spread=[value]).withColumn("_vp", F.coalesce(step, F.lit(0)).cast("int")).drop("_lo", "_hi")
