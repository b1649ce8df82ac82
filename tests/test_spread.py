"""Skew-proof primitives against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fluxloom.operators import series
from fluxloom.operators import spread as S


@pytest.fixture(scope="module")
def hot(spark):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(40000) < 0.75, 0, rng.integers(1, 60, 40000))
    value = np.where(rng.random(40000) < 0.01, 1e9, rng.normal(size=40000).round(3))
    return pd.DataFrame({"k": key, "t": rng.permutation(40000) * 1e-3, "v": value})


def test_quantiles_match_numpy_on_hot_and_small_groups(spark, hot):
    probs = [0.0, 0.16, 0.5, 0.84, 1.0]
    names = [f"q{i}" for i in range(5)]
    got = S.quantiles(spark.createDataFrame(hot), ["k"], "v", probs, names).toPandas().set_index("k")
    for k, rows in hot.groupby("k"):
        assert got.loc[k, "n"] == len(rows)
        np.testing.assert_allclose(got.loc[k, names].to_numpy(float), np.quantile(rows["v"], probs), rtol=1e-12)


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, float("nan")), (1, None), (1, 4.0)], "k int, v double")
    row = S.medians(df, ["k"], "v").first()
    assert (row["n"], row["median"]) == (2, 2.5)


def test_ordered_gives_rank_size_and_previous(spark, hot):
    df = spark.createDataFrame(hot)
    got = S.ordered(df, ["k"], ["t"], S.time_piece("t", 0.5), previous="p").toPandas().sort_values(["k", "t"], ignore_index=True)
    want = hot.sort_values(["k", "t"], ignore_index=True)
    group = want.groupby("k")
    assert (got["rn"].to_numpy() == group.cumcount().to_numpy() + 1).all()
    assert (got["n"].to_numpy() == group["t"].transform("size").to_numpy()).all()
    np.testing.assert_array_equal(got["p"].to_numpy(float), group["t"].shift().to_numpy(float))


def test_running_sum_and_blocks(spark, hot):
    df = spark.createDataFrame(hot.assign(one=1.0))
    run = S.running_sum(df, ["k"], ["t"], S.time_piece("t", 0.5), "one", "c").toPandas().sort_values(["k", "t"])
    assert (run["c"].to_numpy() == run.groupby("k").cumcount().to_numpy() + 1).all()
    ranked = S.ordered(df, ["k"], ["t"], S.time_piece("t", 0.5))
    framed = S.blocks(ranked, 3, size=100)
    w = W.partitionBy("k", "_block").orderBy("rn").rowsBetween(-3, 3)
    got = framed.withColumn("m", F.sum("t").over(w)).where("_own").toPandas().sort_values(["k", "rn"])
    want = hot.sort_values(["k", "t"]).groupby("k")["t"].rolling(7, center=True, min_periods=1).sum()
    np.testing.assert_allclose(got["m"].to_numpy(), want.to_numpy(), rtol=1e-9)
    assert framed.groupBy("k", "_block").count().agg(F.max("count")).first()[0] <= 106


def test_attach_spreads_a_hot_key(spark, hot):
    df = spark.createDataFrame(hot)
    facts = df.select("k").distinct().withColumn("f", F.col("k") * 2)
    got = S.attach(df, facts, ["k"], spread=["t"])
    assert got.count() == len(hot) and got.where("f <> k * 2").count() == 0
    salts = df.where("k = 0").select(S.row_salt(df, ["k"], spread=["t"]).alias("s")).distinct().count()
    assert salts == S.SALTS


def test_wide_windows_cost_no_more_than_narrow_ones(monkeypatch):
    """Running medians and local quadratics of wide windows, without a look at each window's values."""
    rng = np.random.default_rng(3)
    for n, half in ((5000, 700), (300, 400), (1000, 30)):
        v = rng.normal(size=n).round(1)
        want = [np.median(np.pad(v, half, mode="edge")[i:i + 2 * half + 1]) for i in range(n)]
        with monkeypatch.context() as m:
            m.setattr(series, "sliding_window_view", None)
            assert series.running_medians(v, half).tolist() == want
    v, width = 1 + rng.normal(0, 1e-3, 2000), 301
    with monkeypatch.context() as m:
        m.setattr(series, "sliding_window_view", None)
        got = series.local_quadratic(v, np.arange(1, 2001), 2000, width)
    for i in (0, 70, 150, 151, 999, 1849, 1850, 1990, 1999):
        s = min(max(i - width // 2, 0), 2000 - width)
        assert got[i] == pytest.approx(np.polyval(np.polyfit(np.arange(width) - 150, v[s:s + width], 2), i - s - 150), rel=1e-11)


def test_blocks_of_a_task_are_told_apart(spark):
    """Blocks within a batch and over several, in tasks that hold many of them."""
    n = np.r_[np.full(300, 2), 25_000, np.arange(1, 40), 12_000]
    group = np.repeat(np.arange(len(n)), n)
    rows = pd.DataFrame({"run": group, "_block": 0, "rn": np.concatenate([np.arange(k) for k in n]) + 1, "_own": True, "v": np.arange(len(group)) * 1.0})
    got = series.per_block(spark.createDataFrame(rows), ["run"], "first", lambda b: np.full(len(b), b["v"].iloc[0] + len(b) / 1e6)).toPandas()
    assert len(got) == len(rows)
    starts = np.r_[0, np.cumsum(n)[:-1]]
    assert np.allclose(got["first"], starts[got["run"]] + n[got["run"]] / 1e6, rtol=0, atol=1e-9)


def test_gaps_are_filled_without_shrinking_frames(spark):
    rows = spark.createDataFrame([(1, i, None if i % 3 else float(i * i)) for i in range(1, 50)], "target_id int, rn int, flux double")
    filled = series.fill_missing(rows, ["target_id"])
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "").lower()
    at = {r.rn: r.filled for r in filled.collect()}
    assert at[1] == at[3] == 9.0 and at[49] == at[48] == 48.0 ** 2 and at[4] == pytest.approx(9 + 27 / 3)
