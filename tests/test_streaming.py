"""Streams over files that arrive in two steps."""

from fluxloom.streaming import harvest, lifecycle

COLUMNS = ["tic_id", "snr", "period", "depth_ppm", "planet_radius", "stellar_radius", "tmag"]


def release(path, rows):
    path.write_text(",".join(COLUMNS) + "\n" + "".join(f"{tic},{snr},3,800,2,1,10\n" for tic, snr in rows))


def test_harvest_does_not_register_twice(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    registry = spark.createDataFrame([(30,)], "target_id long")
    up = spark.createDataFrame([(t, "a", True) for t in (10, 20, 30)], "target_id long, provider string, available boolean")
    sink, state = str(tmp_path / "sink"), str(tmp_path / "state")

    def run():
        stream = harvest.release_stream(spark, str(src), COLUMNS)
        harvest.harvest_stream(stream, {"a": registry}, up, sink, state).awaitTermination()

    release(src / "one.csv", [(10, 25), (30, 25), (10, 25), (50, 3), ("x1", 25)])
    release(src / "same.csv", [(10, 25)])
    run()
    release(src / "two.csv", [(10, 25), (20, 25), (40, 25)])
    run()
    got = sorted((r["target_id"] or 0, r["outcome"]) for r in spark.read.parquet(sink).collect())
    assert got == [(0, "invalid-identifier"), (10, "already-provisioned"), (10, "already-provisioned"), (10, "already-provisioned"), (10, "registered"),
                   (20, "registered"), (30, "ineligible"), (40, "unavailable"), (50, "out-of-bounds")]


def test_lifecycle_state_survives_between_runs(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.ROCKSDB)
    schema = "target_id long, event_id long, at long, state string, reason string"
    src, sink, state = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "state")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        lifecycle.run_to_table(lifecycle.lifecycle_stream(stream), sink, state).awaitTermination()

    run([(1, 2, 20, "stopped", None), (1, 1, 10, "active", None)])
    run([(1, 3, 30, "active", None), (1, 4, 40, "active", "new data")])
    got = {r["event_id"]: (r["from_state"], r["accepted"], r["problem"]) for r in spark.read.schema(lifecycle.OUTPUT).parquet(sink).collect()}
    assert got == {1: ("active", False, "state unchanged"), 2: ("active", True, None), 3: ("stopped", False, "reason required"), 4: ("stopped", True, None)}


def test_advances_follow_gate_snapshots(spark, tmp_path):
    """A target goes through all phases, is published by the review gate, and is locked from then on; another is stopped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.ROCKSDB)
    told, seen = "target_id long, event_id long, at long, kind string, state string, reason string", "target_id long, event_id long, at long, phase string, errors string"
    events, gates, sink, state = (str(tmp_path / name) for name in ("events", "gates", "sink", "state"))

    def run(new_events, new_gates):
        spark.createDataFrame(new_events, told).coalesce(1).write.mode("append").parquet(events)
        spark.createDataFrame(new_gates, seen).coalesce(1).write.mode("append").parquet(gates)
        stream = lifecycle.progress_stream(spark.readStream.schema(told).parquet(events), spark.readStream.schema(seen).parquet(gates))
        lifecycle.run_to_table(stream, sink, state).awaitTermination()

    go = lambda target, n, at: (target, n, at, "advance", None, None)
    run([go(1, 1, 5), go(1, 2, 20), (2, 10, 1, "state", "stopped", "withdrawn"), go(2, 11, 2)], [(1, 100, 10, "intake", "unchecked item"), (1, 101, 20, "intake", None), (2, 102, 0, "intake", "")])
    run([go(1, 20 + k, 100 + 10 * k) for k in range(7)] + [(2, 12, 3, "state", "active", "  "), (2, 13, 4, "state", "active", "new data"), go(2, 14, 5)],
        [(1, 200 + k, 100 + 10 * k, phase, None) for k, phase in enumerate(lifecycle.PHASES[1:])])
    got = {r["event_id"]: r for r in spark.read.schema(lifecycle.MOVES).parquet(sink).collect()}
    assert [got[k]["problem"] for k in (1, 2)] == ["no gate snapshot", None] and got[2]["to_phase"] == "feasibility"
    assert [got[20 + k]["to_phase"] for k in range(6)] == [*lifecycle.PHASES[2:], "review"]
    assert (got[25]["from_state"], got[25]["to_state"], got[25]["accepted"]) == ("active", "published", True)
    assert got[26]["problem"] == "lifecycle is already locked: published" and got[26]["to_state"] == "published"
    assert [got[k]["problem"] for k in (10, 11, 12, 13, 14)] == [None, "lifecycle is stopped", "reason required", None, None]
    assert got[14]["to_phase"] == "feasibility"


def test_hot_target_is_sorted_in_runs_and_emitted_in_slices():
    import pandas as pd

    frames = [pd.DataFrame({"at": [(37 * k + j * 11) % 501 for j in range(97)], "event_id": [97 * k + j for j in range(97)]}) for k in range(60)]
    rows = list(lifecycle.in_order(iter(frames), ["at", "event_id"], run=200))
    assert [(r.at, r.event_id) for r in rows] == sorted((a, e) for f in frames for a, e in zip(f["at"], f["event_id"], strict=True))
    assert list(lifecycle.in_order(iter([]), ["at"])) == []
    slices = list(lifecycle.in_slices(iter([(k,) for k in range(25_000)]), ["k"]))
    assert [len(x) for x in slices] == [10_000, 10_000, 5_000]


def test_one_target_with_a_third_of_all_events(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", lifecycle.ROCKSDB)
    src, sink, state = str(tmp_path / "src"), str(tmp_path / "sink"), str(tmp_path / "state")
    rows = spark.range(240_000).selectExpr("IF(id % 3 = 0, 1L, id % 500 + 2) AS target_id", "id AS event_id", "240000L - id AS at", "IF(id % 2 = 0, 'paused', 'active') AS state", "CAST(NULL AS string) AS reason")
    rows.write.parquet(src)
    lifecycle.run_to_table(lifecycle.lifecycle_stream(spark.readStream.schema(rows.schema).parquet(src)), sink, state).awaitTermination()
    got = spark.read.schema(lifecycle.OUTPUT).parquet(sink)
    assert got.count() == 240_000 and got.where("target_id = 1").count() == 80_000
    assert got.where("target_id = 1 AND NOT accepted").count() <= 1  # its events alternate between two states
