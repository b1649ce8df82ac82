"""File sources and sinks."""

from fluxloom.operators import evidence
from fluxloom.sources import cadence, records

HEADER = ["TIC_ID", "mes", "period_days", "depth_ppm", "prad", "rstar", "tmag"]


def test_release_csv_skips_comments(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# release\n\n" + ",".join(HEADER) + "\n# note\nTIC 12345,25,3.5,800,2.0,1.0,\n0,9,x,1,1,1,1\n")
    rows = records.read_tce(spark, str(tmp_path), HEADER).collect()
    assert [r["tic"] for r in rows] == ["12345", None]
    assert rows[0]["snr"] == 25.0 and rows[0]["tmag"] is None and rows[1]["period"] is None


def test_catalog_payload_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": [{"toi": "1.01", "n": 2}]}')
    (tmp_path / "b.json").write_text('[{"v": NaN}]')
    rows = {r["path"].rsplit("/", 1)[1]: r for r in records.read_catalog(spark, str(tmp_path), "json").collect()}
    assert rows["a.json"]["record"] == {"toi": "1.01", "n": "2"} and rows["b.json"]["parse_error"] == "non-finite number"
    (tmp_path / "c.csv").write_text("toi,tid\n1.01,5\n")
    row = records.read_catalog(spark, str(tmp_path / "c.csv"), "csv", ["toi", "tid"]).first()
    assert row["record"] == {"toi": "1.01", "tid": "5"}


def test_cadence_scan_prunes_sectors(spark, tmp_path):
    rows = [(1, s, i * 0.1, 0, 2.0 + i % 3) for s in (1, 2) for i in range(60)]
    spark.createDataFrame(rows, "target_id long, sector int, t double, quality int, flux double").write.partitionBy("sector").parquet(str(tmp_path / "lc"))
    out = cadence.read_cadence(spark, str(tmp_path / "lc"), sectors=[2])
    assert out.count() == 60 and {round(r["flux"], 6) for r in out.select("flux").distinct().collect()} == {round(v / 3, 6) for v in (2, 3, 4)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sector" in plan or "sector#" in plan.split("PartitionFilters")[1][:80]


def test_runs_are_never_overwritten(spark, tmp_path):
    path = str(tmp_path / "runs")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert records.append_run(first, path, "r1", ["id"]).count() == 2
    again = spark.createDataFrame([(2, "changed"), (3, "c")], "id long, v string")
    assert [r["id"] for r in records.append_run(again, path, "r2", ["id"]).collect()] == [3]
    assert {(r["id"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"payload")
    row = evidence.hash_files(spark, str(tmp_path)).first()
    assert row["sha256"] == hashlib.sha256(b"payload").hexdigest() and row["size"] == 7
