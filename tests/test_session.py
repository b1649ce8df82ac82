"""Settings, scratch folders and shipping."""

import glob
import os
import subprocess
import sys
import textwrap

import pytest

from fluxloom import plans
from fluxloom import session as S
from fluxloom.plans.registry import QUERIES

from .conftest import SF


def test_queries_leave_the_callers_settings_alone(spark):
    plans.load()
    before = dict(spark.conf.getAll)
    QUERIES["k2_lifecycle_stream"](spark, SF).count()
    QUERIES["b5_filter_tce"](spark, SF).count()
    assert dict(spark.conf.getAll) == before


def test_intermediates_stay_in_the_configured_folder(spark, tmp_path):
    """Every write of jobs with intermediates goes below ``spark.checkpoint.dir``."""
    code = f"""
        from fluxloom.session import local_session
        from pyspark.sql import SparkSession
        SparkSession.builder.config("spark.checkpoint.dir", "{tmp_path}/shared").getOrCreate().stop()
        spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "{tmp_path}/shared").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", "{tmp_path}/local").getOrCreate()
        from fluxloom import plans
        plans.load()
        from fluxloom.plans.registry import QUERIES
        for name in ("a14_append_run", "a15_event_log", "k3_outcome_counts", "h28_nearest_atmosphere"):
            QUERIES[name](spark, "{SF}").count()
    """
    (tmp_path / "tmp").mkdir()
    env = os.environ | {"TMPDIR": str(tmp_path / "tmp"), "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(S.__file__))), "SPARK_LOCAL_DIRS": str(tmp_path / "local")}
    before = set(glob.glob("/tmp/spark-*"))
    run = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert glob.glob(f"{tmp_path}/shared/**/part-*", recursive=True)
    made = set(glob.glob("/tmp/spark-*")) - before
    assert not [p for d in (*made, str(tmp_path / "tmp")) for p in glob.glob(f"{d}/**/part-*", recursive=True)]


def test_no_private_folder_on_a_cluster(monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        S.checkpoint_folder(Session())
    Context.master = "local[4]"
    assert S.checkpoint_folder(Session())


def test_the_package_is_shipped_once(tmp_path):
    sent = []

    class Context:
        master, applicationId = "local-cluster[2,1,1024]", "ship-test"

        def addPyFile(self, path):
            sent.append(path)

    session = type("Session", (), {"sparkContext": Context()})()
    S.ship(session)
    S.ship(session)
    assert len(sent) == 1
    out = subprocess.run([sys.executable, "-c", "import fluxloom.operators.spread as s; print(s.__file__)"], env=os.environ | {"PYTHONPATH": sent[0]}, cwd=tmp_path, capture_output=True, text=True)
    assert sent[0] in out.stdout
