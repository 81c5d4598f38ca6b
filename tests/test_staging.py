import os
import subprocess
import sys
from pathlib import Path

from lodestone import staging

REPO = Path(__file__).resolve().parents[1]


def test_sessions_delete_their_own_tables_only(spark):
    other = spark.newSession()
    mine, theirs = staging.stage(spark.range(3), "x"), staging.stage(other.range(4), "x")
    staging.drop_staged(spark)
    assert theirs.count() == 4
    staging.drop_staged(spark)  # nothing left is no error
    assert staging.stage(mine.sparkSession.range(2), "y").count() == 2
    staging.drop_staged(spark)
    staging.drop_staged(other)


def test_paths_are_qualified(spark):
    assert staging.qualified(spark, "/a/b") == staging.qualified(spark, "file:/a/b") == "file:///a/b"


def test_without_any_setting(tmp_path):
    """Stock Spark: no spark.checkpoint.dir anywhere."""
    code = (
        "from lodestone import staging; from lodestone.session import local_session; s = local_session(1); "
        "assert s.conf.get('spark.checkpoint.dir', None) is None; d = staging.stage(s.range(5), 'x'); assert d.count() == 5; "
        "assert staging.checkpoint_dir(s) == staging.checkpoint_dir(s.newSession()); staging.drop_staged(s)"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and k != "PYSPARK_GATEWAY_PORT" and k != "PYSPARK_GATEWAY_SECRET"}
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, env=env | {"SPARK_CONF_DIR": str(tmp_path)}, capture_output=True, text=True, timeout=180)
    assert not done.returncode, done.stderr[-2000:]


def test_a_stage_leaves_no_shuffle_files(spark, tmp_path):
    """They pile up otherwise until the driver collects garbage."""
    code = (
        "import os, sys, time; from lodestone import staging; from lodestone.session import local_session; s = local_session(1); "
        "n = lambda: sum(f.startswith('shuffle_') for _, _, x in os.walk(sys.argv[1]) for f in x); "
        "d = staging.stage(s.range(99).groupBy('id').count(), 'x'); time.sleep(3); assert n() == 0, n(); assert d.count() == 99; "
        "assert s.conf.get('spark.sql.classic.shuffleDependency.fileCleanup.enabled') == 'false'; staging.drop(d, s.range(2)); "
        "assert not [x for x in os.listdir(staging.session_dir(s).removeprefix('file://')) if x.startswith('x-')]"
    )
    env = {k: v for k, v in os.environ.items() if not k.startswith("SPARK_") and k != "PYSPARK_GATEWAY_PORT" and k != "PYSPARK_GATEWAY_SECRET"}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=REPO, env=env | {"SPARK_LOCAL_DIRS": str(tmp_path)}, capture_output=True, text=True, timeout=180)
    assert not done.returncode, done.stderr[-2000:]
