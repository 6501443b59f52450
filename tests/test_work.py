"""The shared folder in sessions that name one and in local ones that don't."""

import os
import subprocess
import sys

from calltrace.functions import work

CODE = """
from pyspark.sql import SparkSession
from calltrace.functions import work
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a = work.materialize(spark.range(5), "a")
assert a.count() == 5 and work.work_dir(spark) == work.work_dir(spark)
assert spark.conf.get("spark.checkpoint.dir", None) is None
work.release(a)
"""


def test_session_without_a_shared_folder(tmp_path):
    """Spark doesn't let a session set ``spark.checkpoint.dir``; nothing here may depend on defaults of the machine."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_materialize_and_release(spark):
    out = work.materialize(spark.range(7), "seven")
    assert out.count() == 7
    work.release(out)
    assert not any(s.isDirectory() for s in _under(spark, out._work_path))


def _under(spark, path):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.listStatus(p) if fs.exists(p) else []
