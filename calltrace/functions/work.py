"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each local application that names no shared one.
_OWN: dict[str, str] = {}
#: Spark deletes the shuffle files of a query when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The shared folder. A local session without one gets a temporary folder; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return qualified(spark, found)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority: one without a scheme is in the cluster's default file system, for Python code too."""
    sc = spark.sparkContext
    given = sc._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(given).toString().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/calltrace/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Within it the shuffle files of a write go as soon as it is done; otherwise they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage, survives lost executors and, unlike a cached or checkpointed frame, keeps column pruning.
    """
    path = new_path(df.sparkSession, label)
    with shuffles_end(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    given = sc._jvm.org.apache.hadoop.fs.Path(path)
    given.getFileSystem(sc._jsc.hadoopConfiguration()).delete(given, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    sc = spark.sparkContext
    given, to = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    if not given.getFileSystem(sc._jsc.hadoopConfiguration()).rename(given, to):
        raise OSError(f"{old} could not be renamed to {new}")


def release(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`materialize`; nothing lazy may still read them."""
    for df in frames:
        delete(df.sparkSession, df._work_path)
