"""Written stages: Parquet tables in the shared checkpoint folder, with their removal."""

from __future__ import annotations

import atexit
import os

from pyspark.sql import DataFrame, SparkSession

from codecat.session import scratch_path

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_KEPT: dict[str, SparkSession] = {}


def stage(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The shuffle files behind it go as soon as it is written, so that a chain of
    stages holds the disk of one stage at a time.  A lost executor costs nothing
    that was written before.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        writer = df.write
        if row_group:
            writer = writer.option("parquet.block.size", row_group).option("compression", "none")
        writer.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _KEPT[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        _delete(getattr(df, "stage_path", None))


def _delete(path: str | None) -> None:
    spark = _KEPT.pop(path, None)
    if spark is not None:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            pass


@atexit.register
def drop_all() -> None:
    """Delete every stage of this process; results that still read one must have been written before."""
    for path in list(_KEPT):
        _delete(path)


def on_executors(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (an installed copy needs nothing)."""
    import codecat

    root = os.path.dirname(os.path.dirname(os.path.abspath(codecat.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
