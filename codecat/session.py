"""Spark session and shared-storage helpers.

Everything that must survive an executor loss (closure levels, written
intermediate tables) goes under the folder the cluster names in
``spark.checkpoint.dir``.  We only pick our own folder when that setting
is absent, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "codecat",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with AQE, skew-join splitting and the UI off; the cluster's shuffle partitions unless some are asked for."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions is not None:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CODECAT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; set a private one only when unset (tests)."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="codecat-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Used at stage boundaries of multi-job builds: later jobs read the table
    instead of recomputing (and re-planning) the upstream plan, and a lost
    executor recomputes nothing before the boundary.  Parquet keeps the
    write columnar and compressed (zstd: half of snappy's size here) and lets later filters and projections
    push into the scan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def merged(df):
    """``df`` as a side of a join that is shuffled and sorted, never sent whole through the driver.

    For tables that grow with the data: Spark guesses their size from that of their compressed files, and rows of repeated
    texts take a hundred times that in memory.
    """
    return df.hint("merge")


# Rows of a table that may be sent whole through the driver, a few hundred bytes each.
ROWS_SENT = 400_000


def merged_if_long(df):
    """``df``, a written table, as a side of a join: ``merged`` where it has more than ROWS_SENT rows."""
    return merged(df) if df.count() > ROWS_SENT else df


def chars_of(df, col: str) -> int:
    """Characters of all texts in ``col``."""
    return df.agg(F.sum(F.length(col))).first()[0] or 0


@contextmanager
def shuffle_partitions(spark: SparkSession, least: int):
    """Shuffles planned inside have at least ``least`` partitions (small ones are merged by AQE)."""
    name = "spark.sql.shuffle.partitions"
    was = spark.conf.get(name)
    spark.conf.set(name, str(max(int(was), least)))
    try:
        yield
    finally:
        spark.conf.set(name, was)
