"""Spark session helpers.

The cluster decides where lineage-cutting tables live (``spark.checkpoint.dir``);
we only fill it in when it is unset, as in local tests.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(cpus: int | None = None, shuffle_partitions: int | None = None,
              app_name: str = "revisionlens") -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    parts = shuffle_partitions or cpus
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make the package importable by Python workers (``addPyFile`` of a zip).

    Grouped-map and Arrow functions are pickled by reference, so executors
    need the package; Spark distributes the zip from the driver once per
    context.
    """
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    import shutil
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="revisionlens-pkg-")
    zip_path = shutil.make_archive(os.path.join(out, "revisionlens"), "zip",
                                   root_dir=os.path.dirname(pkg_dir), base_dir=os.path.basename(pkg_dir))
    sc.addPyFile(zip_path)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``, else from the context's own checkpoint
    folder.  Only a local session that has neither (tests) gets a scratch
    folder; on a cluster a missing one is an error, as executors would write to
    their own disks.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="revisionlens-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    ship_package(spark)
    return current


_RECORDERS: list[list[str]] = []


@contextmanager
def recorded_tables():
    """The list of the tables that :func:`materialize` writes inside the ``with`` block."""
    made: list[str] = []
    _RECORDERS.append(made)
    try:
        yield made
    finally:
        _RECORDERS.remove(made)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more (else they go when the session ends)."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def materialize(df, name: str = "table", rebalance: bool = False):
    """Cut lineage by writing ``df`` once as a Parquet table in the shared
    checkpoint folder and reading it back.

    Used for inputs that several branches of one plan read (split sentences):
    each branch then scans the written files, with column pruning and filter
    pushdown, instead of recomputing the text work; a lost executor re-reads
    the files instead of recomputing from the raw text.  ``rebalance`` spreads the
    rows over files of about the advisory size first: a table that few tasks
    made (an input of few row groups, exploded) is then read by many.
    """
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for made in _RECORDERS:
        made.append(path)
    (df.hint("rebalance") if rebalance else df).write.mode("overwrite").parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(folder)     # when the session ends
    return spark.read.parquet(path)
