"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revisionlens.session import checkpoint_dir, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes in one Arrow batch: whole texts and sets go through Python, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Most ids that are broadcast (16 bytes each); beyond it the join shuffles both sides.
BROADCAST_IDS = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder, package on the workers, short Arrow batches (both settings stay with the session)."""
    checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def frees(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, giving its freed memory back to the system when a task ends: workers live on."""
    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _release()
    return wrapped


def _release() -> None:
    import ctypes

    import pyarrow as pa
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)       # glibc keeps freed blocks in its heap
    if trim is not None:
        trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back."""
    return materialize(df, f"llm-{name}")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_IDS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if rows <= bound else df
