"""Shared scratch tables for multi-phase operators.

Intermediate results are written as Parquet below the folder that the cluster
names in ``spark.checkpoint.dir``; every executor can read them again after
another executor was lost, and a written table cuts the lineage. Where that
setting is absent, a temporary folder is used, in local mode only.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    key = sc.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="framewright-")
    return _LOCAL[key]


def tidied(batches: Iterator, release: Callable[[], object] = lambda: None) -> Iterator:
    """``batches`` of a task; at its end or failure, what the worker holds is released.

    Spark keeps Python workers for later stages, so what one stage leaves in them would
    count in the memory of the next. Freed memory goes back to the system, where the C
    library has a call for that.
    """
    try:
        yield from batches
    finally:
        release()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def text_slices(batch: pa.RecordBatch, column: int, size: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of text each, or one longer text."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    first = 0
    while first < batch.num_rows:
        base = int(ends[first - 1]) if first else 0
        last = min(max(first + 1, int(np.searchsorted(ends, base + size, "right"))), first + rows)
        yield batch.slice(first, last - first)
        first = last


class Workspace:
    """A set of named scratch tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; its lineage ends at the files."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished phases.

        The context cleaner removes them once the driver's JVM has collected the
        plans, which it otherwise does every half hour only; without this, an operator
        of several phases holds the shuffle files of all of them at once.
        """
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        self._delete(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing is left that could delete
            pass
