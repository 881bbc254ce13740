"""Memory of Python workers: they stay for the next task, so what a task has freed should go back to the machine."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch; texts may be long, and a batch is in memory several times.
BATCH_ROWS = "1000"
#: Groups of a list aggregation that a task keeps in memory before it sorts instead; Spark's own bound of 128 sorts nearly always.
GROUPS = 8192


def trim() -> None:
    """Return freed memory of pyarrow's pool and of malloc."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if malloc_trim:
            malloc_trim(0)


def trimmed(f: Callable) -> Callable:
    """``f`` for one group of rows, and then ``trim``."""

    def run(rows):
        try:
            return f(rows)
        finally:
            trim()

    return run


def small_batches(spark: SparkSession) -> None:
    """Settings of this session for queries over texts: Arrow batches of few rows, and lists of up to so many groups collected without sorting."""
    if int(spark.conf.get("spark.sql.objectHashAggregate.sortBased.fallbackThreshold")) < GROUPS:
        spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
