"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_KINDS = {"string": T.StringType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}


def fields(spec: str) -> T.StructType:
    """``"a long, b string"`` as a type; unlike a DDL string it needs no session, so functions can be declared at import."""
    return T.StructType([T.StructField(name, _KINDS[kind]()) for name, kind in (x.split() for x in spec.split(", "))])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local session without one (tests) gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="siftline-checkpoint-"))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and go on from the written copy.

    A later stage that loses an executor rereads the file instead of repeating the work, and a
    frame that is used several times is computed once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner find the shuffles and checkpoints that nothing refers to any more, before more disk is used."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session uses; widths of salts derive from it."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
