"""Sinks and state: Parquet folders that are appended or replaced, never pickles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The state of a sample that has not been selected yet.
SAMPLE_DEFAULTS = {"is_representative": False, "difficulty": 0.5, "rarity": 0.5, "novelty": 1.0, "times_selected": 0, "last_error_intensity": 0.5, "consecutive_low_error": 0, "retired": False}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def save_embeddings(df: DataFrame, path: str) -> None:
    df.select("id", "embedding").write.mode("overwrite").option("compression", "zstd").parquet(path)


def missing_only(df: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key the store lacks."""
    return df.join(stored.select(key), key, "left_anti")


def append_embeddings(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Append what is not there yet, so that a repeated append changes nothing."""
    new = missing_only(df, spark.read.parquet(path)) if exists(spark, path) else df
    new.select("id", "embedding").write.mode("append").option("compression", "zstd").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def updated(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the values of ``changes`` where they are not null. Unknown columns are ignored; unknown keys are the caller's error, see ``unknown_keys``."""
    columns = [c for c in changes.columns if c in old.columns and c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    return old.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in old.columns])


def unknown_keys(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return changes.join(old.select(key), key, "left_anti")


def with_sample_defaults(df: DataFrame) -> DataFrame:
    """Sample state with defaults for missing columns and nulls."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in SAMPLE_DEFAULTS.items()})


def save_round(df: DataFrame, path: str, round_no: int) -> None:
    """A snapshot of state under its round."""
    df.drop("round").write.mode("overwrite").parquet(f"{path}/round={round_no}")


def load_round(spark: SparkSession, path: str, round_no: int | None = None) -> DataFrame:
    """The snapshot of a round, else the latest."""
    df = spark.read.parquet(path)
    if round_no is None:
        round_no = df.agg(F.max("round")).first()[0]
    return df.filter(F.col("round") == round_no)


def retained(rounds: DataFrame, keep: int = 5, order: str = "round") -> DataFrame:
    """The newest rounds of a small table of rounds."""
    return rounds.withColumn("_n", F.row_number().over(Window.orderBy(F.col(order).desc()))).filter(F.col("_n") <= keep).drop("_n")


def bounded_history(rows: DataFrame, order: str, most: int = 1000, keep: int = 500) -> DataFrame:
    """A history as it is while it has at most ``most`` rows, else its last ``keep``."""
    return rows if rows.count() <= most else rows.orderBy(F.col(order).desc()).limit(keep)


def save_clusters(clusters: DataFrame, path: str) -> None:
    """Cluster properties and centroids as two tables, so that reading one does not read the other."""
    clusters.drop("centroid").write.mode("overwrite").parquet(f"{path}/clusters")
    clusters.select("cluster", "centroid").write.mode("overwrite").parquet(f"{path}/centroids")


def load_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Clusters with their centroids where there are any."""
    return spark.read.parquet(f"{path}/clusters").join(spark.read.parquet(f"{path}/centroids"), "cluster", "left")


def save_history(path: str, selections: DataFrame, round_no: int) -> None:
    """The ids of a round, under the round."""
    selections.select("id").write.mode("overwrite").parquet(f"{path}/round={round_no}")
