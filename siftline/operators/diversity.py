"""Diversity, coverage and balance of a selection."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vec


def average_pairwise(vectors: DataFrame, *keys: str) -> DataFrame:
    """``diversity``: mean cosine distance of all pairs, from the sum of the unit vectors instead of the pairs. 0 for fewer than two."""
    u = vec.unit_plus(F.col("v"))
    unit = vectors.select(*keys, u.alias("u")).withColumn("q", vec.dot(F.col("u"), F.col("u")))
    per = unit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), vec.mean_vector(F.col("u")).alias("m"), F.sum("q").alias("q"))
    n = F.col("n").cast("double")
    pairs = (n * n * vec.dot(F.col("m"), F.col("m")) - F.col("q")) / (n * (n - 1))
    return per.select(*keys, "n", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(1 - pairs).alias("diversity"))


def log_determinant(vectors: DataFrame, epsilon: float = 1e-6) -> float:
    """log det(V V' + eps I) / n of unit rows, from the D x D matrix that each partition sums up."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def gram(frames):
        for frame in frames:
            x = np.stack(frame["v"].to_numpy())
            x = x / (np.linalg.norm(x, axis=1, keepdims=True) + vec.TINY)
            yield pd.DataFrame({"n": [len(x)], "gram": [(x.T @ x).ravel()]})

    parts = vectors.select("v").mapInPandas(gram, schema)
    row = parts.agg(F.sum("n").alias("n"), vec.mean_vector(F.col("gram")).alias("m"), F.count(F.lit(1)).alias("k")).first()
    if not row["n"]:
        return 0.0
    n, g = row["n"], np.array(row["m"]) * row["k"]
    d = math.isqrt(len(g))
    sign, value = np.linalg.slogdet(g.reshape(d, d) + epsilon * np.eye(d))
    return float((value + (n - d) * math.log(epsilon)) / n) if sign > 0 else 0.0


def bin_coverage(points: DataFrame, bins: int = 10) -> DataFrame:
    """``coverage`` of points (x, y): mean share of non-empty bins of equal width per dimension; the last one includes the maximum."""
    span = points.agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))])
    df = points.crossJoin(F.broadcast(span))  # one row
    at = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), F.lit(bins // 2)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"lo_{c}")) / ((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / bins))))
    return df.agg(((F.countDistinct(at("x")) + F.countDistinct(at("y"))) / (2.0 * bins)).alias("coverage"))


def cluster_coverage(selected: DataFrame, total: int) -> DataFrame:
    return selected.agg((F.countDistinct("cluster") / F.lit(float(total)) if total else F.lit(0.0)).alias("coverage"))


def balance(counts: DataFrame) -> DataFrame:
    """``balance`` of (n): entropy of the shares by that of equal ones; 0 for none, one, or only empty clusters."""
    totals = counts.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    p = F.col("n") / F.col("t")
    df = counts.crossJoin(F.broadcast(totals)).groupBy("k", "t").agg(F.sum(-p * F.ln(p + F.lit(vec.TINY))).alias("h"))
    return df.select(F.when((F.col("k") < 2) | (F.col("t") == 0), F.lit(0.0)).otherwise(F.col("h") / F.ln(F.col("k").cast("double"))).alias("balance"))
