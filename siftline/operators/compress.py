"""Compression of clusters: representatives (farthest points, k-means, random) and reference sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import det, vec


def farthest_points(x: np.ndarray, m: int, cosine: bool = True) -> np.ndarray:
    """Row numbers: the first row, then again and again the one farthest from all chosen; of equals the first."""
    if len(x) <= m:
        return np.arange(len(x))
    square = (x**2).sum(axis=1)
    cost = (lambda j: 1.0 - x @ x[j]) if cosine else (lambda j: np.maximum(square - 2 * x @ x[j] + square[j], 0))
    chosen, nearest = [0], cost(0)
    for _ in range(m - 1):
        nearest[chosen[-1]] = -np.inf
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, cost(chosen[-1]))
        nearest[chosen] = -np.inf
    return np.array(chosen)


def fps(members: DataFrame, m: int = 2048, cosine: bool = True, normalise: bool = True) -> DataFrame:
    """(cluster, id, rank): farthest-point representatives of each cluster, in the order of ids.

    Each choice depends on all before it, so a cluster is one task; ``subdivide`` bounds its size (``max_size`` of the configuration).
    """
    rows = members.filter("cluster >= 0").select("cluster", "id", (vec.unit(F.col("v")) if normalise and cosine else F.col("v")).alias("v"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        chosen = farthest_points(np.stack(group["v"].to_numpy()), m, cosine)
        return pd.DataFrame({"cluster": group["cluster"].iloc[0], "id": group["id"].to_numpy()[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    kind = members.schema["id"].dataType.simpleString()
    return rows.groupBy("cluster").applyInPandas(run, f"cluster int, id {kind}, rank int")


def random_members(members: DataFrame, m: int, purpose: str, seed: int = 42) -> DataFrame:
    """(cluster, id, rank): up to ``m`` of each cluster, by hash. Ranks need only the ids, not the vectors."""
    w = Window.partitionBy("cluster").orderBy(det.uniform(seed, purpose, 0, "id"), "id")
    return members.filter("cluster >= 0").select("cluster", "id", F.row_number().over(w).cast("int").alias("rank")).filter(F.col("rank") <= m)


def first_members(members: DataFrame, m: int) -> DataFrame:
    """(cluster, id, rank): the first by id."""
    w = Window.partitionBy("cluster").orderBy("id")
    return members.filter("cluster >= 0").select("cluster", "id", F.row_number().over(w).cast("int").alias("rank")).filter(F.col("rank") <= m)


def kmeans_members(members: DataFrame, m: int, seed: int = 42, rounds: int = 20) -> DataFrame:
    """(cluster, id, rank): the member nearest to each of ``m`` k-means centres."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        x = np.stack(group["v"].to_numpy())
        if len(x) <= m:
            chosen = np.arange(len(x))
        else:
            c = x[np.random.default_rng(seed).choice(len(x), m, replace=False)]
            cost = lambda: (x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]
            for _ in range(rounds):
                own = cost().argmin(1)
                c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(m)])
            chosen = np.unique(cost().argmin(0))
        return pd.DataFrame({"cluster": group["cluster"].iloc[0], "id": group["id"].to_numpy()[chosen], "rank": np.arange(1, len(chosen) + 1, dtype=np.int32)})

    kind = members.schema["id"].dataType.simpleString()
    return members.filter("cluster >= 0").select("cluster", "id", "v").groupBy("cluster").applyInPandas(run, f"cluster int, id {kind}, rank int")


def compress(members: DataFrame, max_representatives: int = 2048, reference_size: int = 512, algorithm: str = "fps", seed: int = 42, cosine: bool = True) -> tuple[DataFrame, DataFrame]:
    """(representatives, references) of all clusters. ``cosine`` chooses the distance of farthest points; vectors that were centred need the other."""
    ways = {"fps": lambda: fps(members, max_representatives, cosine), "random": lambda: random_members(members, max_representatives, "rep", seed), "kmeans": lambda: kmeans_members(members, max_representatives, seed)}
    if algorithm not in ways:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return ways[algorithm](), random_members(members, reference_size, "ref", seed)
