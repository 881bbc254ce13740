"""Selection: rarity, novelty, priority, mixed selection, budgets, posteriors, cluster choice, retirement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import det, vec

#: Rows of history that one task compares with at a time.
HISTORY_BLOCK = 8192


def knn_distance(candidates: DataFrame, references: DataFrame, k: int = 10) -> DataFrame:
    """(id, cluster, knn): mean of the ``k`` smallest cosine distances to the references of the same cluster; at most their number less one.

    Representatives and references are bounded per cluster, so a cluster is one group.
    """
    kind = candidates.schema["id"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):  # references without candidates
            return pd.DataFrame({"id": np.zeros(0, object), "cluster": np.zeros(0, np.int32), "knn": np.zeros(0)})
        most = min(k, len(right) - 1)
        if most < 1:
            knn = np.zeros(len(left))
        else:
            unit = lambda s: (lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.TINY))(np.stack(s.to_numpy()))
            cost = 1.0 - unit(left["v"]) @ unit(right["w"]).T
            knn = np.sort(np.partition(cost, most - 1, axis=1)[:, :most], axis=1).mean(axis=1)
        return pd.DataFrame({"id": pd.Series(list(left["id"]), dtype=object), "cluster": list(left["cluster"]), "knn": knn})

    return candidates.select("id", "cluster", "v").groupBy("cluster").cogroup(references.select(F.col("cluster").alias("of"), F.col("v").alias("w")).groupBy("of")).applyInPandas(run, f"id {kind}, cluster int, knn double")


def _min_max(x: str, group: Window, constant: float) -> Column:
    low, high = F.min(x).over(group), F.max(x).over(group)
    return F.when(high == low, F.lit(constant)).otherwise((F.col(x) - low) / (high - low + F.lit(vec.TINY)))


def rarity(candidates: DataFrame, references: DataFrame, k: int = 10) -> DataFrame:
    """(id, cluster, rarity): the kNN distance, min-max within the cluster; equal ones are 0."""
    knn = knn_distance(candidates, references, k)
    return knn.select("id", "cluster", _min_max("knn", Window.partitionBy("cluster"), 0.0).alias("rarity"))


def history_distance(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """(id, cluster, nearest): smallest cosine distance to any vector of the history; null without a history.

    The history goes block by block: every block of candidates meets every block of the history by an equi-join on
    numbers of blocks, and a running minimum is kept. A history of one block is broadcast.
    """
    count = history.count()
    out = candidates.select("id", "cluster", "v")
    if not count:
        return out.select("id", "cluster", F.lit(None).cast("double").alias("nearest"))
    blocks = -(-count // HISTORY_BLOCK)
    packed = history.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("_b"), "v").groupBy("_b").agg(F.collect_list("v").alias("h"))

    @F.pandas_udf("double")
    def least(v: pd.Series, h: pd.Series) -> pd.Series:
        got, last, matrix = [], None, None
        for x, block in zip(v, h, strict=True):
            if last is None or block is not last:
                matrix = np.stack([np.asarray(y) for y in block])
                matrix = matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + vec.TINY)
                last = block
            got.append(1.0 - float((matrix @ (np.asarray(x) / (np.linalg.norm(x) + vec.TINY))).max()))
        return pd.Series(got, dtype=float)

    if blocks == 1:  # one matrix for each task
        model = history.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in history.select("v").collect()]))

        @F.pandas_udf("double")
        def least_of_all(v: pd.Series) -> pd.Series:
            unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + vec.TINY)
            return pd.Series(1.0 - (unit(np.stack(v.to_numpy())) @ unit(model.value).T).max(axis=1)) if len(v) else pd.Series([], dtype=float)

        return out.select("id", "cluster", least_of_all("v").alias("nearest"))
    each = out.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    return each.join(packed, "_b").select("id", "cluster", least("v", "h").alias("d")).groupBy("id", "cluster").agg(F.min("d").alias("nearest"))


def novelty(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """(id, cluster, novelty): the distance to the history, min-max within the cluster; equal ones, and all without a history, are 1."""
    near = history_distance(candidates, history)
    return near.select("id", "cluster", F.coalesce(_min_max("nearest", Window.partitionBy("cluster"), 1.0), F.lit(1.0)).alias("novelty"))


def priority(difficulty: Column, rarity_: Column, novelty_: Column, c: float = 0.5, a: float = 0.5, b: float = 0.5) -> Column:
    return F.lit(c) * difficulty + F.lit(1 - c) * (F.lit(a) * rarity_ + F.lit(b) * (F.lit(1.0) - difficulty) * novelty_)


def mixed_selection(candidates: DataFrame, budgets: DataFrame, ratios: tuple[float, float] = (0.8, 0.15), seed: int = 42, round_no: int = 1) -> DataFrame:
    """Candidates (cluster, id, priority, rarity) that the budgets (cluster, n) take, with ``picked_by``.

    int(n * .8) by priority, then int(n * .15) of the rest by rarity, then at random. A cluster with no more candidates than n gives all.
    """
    w = Window.partitionBy("cluster")
    df = candidates.join(budgets, "cluster").withColumn("_all", F.count(F.lit(1)).over(w))
    df = df.withColumn("_p", F.row_number().over(w.orderBy(F.col("priority").desc(), "id")))
    by_priority = F.col("_p") <= F.floor(F.col("n") * F.lit(ratios[0]))
    df = df.withColumn("_t", F.when(by_priority, 0).otherwise(1)).withColumn("_r", F.row_number().over(Window.partitionBy("cluster", "_t").orderBy(F.col("rarity").desc(), "id")))
    by_rarity = (F.col("_t") == 1) & (F.col("_r") <= F.floor(F.col("n") * F.lit(ratios[1])))
    df = df.withColumn("_s", F.when(by_rarity, 2).otherwise(F.col("_t"))).withColumn("_u", F.row_number().over(Window.partitionBy("cluster", "_s").orderBy(det.uniform(seed, "mixed", round_no, "id"), "id")))
    at_random = (F.col("_s") == 1) & (F.col("_u") <= F.col("n") - F.floor(F.col("n") * F.lit(ratios[0])) - F.floor(F.col("n") * F.lit(ratios[1])))
    how = F.when(F.col("_all") <= F.col("n"), "all").when(F.col("_s") == 0, "priority").when(F.col("_s") == 2, "rarity").when(at_random, "random")
    return df.withColumn("picked_by", how).filter("picked_by is not null").drop("_all", "_p", "_t", "_r", "_s", "_u")


def _spread_remainder(df: DataFrame, total: Column, room: Column) -> DataFrame:
    """What is left of ``total`` goes to the heaviest clusters first, as far as each has ``room``: a prefix sum instead of a loop."""
    everything = Window.partitionBy()
    order = Window.partitionBy().orderBy(F.col("weight").desc(), "cluster").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_room", F.greatest(F.lit(0), room)).withColumn("_rest", total - F.sum("alloc").over(everything))
    more = F.greatest(F.lit(0), F.least(F.col("_room"), F.col("_rest") - F.coalesce(F.sum("_room").over(order), F.lit(0))))
    return df.withColumn("alloc", (F.col("alloc") + more).cast("bigint")).drop("_room", "_rest")


def allocate(clusters: DataFrame, total: int = 10_000, base_ratio: float = 0.2, max_ratio: float = 3.0) -> DataFrame:
    """(cluster, alloc) of the selected clusters (cluster, weight, capacity): a base for each, the rest by weight, all within bounds."""
    one = Window.partitionBy()  # one row per selected cluster
    df = clusters.withColumns({"weight": F.coalesce("weight", F.lit(0.5)), "_k": F.count(F.lit(1)).over(one)})
    base = F.greatest(F.lit(5), F.floor(F.lit(total * base_ratio) / F.col("_k")))
    most = F.floor(F.lit(max_ratio * total) / F.col("_k"))
    df = df.withColumn("_base", base).withColumn("_most", most).withColumn("capacity", F.coalesce("capacity", F.lit(total)))
    df = df.withColumn("alloc", F.least("capacity", "_base")).withColumn("_left", F.lit(total) - F.sum("alloc").over(one))
    extra = F.floor(F.col("_left") * F.col("weight") / (F.sum("weight").over(one) + F.lit(vec.TINY)))
    df = df.withColumn("alloc", F.when(F.col("_left") > 0, F.least("capacity", F.col("alloc") + extra, "_most")).otherwise(F.col("alloc")).cast("bigint"))
    return _spread_remainder(df, F.lit(total), F.least("capacity", "_most") - F.col("alloc")).select("cluster", "alloc")


def allocate_adaptive(clusters: DataFrame, total: int = 10_000, explore_ratio: float = 0.2) -> DataFrame:
    """(cluster, alloc) of clusters (cluster, weight, capacity, visits): a fifth for the least visited, the rest by weight."""
    one = Window.partitionBy()
    df = clusters.withColumns({"weight": F.coalesce("weight", F.lit(0.5)), "capacity": F.coalesce("capacity", F.lit(total)), "_low": F.col("visits") <= F.min("visits").over(one) + 1})
    n_low = F.sum(F.col("_low").cast("int")).over(one)
    df = df.withColumn("alloc", F.when(F.col("_low"), F.least("capacity", F.floor(F.lit(int(total * explore_ratio)) / n_low))).otherwise(F.lit(0)).cast("bigint"))
    left = F.lit(total) - F.sum("alloc").over(one)
    df = df.withColumn("_left", left).withColumn("_share", F.floor(F.col("_left") * F.col("weight") / (F.sum("weight").over(one) + F.lit(vec.TINY))))
    df = df.withColumn("alloc", (F.col("alloc") + F.least(F.col("_share"), F.col("capacity") - F.col("alloc"))).cast("bigint"))
    return _spread_remainder(df, F.lit(total), F.col("capacity") - F.col("alloc")).select("cluster", "alloc")


def initial_posteriors(clusters: DataFrame, alpha0: float = 1.0, beta0: float = 1.0, strength: float = 2.0) -> DataFrame:
    """(cluster, alpha, beta, visits); a prior score moves the start."""
    s = F.col("prior_score") if "prior_score" in clusters.columns else F.lit(None).cast("double")
    return clusters.select("cluster", F.coalesce(F.lit(alpha0) + F.lit(strength) * s, F.lit(alpha0)).alias("alpha"), F.coalesce(F.lit(beta0) + F.lit(strength) * (1 - s), F.lit(beta0)).alias("beta"), F.lit(0).cast("bigint").alias("visits"))


def posterior_mean() -> Column:
    return F.col("alpha") / (F.col("alpha") + F.col("beta"))


def posterior_variance() -> Column:
    s = F.col("alpha") + F.col("beta")
    return F.col("alpha") * F.col("beta") / (s * s * (s + 1))


def n_to_select(available: int, fixed: int | None = None, ratio: float = 0.3) -> int:
    return min(available, fixed if fixed is not None else max(1, int(available * ratio)))


def thompson_select(posteriors: DataFrame, n: int, round_no: int, seed: int = 42, warmup_rounds: int = 0) -> DataFrame:
    """(cluster, theta, rank) of the ``n`` clusters chosen in a round.

    In warm-up rounds unvisited clusters come first, in random order; all others by a draw from their posterior.
    """
    theta = det.beta(F.col("alpha"), F.col("beta"), seed, round_no, F.col("cluster"))
    warm = F.lit(round_no <= warmup_rounds) & (F.col("visits") == 0)
    df = posteriors.withColumn("theta", theta).withColumn("_key", F.when(warm, det.uniform(seed, "warmup", round_no, "cluster")).otherwise(F.col("theta")))
    top = df.orderBy(warm.desc(), F.col("_key").desc(), "cluster").limit(n)  # a heap per task instead of a sort
    w = Window.partitionBy().orderBy(F.expr("_warm").desc(), F.col("_key").desc(), "cluster")
    return top.withColumn("_warm", warm).select("cluster", "theta", F.row_number().over(w).cast("int").alias("rank"))


def active(samples: DataFrame, revisit: float = 0.0, seed: int = 42, round_no: int = 1) -> DataFrame:
    """Samples that are not retired, and retired ones that a coin brings back."""
    return samples.filter(~F.col("retired") | (det.uniform(seed, "revisit", round_no, "id") < revisit))


def random_baseline(samples: DataFrame, n: int, seed: int = 42) -> DataFrame:
    u = det.uniform(seed, "baseline", 0, "id")
    return samples.withColumn("u", u).orderBy("u", "id").limit(n)
