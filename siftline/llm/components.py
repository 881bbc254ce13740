"""Connected components of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One step over undirected (u, v) pairs; the result has u > v."""
    if large:
        around = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    around = durable(around)
    # The least neighbours are written before the join, so that both of its sides are exchanged and Spark can split a hub.
    least = durable(around.groupBy("u").agg(F.min("v").alias("m"))).select((F.col("u") + 0).alias("u"), F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id that links reach."""
    pairs = durable(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = None
    while True:  # a number of rounds that grows with the logarithm of the largest component
        pairs = durable(_star(_star(pairs, large=True), large=False))
        new = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    ids = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
