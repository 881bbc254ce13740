"""Clusters: nearest centroid, centroids, metrics, prior scores, noise, k-means, density clustering, subdivision.

Tables: vectors (id, v ARRAY<DOUBLE>), members (id, cluster, v) where cluster -1 is noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import det, vec

#: Bytes of centroids that may be sent to every task at once; more go in blocks.
MODEL_BYTES = 64 << 20
BLOCK = 4096


def _nearest_in(matrix: np.ndarray, ids: np.ndarray, rows: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """(id, cost) of the nearest row of ``matrix``; of equals the first."""
    if metric == "cosine":
        unit = lambda x: x / (np.linalg.norm(x, axis=1, keepdims=True) + vec.TINY)
        cost = 1.0 - unit(rows) @ unit(matrix).T
    else:
        cost = np.sqrt(np.maximum(((rows**2).sum(axis=1)[:, None] - 2 * rows @ matrix.T + (matrix**2).sum(axis=1)[None, :]), 0.0))
    best = cost.argmin(axis=1)
    return ids[best], cost[np.arange(len(rows)), best]


def nearest(df: DataFrame, centroids: DataFrame, metric: str = "euclidean") -> DataFrame:
    """``df`` (with v) plus ``cluster`` and ``distance`` of the nearest of ``centroids`` (cluster, centroid).

    The centroids are counted first. If they fit in MODEL_BYTES each task gets them all; else every row meets them block by
    block, by an equi-join on the number of the block, and keeps the least.
    """
    count, width = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if not count:
        return df.withColumns({"cluster": F.lit(None).cast("int"), "distance": F.lit(None).cast("double")})
    out = "cluster int, distance double"
    if count * width * 8 <= MODEL_BYTES:
        rows = sorted(centroids.select("cluster", "centroid").collect(), key=lambda r: r["cluster"])
        model = df.sparkSession.sparkContext.broadcast((np.array([r["centroid"] for r in rows]), np.array([r["cluster"] for r in rows])))

        @F.pandas_udf(out)
        def find(v: pd.Series) -> pd.DataFrame:
            matrix, ids = model.value
            cluster, cost = _nearest_in(matrix, ids, np.stack(v.to_numpy()), metric) if len(v) else ([], [])
            return pd.DataFrame({"cluster": np.asarray(cluster, np.int32), "distance": np.asarray(cost, float)})

        return df.withColumn("_n", find("v")).select(*df.columns, "_n.cluster", "_n.distance")
    blocks = -(-count // BLOCK)
    numbered = centroids.withColumn("_b", F.pmod(F.xxhash64("cluster"), F.lit(blocks)))
    packed = numbered.groupBy("_b").agg(F.sort_array(F.collect_list(F.struct("cluster", "centroid"))).alias("_c"))

    @F.pandas_udf(out)
    def find_in(v: pd.Series, c: pd.Series) -> pd.DataFrame:
        got = [_nearest_in(np.array([r["centroid"] for r in cs]), np.array([r["cluster"] for r in cs]), np.array([x]), metric) for x, cs in zip(v, c, strict=True)]
        return pd.DataFrame({"cluster": [int(g[0][0]) for g in got], "distance": [float(g[1][0]) for g in got]})

    each = df.withColumn("_row", F.monotonically_increasing_id()).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    found = each.join(packed, "_b").withColumn("_n", find_in("v", "_c"))
    best = found.groupBy("_row").agg(F.min(F.struct("_n.distance", "_n.cluster")).alias("_m"), *[F.first(c).alias(c) for c in df.columns])
    return best.select(*df.columns, F.col("_m.cluster").alias("cluster"), F.col("_m.distance").alias("distance"))


def centroids(members: DataFrame) -> DataFrame:
    """(cluster, size, centroid) of all clusters but noise."""
    return members.filter("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), vec.mean_vector(F.col("v")).alias("centroid"))


def cluster_metrics(members: DataFrame, label: str | None = None) -> DataFrame:
    """(cluster, size, centroid, variance, global_distance, isolation, label_entropy) of each cluster.

    variance: mean squared distance to the centroid; global_distance: 1 - cosine with the mean of all rows, noise
    included; isolation: 1 - the greatest cosine with another centroid (1 for a single one).
    """
    own = centroids(members)
    spread = members.filter("cluster >= 0").select("cluster", "v").join(own.select("cluster", "centroid"), "cluster").groupBy("cluster").agg(F.avg(vec.sqdist(F.col("v"), F.col("centroid"))).alias("variance"))
    everything = members.agg(vec.mean_vector(F.col("v")).alias("mean"))
    placed = own.join(spread, "cluster").crossJoin(F.broadcast(everything))  # one row
    centre = F.when((vec.norm(F.col("centroid")) > 0) & (vec.norm(F.col("mean")) > 0), 1 - vec.cosine(F.col("centroid"), F.col("mean"))).otherwise(F.lit(0.0))
    out = placed.withColumn("global_distance", centre).drop("mean").join(isolation(own), "cluster")
    if label:
        counts = members.filter("cluster >= 0").groupBy("cluster", label).agg(F.count(F.lit(1)).alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
        entropy = counts.withColumn("p", share).groupBy("cluster").agg(F.sum(-F.col("p") * F.ln("p")).alias("label_entropy"))
        return out.join(entropy, "cluster", "left")
    return out.withColumn("label_entropy", F.lit(0.0))


def isolation(own: DataFrame) -> DataFrame:
    """(cluster, isolation): every centroid against all others, block by block in numpy."""
    count, width = own.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    if (count or 0) * (width or 0) * 8 > MODEL_BYTES:
        pairs = own.select(F.col("cluster").alias("a"), F.col("centroid").alias("x")).join(own.select(F.col("cluster").alias("b"), F.col("centroid").alias("y")), F.col("a") != F.col("b"))
        return pairs.groupBy(F.col("a").alias("cluster")).agg((1 - F.max(vec.cosine(F.col("x"), F.col("y")))).alias("isolation"))
    rows = own.select("cluster", "centroid").collect()
    model = own.sparkSession.sparkContext.broadcast((np.array([r["cluster"] for r in rows]), np.array([r["centroid"] for r in rows], dtype=float)))

    @F.pandas_udf("double")
    def apart(cluster: pd.Series, centroid: pd.Series) -> pd.Series:
        ids, matrix = model.value
        length = np.linalg.norm(matrix, axis=1)
        out = []
        for c, x in zip(cluster, centroid, strict=True):
            n = np.linalg.norm(x)
            others = (ids != c) & (length > 0)
            out.append(1.0 if n == 0 or not others.any() else 1.0 - float((matrix[others] @ x / (length[others] * n)).max()))
        return pd.Series(out, dtype=float)

    return own.select("cluster", apart("cluster", "centroid").alias("isolation"))


METRICS = ("variance", "global_distance", "isolation", "label_entropy")


def normalised_metrics(metrics: DataFrame, columns: tuple[str, ...] = METRICS) -> DataFrame:
    """A column ``*_norm`` for each metric: min-max over the clusters, with TINY added to the range."""
    one = Window.partitionBy()  # one row per cluster
    return metrics.withColumns({f"{c}_norm": (F.col(c) - F.min(c).over(one)) / (F.max(c).over(one) - F.min(c).over(one) + F.lit(vec.TINY)) for c in columns})


def prior_scores(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``prior_score``: weighted sum of the normalised metrics; a missing one counts as 0."""
    weights = weights or dict.fromkeys(METRICS, 0.25)
    return normalised_metrics(metrics).withColumn("prior_score", sum((F.lit(float(w)) * F.coalesce(f"{c}_norm", F.lit(0.0)) for c, w in weights.items()), F.lit(0.0)))


def handle_noise(members: DataFrame, strategy: str = "nearest") -> DataFrame:
    """``drop`` keeps noise as -1; ``separate`` makes it one cluster of its own; ``nearest`` gives each to the nearest centroid."""
    marked = members.withColumn("is_noise", F.col("cluster") < 0)
    if strategy == "drop":
        return marked
    if strategy == "separate":
        top = members.agg(F.max("cluster")).first()[0]
        return marked.withColumn("cluster", F.when(F.col("is_noise"), F.lit((-1 if top is None else top) + 1)).otherwise(F.col("cluster")))
    if strategy != "nearest":
        raise ValueError(f"unknown noise strategy {strategy!r}")
    noise = nearest(marked.filter("is_noise").drop("cluster"), centroids(members)).drop("distance")
    return marked.filter("not is_noise").unionByName(noise.select(marked.columns))


def kmeans(vectors: DataFrame, k: int = 100, max_iter: int = 300, restarts: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(members, centroids) of the best of ``restarts`` k-means runs."""
    data = vectors.withColumn("features", array_to_vector("v"))
    models = [KMeans(k=k, maxIter=max_iter, seed=seed + r, featuresCol="features", predictionCol="cluster").fit(data) for r in range(restarts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    table = vectors.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    return model.transform(data).drop("features"), table


#: Rows of the largest density clustering: its work grows with their square, in blocks of DENSITY_BLOCK rows that tasks share; only the merging of the blocks' edges is one task.
DENSITY_ROWS = 50_000
DENSITY_BLOCK = 2048


def pilot_size(n: int, ratio: float = 0.02, low: int = 50_000, high: int = 500_000) -> int:
    return min(n, max(low, min(high, int(n * ratio))))


def pilot_ids(vectors: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(id) of ``size`` rows chosen by hash, which is computed once a row."""
    return vectors.select("id", det.uniform(seed, "pilot", 0, "id").alias("_u")).orderBy("_u", "id").limit(size).select("id")


def pilot(vectors: DataFrame, size: int, seed: int = 42, stratum: str | None = None) -> DataFrame:
    """``size`` rows chosen by hash; with a stratum, from each in proportion. The choice needs only ids; vectors are joined to it."""
    u = det.uniform(seed, "pilot", 0, "id")
    if stratum is None:
        return vectors.join(pilot_ids(vectors, size, seed), "id", "left_semi")
    ids = vectors.select("id", stratum)
    n, w = ids.count(), Window.partitionBy(stratum)
    ranked = ids.withColumn("_r", F.row_number().over(w.orderBy(u, "id"))).join(ids.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")), stratum)
    return vectors.join(ranked.filter(F.col("_r") <= F.ceil(F.col("_n") * F.lit(size / max(1, n)))).select("id"), "id", "left_semi")


def _distances(x: np.ndarray, y: np.ndarray, rows: int = 128) -> np.ndarray:
    """Every row of ``x`` against every row of ``y``, some rows at a time; what is within the rounding of the sums is 0."""
    size_x, size_y, out = (x**2).sum(axis=1), (y**2).sum(axis=1), np.empty((len(x), len(y)))
    for at in range(0, len(x), rows):
        square, size = out[at : at + rows], size_x[at : at + rows, None] + size_y
        np.matmul(x[at : at + rows], y.T, out=square)
        square *= -2
        square += size
        size *= x.shape[1] * np.finfo(float).eps
        square[square <= size] = 0
        np.sqrt(square, out=square)
    return out


def _nearer(kept: np.ndarray | None, found: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` least of each row so far."""
    least = lambda x: np.partition(x, k - 1, axis=1)[:, :k] if x.shape[1] > k else x
    return least(found).copy() if kept is None else least(np.concatenate([kept, least(found)], axis=1)).copy()


def _spanning_edges(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of a minimum spanning tree (Prim) between the rows and the columns of a table of weights."""
    a, b = weights.shape
    tables = (weights, np.ascontiguousarray(weights.T))
    # of the rows and of the columns what is not in the tree yet, all but the first row: their numbers, nearest members of the tree and distances
    left, source, best = [np.arange(1, a), np.arange(b)], [np.zeros(a - 1, np.int64), np.zeros(b, np.int64)], [np.full(a - 1, np.inf), weights[0].copy()]
    at, least = [0, int(best[1].argmin())], [np.inf, float(best[1].min())]
    rows, columns, found = [], [], []
    for _ in range(a + b - 1):
        side = 0 if least[0] < least[1] or not len(left[1]) else 1
        j, other = at[side], 1 - side
        new, old = int(left[side][j]), int(source[side][j])
        rows.append(old if side else new)
        columns.append(new if side else old)
        found.append(least[side])
        for x in (left, source, best):  # the last takes the place of what goes
            x[side][j] = x[side][-1]
            x[side] = x[side][:-1]
        reach = tables[side][new].take(left[other])
        closer = (reach < best[other]).nonzero()[0]
        if len(closer):
            best[other][closer] = reach[closer]
            source[other][closer] = new
        for z in (side, other) if len(closer) else (side,):
            if len(best[z]):
                at[z] = int(best[z].argmin())
                least[z] = float(best[z][at[z]])
            else:
                least[z] = np.inf
    return np.array(rows, np.int32), np.array(columns, np.int32), np.array(found)


def density_labels(x: np.ndarray, min_cluster_size: int = 50, min_samples: int = 10, method: str = "eom", block: int = DENSITY_BLOCK) -> np.ndarray:
    """HDBSCAN (Campello et al. 2013): core distances, mutual reachability, minimum spanning tree, condensed tree, excess of mass.

    The tree is that of the spanning trees between every two blocks of rows: each edge lies in one of these pairs, so what edges up to any weight
    connect, those of the trees connect too. Edges of equal weight leave at once, as the authors have it, so neither blocks nor the order of rows
    matter. Clusters are numbered by their first rows.
    """
    n = len(x)
    if n < 2:
        return np.full(n, -1)
    starts, k = range(0, n, block), min(min_samples, n - 1)
    core = np.empty(n)
    for i in starts:
        kept = None
        for j in starts:
            kept = _nearer(kept, _block_distances(x[i : i + block], x[j : j + block], i <= j), k + 1)
        core[i : i + block] = kept.max(axis=1)
    edges = [_block_edges(i, j, x[i : i + block], x[j : j + block], core[i : i + block], core[j : j + block]) for i in starts for j in starts if i <= j]
    return _labels(n, *(np.concatenate(e) for e in zip(*edges, strict=True)), min_cluster_size, method)


def _block_distances(x: np.ndarray, y: np.ndarray, in_order: bool) -> np.ndarray:
    """Distances of two blocks, always computed from the earlier one to the later, so that all tasks get the same bits."""
    return _distances(x, y) if in_order else _distances(y, x).T


def _block_edges(i: int, j: int, x: np.ndarray, y: np.ndarray, core_x: np.ndarray, core_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of mutual reachability between two blocks (or within one) whose first rows are ``i`` and ``j``."""
    reach = _distances(x, y)
    np.maximum(reach, core_x[:, None], out=reach)
    np.maximum(reach, core_y[None, :], out=reach)
    a, b, w = _spanning_edges(reach)
    return a + i, b + j, w


def _labels(n: int, left: np.ndarray, right: np.ndarray, weight: np.ndarray, min_cluster_size: int, method: str) -> np.ndarray:
    """Labels of ``n`` rows from edges that contain a minimum spanning tree of them."""
    order = np.argsort(weight, kind="stable")
    parent = list(range(2 * n - 1))
    size, children, height = [1] * n + [0] * (n - 1), {}, {}

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    new = n
    for a, b, d in zip(left[order].tolist(), right[order].tolist(), weight[order].tolist(), strict=True):
        a, b = root(a), root(b)
        if a == b:
            continue
        # what edges of one weight join is one node, with all its parts
        parts, more = (children[x] if x >= n and height[x] == d else [x] for x in (a, b))
        if len(parts) < len(more):
            parts, more = more, parts
        parts += more
        children[new], height[new], size[new] = parts, d, size[a] + size[b]
        parent[a] = parent[b] = new
        new += 1
        if new == 2 * n - 1:
            break

    def leaves(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            m = stack.pop()
            if m < n:
                out.append(m)
            else:
                stack += children[m]
        return out

    top = 2 * n - 2
    born, below, stability, members, kids = {0: 0.0}, {0: top}, {0: 0.0}, {0: []}, {0: []}
    todo, count = [(0, top)], 1
    while todo:
        c, node = todo.pop()
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            big = [m for m in children[node] if size[m] >= min_cluster_size]
            if len(big) > 1:
                stability[c] += size[node] * (lam - born[c])
                for m in big:
                    born[count], below[count], stability[count], members[count], kids[count] = lam, m, 0.0, [], []
                    kids[c].append(count)
                    todo.append((count, m))
                    count += 1
                break
            stability[c] += (size[node] - sum(size[m] for m in big)) * (lam - born[c])
            if not big:
                break
            node = big[0]
    chosen: dict[int, bool] = {}
    total = dict(stability)
    for c in range(count - 1, -1, -1):
        inner = sum(total[k] for k in kids[c])
        if method == "leaf":
            chosen[c] = not kids[c] and c != 0
        else:
            chosen[c] = c != 0 and (not kids[c] or stability[c] >= inner)
            total[c] = stability[c] if chosen[c] else inner
    labels, found, stack = np.full(n, -1), [], [0]
    while stack:
        c = stack.pop()
        if chosen[c]:
            found.append(leaves(below[c]))
        else:
            stack += kids[c]
    for number, rows in enumerate(sorted(found, key=min)):
        labels[rows] = number
    return labels


def density_cluster(vectors: DataFrame, min_cluster_size: int = 50, min_samples: int = 10, method: str = "eom", most: int = DENSITY_ROWS, block: int = DENSITY_BLOCK) -> DataFrame:
    """Members by density clustering of at most ``most`` rows (``density_labels``); larger tables go through ``large_scale_cluster``.

    Tasks share the pairs of blocks of rows. Core distances and labels, a number a row, pass through the driver.
    """
    count = vectors.count()
    if count > most:
        raise ValueError(f"{count} rows: cluster a pilot and assign the rest (large_scale_cluster)")
    spark = vectors.sparkSession
    numbered = vectors.select("id", "v").withColumn("_row", F.row_number().over(Window.orderBy("id", "v")) - 1)  # at most ``most`` rows
    if count < 2:
        return numbered.select("id", "v", F.lit(-1).alias("cluster"))
    parts, k = -(-count // block), min(min_samples, count - 1)

    def pack(rows: pa.Table) -> pa.Table:
        v = rows.sort_by("_row")["v"].combine_chunks()
        x = np.stack(np.split(v.flatten().to_numpy(zero_copy_only=False), v.offsets.to_numpy()[1:-1] - v.offsets[0].as_py()))
        return pa.table({"part": pa.array([rows["_part"][0].as_py()], pa.int32()), "x": pa.array([x.tobytes()], pa.binary()), "width": pa.array([x.shape[1]], pa.int32())})

    blocks = numbered.select("v", "_row", F.floor(F.col("_row") / block).cast("int").alias("_part")).groupBy("_part").applyInArrow(pack, "part int, x binary, width int").persist()
    width = blocks.agg(F.max("width")).first()[0]
    sent = F.broadcast if count * width * 8 <= MODEL_BYTES else lambda df: df

    def unpack(data: bytes) -> np.ndarray:
        return np.frombuffer(data).reshape(-1, width)

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, j, x, y in zip(frame["i"], frame["j"], frame["x"], frame["y"], strict=True):
                kept[i] = _nearer(kept.get(i), _block_distances(unpack(x), unpack(y), i <= j), k + 1)
        yield pd.DataFrame({"part": list(kept), "core": [x.max(axis=1).tobytes() for x in kept.values()]})

    def between(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                a, b, w = _block_edges(r.i * block, r.j * block, unpack(r.x), unpack(r.y), np.frombuffer(r.core_x), np.frombuffer(r.core_y))
                yield pd.DataFrame({"a": a, "b": b, "w": w})

    def label(edges: pd.DataFrame) -> pd.DataFrame:
        labels = _labels(count, edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy(), min_cluster_size, method)
        return pd.DataFrame({"_row": np.arange(count, dtype=np.int32), "cluster": labels.astype(np.int32)})

    first = spark.range(0, parts, 1, parts).select(F.col("id").cast("int").alias("i")).join(sent(blocks.select(F.col("part").alias("i"), "x")), "i")
    each = first.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(sent(blocks.select(F.col("part").alias("j"), F.col("x").alias("y"))), "j")
    gathered = each if sent is F.broadcast else each.repartition(parts, "i")
    cores = gathered.select("i", "j", "x", "y").mapInPandas(near, "part int, core binary").collect()
    with_core = blocks.drop("width").join(F.broadcast(spark.createDataFrame(cores, "part int, core binary")), "part")
    pairs = spark.range(0, parts * parts, 1, parts * parts).select(F.floor(F.col("id") / parts).cast("int").alias("i"), (F.col("id") % parts).cast("int").alias("j")).filter("i <= j")
    for c, x in (("i", "x"), ("j", "y")):
        pairs = pairs.join(sent(with_core.select(F.col("part").alias(c), F.col("x").alias(x), F.col("core").alias(f"core_{x}"))), c)
    if sent is not F.broadcast:
        pairs = pairs.repartition(parts * parts, "i", "j")
    edges = pairs.mapInPandas(between, "a int, b int, w double")
    labels = edges.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(label, "_row int, cluster int").collect()
    blocks.unpersist()
    return numbered.join(F.broadcast(spark.createDataFrame(labels, "_row int, cluster int")), "_row").select("id", "v", "cluster")


def large_scale_cluster(vectors: DataFrame, pilot_rows: int | None = None, min_cluster_size: int = 50, min_samples: int = 10, max_size: int | None = None, target_size: int | None = None, seed: int = 42) -> DataFrame:
    """Density clusters of a pilot, whose rows keep their labels, noise included; every other row joins the nearest centroid by cosine; too large clusters are divided.

    ``pilot_rows`` is ``pilot_size`` of the table unless given, and ``DENSITY_ROWS`` at most.
    """
    size = pilot_rows or min(DENSITY_ROWS, pilot_size(vectors.count()))
    found = pilot_ids(vectors, min(size, DENSITY_ROWS + 1), seed)  # the ids pass through the driver, so that the table is ordered once
    chosen = F.broadcast(vectors.sparkSession.createDataFrame(found.collect(), found.schema))
    seeds = density_cluster(vectors.join(chosen, "id", "left_semi"), min_cluster_size, min_samples)
    rest = vectors.join(chosen, "id", "left_anti")
    members = seeds.select("id", "v", "cluster").unionByName(nearest(rest, centroids(seeds), "cosine").select("id", "v", F.coalesce("cluster", F.lit(-1)).alias("cluster")))
    return subdivide(members, max_size, target_size or max_size // 2, seed) if max_size else members


def subdivide(members: DataFrame, max_size: int, target_size: int, seed: int = 42, rounds: int = 20, sample: int = 20_000) -> DataFrame:
    """Clusters above ``max_size`` in max(2, size // target) parts by k-means, fitted on ``sample`` rows of each, to which all rows are assigned; part 0 keeps the label, others get new ones."""
    sizes = members.filter("cluster >= 0").groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > max_size)
    large = sizes.withColumn("parts", F.greatest(F.lit(2), F.floor(F.col("size") / target_size)).cast("int"))
    top = members.agg(F.max("cluster")).first()[0] or 0

    def centres(rows: pd.DataFrame) -> pd.DataFrame:
        x, k = np.stack(rows.sort_values("id")["v"].to_numpy()), int(rows["parts"].iloc[0])
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            own = ((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1)[None]).argmin(1)
            c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        return pd.DataFrame({"cluster": rows["cluster"].iloc[0], "part": range(len(c)), "centre": list(c)})

    w = Window.partitionBy("cluster").orderBy(det.uniform(seed, "subdivide", 0, "id"), "id")
    some = members.join(large, "cluster").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample).select("id", "cluster", "v", "parts")
    found = some.groupBy("cluster").applyInPandas(centres, "cluster int, part int, centre array<double>")
    packed = found.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("part", "centre"))).alias("centres"))
    new = found.filter("part > 0").select("cluster", "part", (F.row_number().over(Window.orderBy("cluster", "part")) + F.lit(top)).alias("label"))
    best = F.array_min(F.transform("centres", lambda c: F.struct(vec.sqdist(F.col("v"), c["centre"]).alias("d"), c["part"].alias("part"))))["part"]
    placed = members.join(packed, "cluster", "left").withColumn("part", F.coalesce(best, F.lit(0))).drop("centres")
    return placed.join(F.broadcast(new), ["cluster", "part"], "left").withColumn("cluster", F.coalesce("label", "cluster").cast("int")).drop("part", "label")


class Reduction:
    """Centred principal components: ``components`` (k rows), the ``mean`` that is taken off, and the ``share`` of the variance of each."""

    def __init__(self, mean: list[float], components: list[list[float]], share: list[float]):
        self.mean, self.components, self.share = mean, components, share

    @classmethod
    def fit(cls, vectors: DataFrame, k: int | None = None, variance: float | None = None) -> Reduction:
        """``k`` components, or as many as explain ``variance`` (0.95 if neither is given)."""
        from pyspark.ml.feature import PCA, StandardScaler

        width = len(vectors.select("v").first()[0])
        data = vectors.select(array_to_vector("v").alias("raw"))
        scaler = StandardScaler(inputCol="raw", outputCol="centred", withMean=True, withStd=False).fit(data)
        model = PCA(k=min(k, width) if k else width, inputCol="centred", outputCol="reduced").fit(scaler.transform(data))
        share = model.explainedVariance.toArray()
        keep = len(share) if k else min(len(share), int(np.searchsorted(np.cumsum(share), (variance or 0.95) - 1e-12) + 1))
        return cls(scaler.mean.toArray().tolist(), model.pc.toArray().T[:keep].tolist(), share[:keep].tolist())

    def transform(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with v in the components; any vectors of the same width."""
        model = vectors.sparkSession.sparkContext.broadcast((np.array(self.mean), np.array(self.components)))  # width x k numbers

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            mean, components = model.value
            return pd.Series(list((np.stack(v.to_numpy()) - mean) @ components.T)) if len(v) else pd.Series([], dtype=object)

        return vectors.withColumn("v", project("v"))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.mean, self.components, self.share)], "mean array<double>, components array<array<double>>, share array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Reduction:
        row = spark.read.parquet(path).first()
        return cls(list(row["mean"]), [list(c) for c in row["components"]], list(row["share"]))


def reduce_dimensions(vectors: DataFrame, k: int | None = None, variance: float | None = None) -> tuple[DataFrame, list[float]]:
    """(vectors, explained variance) of a reduction that is not kept."""
    model = Reduction.fit(vectors, k, variance)
    return model.transform(vectors), model.share


def cluster_of(column: str | Column) -> Column:
    """A label column as cluster ids (null: noise)."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(-1)).cast("int")
