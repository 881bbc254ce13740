"""The selection pipeline: offline preparation, then rounds of selection and feedback. All state is Parquet under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.text import rendered_text
from ..operators import clusters, compress, diversity, embedding, feedback, sampling
from ..sources import readers, sinks
from .config import preset


class SelectionPipeline:
    """``run_offline``, then ``run_online_round`` and ``update_feedback`` in turn; ``history`` has the rounds.

    The folder holds samples, embeddings, members, clusters, representatives, references, and one snapshot per round
    of posteriors and sample state; a new object on the same folder goes on where the last one stopped.
    """

    def __init__(self, spark: SparkSession, folder: str, config: dict | None = None):
        self.spark, self.folder, self.config = spark, folder, config or preset()

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name))
        return self._read(name)

    def run_offline(self, path: str | None = None, samples: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
        """Load (or take) samples, embed them (or take vectors id, v), cluster, score and compress; the table of clusters."""
        c = self.config
        if samples is None:
            samples = readers.load(self.spark, path or c["data"].get("path"), c["data"]["fields"], c["data"]["min_length"], c["data"]["max_length"])
        samples = self._write(readers.last_wins(samples.withColumn("_at", F.monotonically_increasing_id()), "id", "_at").drop("_at"), "samples")
        if vectors is None:
            text = rendered_text(c["data"]["template"], {f: F.col(f) for f in ("instruction", "input", "output")})
            stored = embedding.embed_missing(samples.select("id", text.alias("text")), self._path("embeddings"), embedding.make_encoder(c["embedding"]["encoder"], dim=c["embedding"]["dim"]))
            vectors = stored.select("id", F.col("embedding").cast("array<double>").alias("v"))
        if c["embedding"]["pca_dim"] or c["embedding"]["pca_variance"]:
            model = clusters.Reduction.fit(vectors, c["embedding"]["pca_dim"], c["embedding"]["pca_variance"])
            model.save(self.spark, self._path("reduction"))
            vectors = model.transform(vectors)
        vectors = self._write(vectors, "vectors")
        members = self._write(clusters.handle_noise(self._cluster(vectors), c["clustering"]["noise"]), "members")
        scored = clusters.prior_scores(clusters.cluster_metrics(members), c["prior"])
        table = self._write(scored, "clusters")
        reps, refs = compress.compress(members, c["compression"]["max_representatives"], c["compression"]["reference_size"], c["compression"]["algorithm"], c["seed"], c["compression"]["metric"] == "cosine")
        reps = self._write(reps, "representatives")
        self._write(refs, "references")
        t = c["thompson"]
        sinks.save_round(sampling.initial_posteriors(table, t["alpha0"], t["beta0"], t["strength"]), self._path("posteriors"), 0)
        state = members.select("id", "cluster").join(reps.select("id", F.lit(True).alias("is_representative")), "id", "left")
        sinks.save_round(sinks.with_sample_defaults(state), self._path("state"), 0)
        return table

    def _cluster(self, vectors: DataFrame) -> DataFrame:
        c = self.config["clustering"]
        if c["algorithm"] == "kmeans":
            return clusters.kmeans(vectors, c["k"], seed=self.config["seed"])[0]
        if vectors.count() <= c["threshold"]:
            return clusters.density_cluster(vectors, c["min_cluster_size"], c["min_samples"], c["method"], c["threshold"])
        return clusters.large_scale_cluster(vectors, c["pilot_rows"], c["min_cluster_size"], c["min_samples"], c["max_size"], c["target_size"], self.config["seed"])

    def reduced(self, vectors: DataFrame) -> DataFrame:
        """New vectors (id, v) in the dimensions of the stored ones."""
        if not sinks.exists(self.spark, self._path("reduction")):
            return vectors
        return clusters.Reduction.load(self.spark, self._path("reduction")).transform(vectors)

    def _snapshot(self, name: str) -> tuple[DataFrame, int]:
        at = self._read(name).agg(F.max("round")).first()[0]
        return sinks.load_round(self.spark, self._path(name), at).drop("round"), at

    def run_online_round(self, round_no: int) -> DataFrame:
        """Choose clusters, budgets and samples of a round: (id, cluster, priority, picked_by)."""
        c, p = self.config, self.config["priority"]
        posteriors, _ = self._snapshot("posteriors")
        state, _ = self._snapshot("state")
        n = sampling.n_to_select(posteriors.count(), ratio=c["thompson"]["ratio"])
        chosen = sampling.thompson_select(posteriors, n, round_no, c["seed"], c["thompson"]["warmup_rounds"])
        able = sampling.active(state.filter("is_representative"), c["retirement"]["revisit"], c["seed"], round_no)
        capacity = able.groupBy("cluster").agg(F.count(F.lit(1)).alias("capacity"))
        weighted = chosen.join(posteriors, "cluster").select("cluster", sampling.posterior_mean().alias("weight"), "visits").join(capacity, "cluster", "left").withColumn("capacity", F.coalesce("capacity", F.lit(0)))
        b = c["budget"]
        budgets = sampling.allocate_adaptive(weighted, b["total"]) if b["adaptive"] else sampling.allocate(weighted, b["total"], b["base_ratio"], b["max_ratio"])
        budgets = self._write(budgets.withColumnRenamed("alloc", "n"), f"budgets/round={round_no}")
        vectors = self._read("vectors")
        candidates = able.join(F.broadcast(budgets.select("cluster")), "cluster", "left_semi").select("id", "cluster", "difficulty").join(vectors, "id")
        references = self._read("references").join(F.broadcast(budgets.select("cluster")), "cluster", "left_semi").select("cluster", "id").join(vectors, "id")
        past = self._history_vectors(vectors, round_no)
        scored = candidates.select("id", "cluster", "difficulty").join(sampling.rarity(candidates, references, p["k"]).drop("cluster"), "id").join(sampling.novelty(candidates, past).drop("cluster"), "id")
        scored = scored.withColumn("priority", sampling.priority(F.col("difficulty"), F.col("rarity"), F.col("novelty"), p["c"], p["a"], p["b"]))
        picked = sampling.mixed_selection(scored, budgets, tuple(p["ratios"][:2]), c["seed"], round_no)
        picked = self._write(picked.select("id", "cluster", "priority", "rarity", "novelty", "picked_by"), f"selections/round={round_no}")
        visited = posteriors.join(F.broadcast(chosen.select("cluster", F.lit(1).alias("_v"))), "cluster", "left").withColumn("visits", F.col("visits") + F.coalesce("_v", F.lit(0))).drop("_v")
        sinks.save_round(visited, self._path("posteriors"), 2 * round_no - 1)
        spread = diversity.average_pairwise(picked.select("id").join(vectors, "id")).first()
        stats = picked.agg(F.lit(round_no).alias("round"), F.count(F.lit(1)).alias("n_selected"), F.countDistinct("cluster").alias("n_clusters_selected"))
        self._write(stats.withColumn("cluster_coverage", F.col("n_clusters_selected") / posteriors.count()).withColumn("diversity", F.lit(spread["diversity"] if spread else 0.0)).drop("round"), f"rounds/round={round_no}")
        return picked

    def _history_vectors(self, vectors: DataFrame, round_no: int) -> DataFrame:
        if not sinks.exists(self.spark, self._path("selections")):
            return vectors.limit(0)
        past = self._read("selections").filter(F.col("round") < round_no).select("id").distinct()
        return vectors.join(past, "id", "left_semi")

    def update_feedback(self, round_no: int, errors: DataFrame) -> DataFrame:
        """Take (id, error) of a round: posteriors, difficulties, streaks and retirement; the statistics per cluster.

        Every row counts for its cluster's posterior. A sample that is there several times takes one step, with its mean error.
        """
        r = self.config["retirement"]
        posteriors, _ = self._snapshot("posteriors")
        state, _ = self._snapshot("state")
        errors = self._write(errors.select("id", feedback.clip01(F.col("error")).alias("error")), f"feedback/round={round_no}").drop("round")
        stats = feedback.cluster_errors(errors, state)
        sinks.save_round(feedback.updated_posteriors(posteriors, stats), self._path("posteriors"), 2 * round_no)
        df = state.join(errors.groupBy("id").agg(F.avg("error").alias("error")), "id", "left")
        got, low = F.col("error").isNotNull(), F.col("error") < r["threshold"]
        streak = F.when(low, F.col("consecutive_low_error") + 1).when(got, 0).otherwise(F.col("consecutive_low_error"))
        df = df.withColumns({"difficulty": feedback.difficulty_step(F.col("difficulty"), F.col("error"), self.config["priority"]["eta"]), "consecutive_low_error": streak, "last_error_intensity": F.coalesce("error", "last_error_intensity"), "times_selected": F.col("times_selected") + got.cast("int")})
        sinks.save_round(df.withColumn("retired", F.col("retired") | (F.col("consecutive_low_error") >= r["patience"])).drop("error"), self._path("state"), round_no)
        return stats

    def update_losses(self, round_no: int, losses: DataFrame) -> DataFrame:
        """Feedback (id, loss): errors by the running mean and deviation of all rounds so far, which are kept with the state."""
        e = self.config["error"]
        before = None
        if sinks.exists(self.spark, self._path("running")):
            before = self._read("running").filter(F.col("round") < round_no).orderBy(F.desc("round")).first()
        after = feedback.blended(losses, None if before is None else (before["mean"], before["var"]), e["momentum"])
        kept = self.spark.createDataFrame([(float(after[0]), float(after[1]))], "mean double, var double")
        sinks.save_round(kept, self._path("running"), round_no)
        z = (F.col("loss") - F.lit(after[0])) / F.sqrt(F.lit(after[1]) + F.lit(vec.TINY)) + F.lit(e["offset"])
        return self.update_feedback(round_no, losses.select("id", feedback.clip01(z).alias("error")))

    def history(self) -> DataFrame:
        """One row per round, with its mean error once there is feedback."""
        rounds = self._read("rounds")
        if not sinks.exists(self.spark, self._path("feedback")):
            return rounds.withColumn("avg_error", F.lit(None).cast("double"))
        return rounds.join(self._read("feedback").groupBy("round").agg(F.avg("error").alias("avg_error")), "round", "left")

    def train(self, rounds: int, learn) -> DataFrame:
        """Rounds of selection and feedback; ``learn`` takes a selection and gives (id, error)."""
        for k in range(1, rounds + 1):
            self.update_feedback(k, learn(self.run_online_round(k)))
        return self.history()
