"""Feedback: error intensity, running statistics, posterior and difficulty updates, retirement, evaluation."""

from __future__ import annotations

import subprocess
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec

TINY = vec.TINY


def clip01(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def error_intensity(signals: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean of the signals that a row has (weight above 0), within [0, 1]; null if it has none."""
    used = {k: (s, w) for k, (s, w) in {k: (s, weights.get(k, 0.0)) for k, s in signals.items()}.items() if w > 0}
    if not used:
        raise ValueError("no signal has a weight")
    top = sum((F.when(s.isNotNull(), s * F.lit(w)).otherwise(F.lit(0.0)) for s, w in used.values()), F.lit(0.0))
    bottom = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for s, w in used.values()), F.lit(0.0))
    return F.when(bottom > 0, clip01(top / bottom))


def running_stats(batches: DataFrame, momentum: float = 0.99, key: str | None = None) -> DataFrame:
    """(batch, mean, var) after each batch of (batch, value): the first replaces, later ones are blended in.

    The fold goes over one row per batch, in the order of batches.
    """
    keys = [key] if key else []
    per = batches.groupBy(*keys, "batch").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    folded = per.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("batch", "m", "v"))).alias("s"))
    blend = lambda old, new: F.lit(momentum) * old + F.lit(1 - momentum) * new

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        return F.concat(acc, F.array(F.struct(x["batch"].alias("batch"), F.coalesce(blend(last["mean"], x["m"]), x["m"]).alias("mean"), F.coalesce(blend(last["var"], x["v"]), x["v"]).alias("var"))))

    kind = batches.schema["batch"].dataType.simpleString()
    start = F.array().cast(f"array<struct<batch:{kind},mean:double,var:double>>")
    return folded.select(*keys, F.explode(F.aggregate("s", start, step)).alias("r")).select(*keys, "r.*")


def blended(losses: DataFrame, before: tuple[float, float] | None, momentum: float = 0.99) -> tuple[float, float]:
    """(mean, variance) after one more batch of (loss): the batch's own without a state before, else blended into that."""
    mean, var = losses.agg(F.avg("loss"), F.var_pop("loss")).first()
    if mean is None:
        return before or (0.0, 1.0)
    return (mean, var) if before is None else tuple(momentum * old + (1 - momentum) * new for old, new in zip(before, (mean, var), strict=True))


def zscore_errors(batches: DataFrame, momentum: float = 0.99, offset: float = 0.5) -> DataFrame:
    """Rows of (batch, ...) with ``error``: z-score by the running statistics that include the row's own batch."""
    stats = running_stats(batches, momentum)
    return batches.join(stats, "batch").withColumn("error", clip01((F.col("value") - F.col("mean")) / F.sqrt(F.col("var") + F.lit(TINY)) + F.lit(offset)))


def sigmoid_errors(batches: DataFrame, momentum: float = 0.99) -> DataFrame:
    stats = running_stats(batches, momentum)
    z = (F.col("value") - F.col("mean")) / F.sqrt(F.col("var") + F.lit(TINY))
    return batches.join(stats, "batch").withColumn("error", 1 / (1 + F.exp(-z)))


def minmax(x: str, group: Window, tiny: float = 0.0) -> Column:
    """Min-max within a group; 0 where it is constant."""
    low, high = F.min(x).over(group), F.max(x).over(group)
    return F.when(high == low, F.lit(0.0)).otherwise((F.col(x) - low) / (high - low + F.lit(tiny)))


def percentile(x: str, group: str, ident: str) -> Column:
    """Rank in the group as a share, ties by id."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    return (F.row_number().over(Window.partitionBy(group).orderBy(x, ident)) - 1) / (n - 1 + F.lit(TINY))


def batch_zscore(x: str, group: Window) -> Column:
    """z-score with the group's population deviation, plus a half; a half where it is constant."""
    sd = F.stddev_pop(x).over(group)
    return F.when(sd == 0, F.lit(0.5)).otherwise(clip01((F.col(x) - F.avg(x).over(group)) / sd + F.lit(0.5)))


NORMALISERS = {"zscore": zscore_errors, "sigmoid": sigmoid_errors}


def logit_losses(logits: Column, label: Column) -> tuple[Column, Column]:
    """(cross entropy, entropy of the softmax) of an array of logits."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    probabilities = F.transform(logits, lambda x: F.exp(x - top) / total)
    entropy = -F.aggregate(F.transform(probabilities, lambda p: p * F.ln(p + F.lit(TINY))), F.lit(0.0), lambda s, x: s + x)
    return F.ln(total) + top - F.get(logits, label), entropy


def cluster_errors(feedback: DataFrame, samples: DataFrame) -> DataFrame:
    """(cluster, n, mean_error, std_error, min_error, max_error, gain, loss) of feedback (id, error) on known samples."""
    known = feedback.join(samples.filter("cluster is not null").select("id", "cluster"), "id")
    return known.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"), F.stddev_pop("error").alias("std_error"), F.min("error").alias("min_error"), F.max("error").alias("max_error"), F.sum("error").alias("gain"), F.sum(1 - F.col("error")).alias("loss"))


def updated_posteriors(posteriors: DataFrame, errors: DataFrame) -> DataFrame:
    """alpha grows by the errors of a cluster, beta by what they lack to 1. ``errors`` is the result of ``cluster_errors``."""
    own = errors.select("cluster", "gain", "loss")
    return posteriors.join(own, "cluster", "left").select("cluster", (F.col("alpha") + F.coalesce("gain", F.lit(0.0))).alias("alpha"), (F.col("beta") + F.coalesce("loss", F.lit(0.0))).alias("beta"), *[c for c in posteriors.columns if c not in ("cluster", "alpha", "beta")])


def difficulty_step(old: Column, error: Column, eta: float = 0.7) -> Column:
    return F.coalesce(F.lit(eta) * old + F.lit(1 - eta) * error, old)


def difficulties(feedback: DataFrame, eta: float = 0.7, start: float = 0.5) -> DataFrame:
    """(id, difficulty) after all of (id, round, error), in the order of rounds.

    In closed form, so that no sample's history is collected: error k of n weighs (1 - eta) * eta ** (n - k), the start eta ** n.
    """
    last = Window.partitionBy("id").orderBy(F.col("round").desc())
    ranked = feedback.select("id", "error", (F.row_number().over(last) - 1).alias("_age"))
    terms = F.sum(F.col("error") * F.lit(1 - eta) * F.pow(F.lit(eta), F.col("_age").cast("double")))
    return ranked.groupBy("id").agg((terms + F.lit(start) * F.pow(F.lit(eta), F.count(F.lit(1)).cast("double"))).alias("difficulty"))


def retirement(feedback: DataFrame, threshold: float = 0.1, patience: int = 3) -> DataFrame:
    """Feedback (id, round, error) with ``streak`` of errors below the threshold and ``retired``, which stays once reached."""
    order = Window.partitionBy("id").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = feedback.withColumn("_low", (F.col("error") < threshold).cast("int")).withColumn("_island", F.sum(1 - F.col("_low")).over(order))
    inside = Window.partitionBy("id", "_island").orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("streak", F.sum("_low").over(inside))
    return df.withColumn("retired", F.max(F.col("streak") >= patience).over(order)).drop("_low", "_island")


def retirement_stats(samples: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    gone = F.count_if("retired")
    return samples.agg(n.alias("total"), gone.alias("retired"), (n - gone).alias("active"), F.when(n > 0, gone / n).otherwise(F.lit(0.0)).alias("rate"))


def unretired(samples: DataFrame, ids: DataFrame, reset_only: bool = False) -> DataFrame:
    """Clear the streaks of ``ids``, and bring them back unless ``reset_only``."""
    marked = samples.join(ids.select("id", F.lit(True).alias("_hit")), "id", "left")
    out = marked.withColumn("consecutive_low_error", F.when(F.col("_hit"), 0).otherwise(F.col("consecutive_low_error")))
    return (out if reset_only else out.withColumn("retired", F.when(F.col("_hit"), False).otherwise(F.col("retired")))).drop("_hit")


def test_errors(results: DataFrame) -> DataFrame:
    """(id, error): 1 - the share of passed tests of (id, passed); a half for samples without tests (passed null)."""
    n = F.count("passed")
    return results.groupBy("id").agg(F.when(n == 0, F.lit(0.5)).otherwise(1 - F.count_if("passed") / n).alias("error"))


def run_tests(samples: DataFrame, timeout: int = 5, allow_code: bool = False) -> DataFrame:
    """(id, passed) of running each test (id, code, input, call, expected) in a process of its own; a null ``expected`` only asks that the code runs.

    Runs untrusted code, so it must be asked for with ``allow_code``.
    """
    if not allow_code:
        raise PermissionError("running code of samples is off; pass allow_code=True")

    def run(frames):
        for frame in frames:
            passed = []
            for code, given, call, expected in zip(frame["code"], frame["input"], frame["call"], frame["expected"], strict=True):
                script = f"{code}\nresult = {call}\nprint(result)" if call else code
                try:
                    done = subprocess.run([sys.executable, "-I", "-c", script], input=given or "", capture_output=True, text=True, timeout=timeout)
                    passed.append(done.returncode == 0 and (expected is None or done.stdout.strip() == expected.strip()))
                except subprocess.TimeoutExpired:
                    passed.append(False)
            yield pd.DataFrame({"id": list(frame["id"]), "passed": passed})

    kind = samples.schema["id"].dataType.simpleString()
    return samples.select("id", "code", "input", "call", "expected").mapInPandas(run, f"id {kind}, passed boolean")


def accuracy(correct: Column) -> Column:
    """Aggregate: percent."""
    return F.avg(correct.cast("int")) * 100
