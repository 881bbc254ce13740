"""Feedback as a stream: posteriors and retirement as keyed state, and windows over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_posteriors(feedback: DataFrame, alpha0: float = 1.0, beta0: float = 1.0) -> DataFrame:
    """(cluster, alpha, beta) of a stream of (cluster, error), updated with every micro-batch. Sums need no custom state."""
    return feedback.groupBy("cluster").agg((F.lit(alpha0) + F.sum("error")).alias("alpha"), (F.lit(beta0) + F.sum(1 - F.col("error"))).alias("beta"))


def stream_retirement(feedback: DataFrame, threshold: float = 0.1, patience: int = 3) -> DataFrame:
    """(id, streak, retired, n) of a stream of (id, round, error): state per sample, in the order of rounds within a micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, retired, n = state.get if state.exists else (0, False, 0)
        rows = pd.concat(list(frames)).sort_values("round", kind="stable")
        for error in rows["error"]:
            streak = streak + 1 if error < threshold else 0
            retired, n = retired or streak >= patience, n + 1
        state.update((streak, retired, n))
        yield pd.DataFrame({"id": [key[0]], "streak": [streak], "retired": [retired], "n": [n]})

    kind = feedback.schema["id"].dataType.simpleString()
    return feedback.groupBy("id").applyInPandasWithState(step, f"id {kind}, streak long, retired boolean, n long", "streak long, retired boolean, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_feedback(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, mean) per window of event time; ``events`` has ts (a timestamp), event_type, value."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
