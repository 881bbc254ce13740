"""Evaluators by name: from predictions, references and losses to errors between 0 (right) and 1 (wrong)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import feedback


def loss(df: DataFrame, batch: str = "batch") -> DataFrame:
    """``error`` from the column ``loss``: z-score within the batch, plus a half; a missing loss is an error of the caller."""
    if "loss" not in df.columns:
        raise ValueError("the loss evaluator needs losses")
    return df.withColumn("error", feedback.batch_zscore("loss", Window.partitionBy(batch)))


def math_exact_match(df: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """``error`` from ``prediction`` and ``reference``: 0 where their final answers agree."""
    return df.withColumn("error", text.math_error(F.col("prediction"), F.col("reference"), tolerance))


def containment(df: DataFrame) -> DataFrame:
    """``error`` from ``prediction`` and ``reference``: 0 where one contains the other."""
    return df.withColumn("error", F.when(text.contains_match(F.col("reference"), F.col("prediction")), 0.0).otherwise(1.0))


def code_test_exec(df: DataFrame, allow_code: bool = False, timeout: int = 5) -> DataFrame:
    """(id, error) of samples' tests, which run only if asked for."""
    return feedback.test_errors(feedback.run_tests(df, timeout, allow_code))


EVALUATORS: dict[str, Callable[..., DataFrame]] = {"loss": loss, "math_exact_match": math_exact_match, "containment": containment, "code_test_exec": code_test_exec}
