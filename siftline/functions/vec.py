"""Vector arithmetic on ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """At unit length; the norm is at least TINY."""
    return F.transform(a, lambda x: x / F.greatest(norm(a), F.lit(TINY)))


def unit_plus(a: Column) -> Column:
    """At unit length, with TINY added to the norm."""
    return F.transform(a, lambda x: x / (norm(a) + F.lit(TINY)))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded as SQL engines do on doubles: half away from zero after scaling, and what rounds to zero keeps its sign."""
    scale = 10.0**digits
    return F.signum(x) * (F.round(F.abs(x) * F.lit(scale)) / F.lit(scale))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def mean_vector(a: Column) -> Column:
    """Aggregate: the mean vector of a group, summed in the JVM with partial sums before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(a)))
