"""Random numbers that follow from what they are for: hashes of seed, purpose, round and keys.

Rank by them, then by id, to choose without replacement; reruns and retries agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trials of the rejection sampler; the chance that none is accepted is below 1e-15.
TRIALS = 16


def uniform(seed: int, purpose: str, round_no: int | Column, *keys: Column | str) -> Column:
    """A number in [0, 1) with 52 random bits."""
    parts = [F.lit(str(seed)), F.lit(purpose), round_no if isinstance(round_no, Column) else F.lit(str(round_no))]
    text = F.concat_ws(":", *[p.cast("string") for p in parts], *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _gamma(shape: Column, seed: int, purpose: str, round_no: int | Column, key: Column) -> Column:
    """A Gamma(shape) draw, shape >= 1: Marsaglia and Tsang (2000), with normals by Box and Muller (1958)."""
    d = shape - F.lit(1 / 3)

    def trial(t: Column) -> Column:
        u = [(F.lit(0.5) + uniform(seed, purpose, round_no, key, t, F.lit(k)) * F.lit(float(1 << 52))) / F.lit(float(1 << 52)) for k in range(3)]
        x = F.sqrt(F.lit(-2.0) * F.ln(u[0])) * F.cos(F.lit(2 * math.pi) * u[1])
        v = F.pow(F.lit(1.0) + x / F.sqrt(F.lit(9.0) * d), F.lit(3.0))
        accepted = (v > 0) & (F.ln(u[2]) < x * x / 2 + d - d * v + d * F.ln(F.greatest(v, F.lit(1e-300))))
        return F.when(accepted, d * v)

    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(TRIALS - 1)), trial), lambda g: g.isNotNull()), F.lit(0))


def beta(alpha: Column, beta_: Column, seed: int, round_no: int | Column, key: Column) -> Column:
    """A Beta(alpha, beta) draw. Shapes below 1 are raised by one and brought back with a power of a uniform number."""

    def gamma(shape: Column, name: str) -> Column:
        raised = _gamma(F.when(shape < 1, shape + 1).otherwise(shape), seed, name, round_no, key)
        u = (F.lit(0.5) + uniform(seed, name + "-power", round_no, key) * F.lit(float(1 << 52))) / F.lit(float(1 << 52))
        return F.when(shape < 1, raised * F.pow(u, F.lit(1.0) / shape)).otherwise(raised)

    a, b = gamma(alpha, "beta-a"), gamma(beta_, "beta-b")
    return a / (a + b)
