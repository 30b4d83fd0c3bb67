"""Statistics from built-in functions only: they stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0: a series of positive terms under 2, a continued fraction above."""
    term = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")),
        lambda a, k: F.struct((a["t"] * 2 * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"],
    )
    low = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * term
    tail = F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(0.0), lambda a, k: k / 2 / (x + a))
    high = F.exp(-x * x) / math.sqrt(math.pi) / (x + tail)
    return F.when(x < 2, low).otherwise(high)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Exact two-sided p of k of n at one half, k the smaller count: twice the lower tail, at most 1."""
    tail = F.aggregate(
        F.sequence(F.lit(0), k), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["t"] * (n - i) / (i + 1)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"],
    )
    return F.least(F.lit(1.0), 2 * tail * F.pow(F.lit(0.5), n))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval at 95 %; null for n = 0."""
    p, z2 = k / n, Z95 * Z95
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, mid - half), F.when(n > 0, mid + half)
