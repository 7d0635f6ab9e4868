"""Interval estimates, tests and decision columns as plain column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The normal quantile of the intervals and of the power computation.
Z, Z_POWER = 1.959964, 0.841621


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column, Column]:
    """(rate, low, high) of the Wilson score interval; no trials give (0, 0, 1), rates of 0 and 1 have exact ends."""
    rate = F.when(n > 0, k / n).otherwise(F.lit(0.0))
    scale = 1 + z * z / n
    centre = (rate + z * z / (2 * n)) / scale
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / scale
    low = F.when(n <= 0, 0.0).when(k <= 0, 0.0).otherwise(F.least(rate, F.greatest(F.lit(0.0), centre - half)))
    high = F.when(n <= 0, 1.0).when(k >= n, 1.0).otherwise(F.greatest(rate, F.least(F.lit(1.0), centre + half)))
    return rate, low, high


def two_proportions(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """The pooled z of two rates; 0 where a side is empty or the spread is."""
    pool = (k1 + k2) / (n1 + n2)
    spread = F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    return F.when((n1 <= 0) | (n2 <= 0), 0.0).otherwise(F.when(spread == 0, 0.0).otherwise((k1 / n1 - k2 / n2) / spread))


@F.pandas_udf(T.DoubleType())
def two_sided_normal(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.StructType([T.StructField("two_sided", T.DoubleType()), T.StructField("one_sided", T.DoubleType())]))
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.DataFrame:
    """Exact tests of b against c discordant pairs at any size; one-sided is P[X >= c]."""

    def tests(b: int, c: int) -> tuple[float, float]:
        n = b + c
        if n == 0:
            return 1.0, 1.0
        total, at_least, tail, term = 1 << n, 0, 0, 1
        low = min(b, c)
        for i in range(n + 1):
            if i >= c:
                at_least += term
            if i <= low:
                tail += term
            term = term * (n - i) // (i + 1)
        return min(1.0, 2 * tail / total), at_least / total

    return pd.DataFrame([tests(int(x), int(y)) for x, y in zip(b, c, strict=True)], columns=["two_sided", "one_sided"])


def mcnemar_z(b: Column, c: Column) -> Column:
    """The z of discordant pairs, positive where the second arm wins; 0 without any."""
    return F.when(b + c > 0, (c - b) / F.sqrt((b + c).cast("double"))).otherwise(F.lit(0.0))


def detectable(n1: Column, n2: Column, rate: Column) -> Column:
    """The least difference of two unpaired rates that can be shown, at 5 % and 80 % power."""
    return F.when((n1 <= 0) | (n2 <= 0), 1.0).otherwise((Z + Z_POWER) * F.sqrt(2 * rate * (1 - rate) * (1 / n1 + 1 / n2) / 2))


def holm(df: DataFrame, p: str, by: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``p_holm``: the step-down p, monotone and at most 1; a missing p enters as 1. Ties go by ``order``."""
    ranked = Window.partitionBy(*by).orderBy(F.coalesce(p, F.lit(1.0)), *order)
    family = Window.partitionBy(*by)
    raw = (F.count(F.lit(1)).over(family) - F.row_number().over(ranked) + 1) * F.coalesce(p, F.lit(1.0))
    step = df.withColumn("_raw", raw).withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(ranked.rowsBetween(Window.unboundedPreceding, 0))))
    return step.drop("_raw")


def upper_gate(k: Column, n: Column, bound: float) -> Column:
    """PASS when the interval's upper end is within the bound, INCONCLUSIVE when no outcome at this n could be."""
    _, _, high = wilson(k, n)
    return F.when(n <= 0, "INCONCLUSIVE").when(high <= bound, "PASS").when(_zero_high(n) > bound, "INCONCLUSIVE").otherwise("FAIL")


def _zero_high(n: Column, z: float = Z) -> Column:
    """The upper end with no event in n."""
    return z * z / (n + z * z)


def lower_gate(k: Column, n: Column, bound: float) -> Column:
    """PASS when the interval's lower end reaches the bound, INCONCLUSIVE when even n of n could not."""
    _, low, _ = wilson(k, n)
    return F.when(n <= 0, "INCONCLUSIVE").when(low >= bound, "PASS").when(n / (n + Z * Z) < bound, "INCONCLUSIVE").otherwise("FAIL")


#: Statuses from the worst to the best.
SEVERITY = ("BUG", "FAIL", "INCONCLUSIVE", "PASS")


def severity(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), status)


def worst(df: DataFrame, by: str, status: str = "status") -> DataFrame:
    """One row a claim with its worst gate's status; a claim without gates has no row."""
    least = F.min(severity(F.col(status)))
    return df.groupBy(by).agg(F.element_at(F.array(*map(F.lit, SEVERITY)), least.cast("int")).alias("claim_status"))
