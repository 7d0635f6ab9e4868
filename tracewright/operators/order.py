"""A global order without one task that sees all rows: ranges of the order, sums by range, and offsets.

``repartitionByRange`` deals the rows, by all columns of the order, so that many rows of one leading value are several ranges.
The dealt rows are written once: a range keeps its rows whatever is lost later. What is computed doesn't depend on the bounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle


def _ranges(df: DataFrame, n: int | None) -> int:
    return n or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order]


def _same(groups: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in groups))


def ranged(df: DataFrame, order: list[str | Column], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: rows of a lower range come before all rows of a higher one; equal rows are in one range."""
    return settle(df.repartitionByRange(_ranges(df, ranges), *_columns(order)).withColumn("_range", F.spark_partition_id()), "ranged")


def accumulated(df: DataFrame, order: list[str | Column], out: str, value: Column | None = None, by: tuple[str, ...] = (), whole: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` (1 for each row without one) over a row and all before it in the order.

    ``order`` has to tell rows apart; nulls come first. With ``by`` the sum is that of each group, and ``whole`` names a
    column for the group's total. A window holds the rows of one group in one range, however large the group is.
    """
    groups = list(by) or ["_all"]
    rows = df.withColumn("_value", F.lit(1).cast("long") if value is None else value)
    rows = rows if by else rows.withColumn("_all", F.lit(1))
    rows = ranged(rows, [*(groups if by else []), *order], ranges)
    sums = rows.groupBy(*groups, "_range").agg(F.sum("_value").alias("_own"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*groups, "_range", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy(*groups)).alias("_whole"))
    sums = sums if by else F.broadcast(sums)  # one row a range
    w = Window.partitionBy(*groups, "_range").orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumn("_sum", F.sum("_value").over(w)).alias("rows").join(sums.alias("sums"), _same([*groups, "_range"], "rows", "sums"))
    more = [F.col("sums._whole").alias(whole)] if whole else []
    return both.select(*(F.col(f"rows.{c}") for c in df.columns), (F.col("rows._sum") + F.col("sums._before")).alias(out), *more)


def numbered(df: DataFrame, order: list[str | Column], out: str, by: tuple[str, ...] = (), whole: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the place of a row in the order, from 1 on."""
    return accumulated(df, order, out, None, by, whole, ranges)


def succeeded(df: DataFrame, order: list[str | Column], value: str, out: str, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: the value of the next row in the order, of the last row that of the first; a lone row's own.

    Rows are numbered by ranges, and each meets the one whose number is the next.
    """
    groups = list(by) or ["_all"]
    placed = settle(numbered(df if by else df.withColumn("_all", F.lit(1)), order, "_place", tuple(groups) if by else (), "_n", ranges), "placed")
    after = placed.select(*groups, F.when(F.col("_place") == 1, F.col("_n")).otherwise(F.col("_place") - 1).alias("_place"), F.col(value).alias(out))
    return placed.alias("a").join(after.alias("b"), _same([*groups, "_place"], "a", "b")).select(*(F.col(f"a.{c}") for c in df.columns), F.col(f"b.{out}"))


def selected(df: DataFrame, value: str, place, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """(by, statistic): of each group the value at ``place(n)``, counted from 0 in ascending order, n being its rows.

    Equal values are added up first, so many of one value are one row; the sums are cut at approximate quantiles, and of
    each group only the range that holds the place is sorted. Null values don't count; a group without a value has no row.
    """
    n = _ranges(df, ranges)
    groups = list(by) or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    counted = settle((rows if by else rows.withColumn("_all", F.lit(1))).groupBy(*groups, "_v").agg(F.count("*").alias("_c")), "counted")
    steps = [i / n for i in range(1, n)] or [0.5]
    bounds = counted.groupBy(*groups).agg(F.percentile_approx(F.col("_v").cast("double"), steps, 10 * n).alias("_bounds"), F.sum("_c").alias("_n"))
    cut = counted.alias("r").join(bounds.alias("b"), _same(groups, "r", "b")).select("r.*", "b._n", F.size(F.filter("b._bounds", lambda x: x < F.col("r._v").cast("double"))).alias("_range"))
    sums = cut.groupBy(*groups, "_range").agg(F.sum("_c").alias("_own"), F.max("_n").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).withColumn("_place", place(F.col("_n")).cast("long"))
    wanted = sums.where((F.col("_before") <= F.col("_place")) & (F.col("_place") < F.col("_before") + F.col("_own"))).select(*groups, "_range", "_before", "_place")
    inside = cut.alias("r").join(wanted.alias("b"), _same([*groups, "_range"], "r", "b")).select("r.*", "b._before", "b._place")
    up_to = F.col("_before") + F.sum("_c").over(Window.partitionBy(*groups).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_up", up_to).where(F.col("_up") > F.col("_place")).groupBy(*groups).agg(F.min("_v").alias("statistic")).select(*by, "statistic")
