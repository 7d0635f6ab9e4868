"""Deterministic sampling: slices, apportionment, quotas, shards and derangements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import accumulated, numbered, selected, succeeded


def cell_slice(df: DataFrame, cell: list[str], order: list[str], per_cell: int, offset: int = 0) -> DataFrame:
    """``per_cell`` rows of each cell from ``offset`` on; a cell that has fewer raises an error."""
    own = Window.partitionBy(*cell)
    rows = df.withColumn("_rn", F.row_number().over(own.orderBy(*order))).withColumn("_n", F.count("*").over(own))
    checked = F.when(F.col("_n") >= offset + per_cell, F.col("_rn")).otherwise(F.raise_error(F.lit("a cell has too few rows")).cast("int"))
    return rows.withColumn("_rn", checked).where(F.col("_rn").between(offset + 1, offset + per_cell)).drop("_rn", "_n")


def round_robin(df: DataFrame, cell: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a deal that takes one row of each cell in turn, with ``turn``."""
    rows = df.withColumn("turn", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    return rows.orderBy("turn", *cell).limit(n)


def apportioned(df: DataFrame, weight: str, total: int, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``share``: whole shares of ``total`` in proportion to the weight; what is left goes to the largest
    remainders, ties to the earlier row.

    Sums are joined by family, and remainders are numbered by ranges, so a family may have any number of rows.
    """
    one = [*by, "_all"]
    rows = df.withColumn("_all", F.lit(1))
    exact = F.col(weight) * F.lit(float(total)) / F.col("_sum")
    same = lambda x, a, b: reduce(lambda p, q: p & q, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in x))
    sums = rows.groupBy(*one).agg(F.sum(weight).alias("_sum"))
    rows = rows.alias("r").join(sums.alias("s"), same(one, "r", "s")).select("r.*", "s._sum").withColumn("_exact", exact).withColumn("_floor", F.floor("_exact").cast("long")).withColumn("_rest", F.col("_exact") - F.col("_floor"))
    placed = numbered(rows, [F.col("_rest").desc(), *order], "_rank", tuple(one))
    floors = placed.groupBy(*one).agg(F.sum("_floor").alias("_floors"))
    both = placed.alias("r").join(floors.alias("s"), same(one, "r", "s")).select("r.*", "s._floors")
    return both.select(*df.columns, (F.col("_floor") + (F.col("_rank") <= F.lit(total) - F.col("_floors")).cast("long")).cast("long").alias("share"))


def keyed(prefix: str, *parts: Column) -> Column:
    """The order key of a deterministic draw."""
    return F.sha2(F.concat_ws("|", F.lit(prefix), *parts), 256)


def capped(df: DataFrame, stratum: str, task: str, rows: str, budget: int, prefix: str = "view-cap-v1") -> DataFrame:
    """Trajectories kept under a budget of rows, drawn in keyed order: the first of each stratum is reserved, then each
    stratum takes its share of the rest, in proportion to its rows, as the longest prefix that fits.

    Every trajectory has a row at least, so the prefix ends where the running sum passes the share. Below the budget all stay.
    Whole shares of the rest are apportioned by largest remainder with ties by stratum.
    """
    own = Window.partitionBy(stratum)
    keyed_rows = df.withColumn("_key", keyed(prefix, F.col(stratum), F.col(task).cast("string")))
    ordered = keyed_rows.withColumn("_rn", F.row_number().over(own.orderBy("_key")))
    sizes = ordered.groupBy(stratum).agg(F.sum(rows).alias("_total"), F.sum(F.when(F.col("_rn") == 1, F.col(rows))).alias("_reserved"))
    plan = sizes.withColumn("_all", F.sum("_total").over(Window.partitionBy())).withColumn("_rest", F.lit(budget) - F.sum("_reserved").over(Window.partitionBy()))
    exact = F.col("_rest") * F.col("_total") / F.col("_all")
    plan = plan.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.col("_rest") - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), stratum))
    plan = plan.withColumn("_share", F.col("_floor") + (rank <= left).cast("long")).select(stratum, "_share", "_all")
    used = F.sum(F.when(F.col("_rn") > 1, F.col(rows)).otherwise(0)).over(own.orderBy("_key").rowsBetween(Window.unboundedPreceding, 0))
    kept = ordered.withColumn("_used", used).join(plan, stratum).where((F.col("_all") <= budget) | (F.col("_rn") == 1) | (F.col("_used") <= F.col("_share")))
    return kept.select(*df.columns)


def deranged(df: DataFrame, order: Column, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``other``: the value of the next row in a keyed order, round in one cycle; a lone row gets its own."""
    return succeeded(df.withColumn("_order", order), ["_order"], value, "other", by).drop("_order")


def sharded(df: DataFrame, cell: list[str], order: list[str], size: int, samples: int) -> DataFrame:
    """Shards of ``size`` tasks in each cell: first and last task, number of tasks and of rollouts to come."""
    rows = df.withColumn("shard", F.floor((F.row_number().over(Window.partitionBy(*cell).orderBy(*order)) - 1) / size).cast("int"))
    return rows.groupBy(*cell, "shard").agg(F.min(order[0]).alias("first_task"), F.max(order[0]).alias("last_task"), F.count("*").alias("tasks"), (F.count("*") * samples).alias("expected"))


def order_statistic(df: DataFrame, value: str, alpha: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The value at place floor(alpha * n), counted from 0, of each family."""
    return selected(df, value, lambda n: F.least(F.floor(n * F.lit(alpha)), n - 1), by)


def error_budget(df: DataFrame, problem: str, order: list[str], is_error: Column, per_problem: int, budget: int) -> DataFrame:
    """Accepted rows in order: at most ``per_problem`` of a problem, and error rows only while their budget lasts. An error row
    over the problem's quota still spends budget."""
    rows = accumulated(df.withColumn("_error", is_error), order, "_spent", F.coalesce(F.col("_error"), F.lit(False)).cast("long"))
    open_rows = rows.where(~F.col("_error") | (F.col("_spent") <= budget))
    return open_rows.withColumn("_rn", F.row_number().over(Window.partitionBy(problem).orderBy(*order))).where(F.col("_rn") <= per_problem).drop("_error", "_spent", "_rn")
