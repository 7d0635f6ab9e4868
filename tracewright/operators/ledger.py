"""Ordered event ledgers: repeated calls, stalls, recoveries, guards and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def repeated_errors(df: DataFrame, episode: str, order: list[str], digest: str, error: Column, times: int = 3) -> DataFrame:
    """Episodes with ``times`` identical calls in a row that all expose an error, and the place of the first such run's end."""
    w = Window.partitionBy(episode).orderBy(*order)
    marked = df.withColumn("_e", error).withColumn("_at", F.row_number().over(w))
    same = F.col("_e")
    for i in range(1, times):
        same = same & F.coalesce((F.lag(digest, i).over(w) == F.col(digest)) & F.lag("_e", i).over(w), F.lit(False))
    return marked.withColumn("_run", same).where("_run").groupBy(episode).agg(F.min("_at").alias("first_at"), F.count("*").alias("runs"))


def stalled(df: DataFrame, episode: str, order: list[str], digest: str, least: int = 4) -> DataFrame:
    """Episodes with ``least`` or more results in a row that were all seen before, and the longest such run."""
    w = Window.partitionBy(episode).orderBy(*order)
    seen = df.withColumn("_seen", F.row_number().over(Window.partitionBy(episode, digest).orderBy(*order)) > 1)
    island = F.row_number().over(w) - F.sum(F.col("_seen").cast("int")).over(w)
    runs = seen.withColumn("_island", island).where("_seen").groupBy(episode, "_island").agg(F.count("*").alias("length"))
    return runs.where(F.col("length") >= least).groupBy(episode).agg(F.max("length").alias("longest"), F.count("*").alias("runs"))


def completed(df: DataFrame, episode: str, order: str, decision: str, node: str, plan: list[str]) -> DataFrame:
    """How many nodes of an ordered plan each episode completes: each after the one before, and on a later decision.

    The state is the number of nodes so far and the decision of the last; a fold over the episode's sorted events keeps it.
    """
    events = F.array_sort(F.collect_list(F.struct(order, decision, node)))
    start = F.struct(F.lit(0).alias("done"), F.lit(-1).cast("long").alias("last"))
    nodes = F.array(*map(F.lit, plan))

    def step(s: Column, e: Column) -> Column:
        fits = (F.try_element_at(nodes, s["done"] + 1) == e[node]) & (e[decision].cast("long") > s["last"])
        return F.when(F.coalesce(fits, F.lit(False)), F.struct((s["done"] + 1).alias("done"), e[decision].cast("long").alias("last"))).otherwise(s)

    state = F.aggregate("_events", start, step)
    return df.groupBy(episode).agg(events.alias("_events")).select(episode, state["done"].alias("completed"), (state["done"] == len(plan)).alias("whole"))


def recoveries(df: DataFrame, episode: str, order: str, fires: Column, recovers: Column) -> DataFrame:
    """Each episode's first fire and the first recovery after it, null where there is none."""
    first = df.where(fires).groupBy(episode).agg(F.min(order).alias("fired_at"))
    later = df.where(recovers).select(F.col(episode).alias("_ep"), F.col(order).alias("_at"))
    both = first.join(later, (F.col("_ep") == F.col(episode)) & (F.col("_at") > F.col("fired_at")), "left")
    return both.groupBy(episode, "fired_at").agg(F.min("_at").alias("recovered_at"))


def worst_reason(df: DataFrame, key: str, reason: str, precedence: list[str]) -> DataFrame:
    """The reason of each key that stands first in ``precedence``; unknown reasons come last, by name."""
    at = F.array_position(F.array(*map(F.lit, precedence)), F.col(reason))
    return df.groupBy(key).agg(F.min(F.struct(F.when(at > 0, at).otherwise(len(precedence) + 1).alias("at"), F.col(reason).alias("reason"))).alias("_w")).select(key, F.col("_w.reason").alias("reason"))


def duplicate_calls(df: DataFrame, episode: str, *identity: str) -> DataFrame:
    """Calls beyond the first of each identity."""
    return df.groupBy(episode, *identity).agg(F.count("*").alias("_n")).groupBy(episode).agg(F.sum(F.col("_n") - 1).alias("duplicates"), F.sum("_n").alias("calls"))


def clip_guard(df: DataFrame, run: str, order: list[str], value: str, window: int, threshold: float) -> DataFrame:
    """Rows with the mean of the last ``window`` values and whether it reaches the threshold; never before the window is full,
    and not at all at a threshold of 1 or more."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(-(window - 1), 0)
    full = F.count(value).over(w) == window
    mean = F.when(full, F.avg(value).over(w))
    return df.withColumn("rolling", mean).withColumn("abort", F.coalesce((F.col("rolling") >= threshold) & F.lit(threshold < 1), F.lit(False)))


def journal_state(df: DataFrame, journal: str, order: list[str], event: str, at: str) -> DataFrame:
    """One row a journal: when it was last opened, its last sign of life since then, and whether it was closed since then."""
    w = Window.partitionBy(journal).orderBy(*order)
    marked = df.withColumn("_open", F.sum((F.col(event) == "open").cast("int")).over(w))
    last = Window.partitionBy(journal)
    current = marked.withColumn("_last", F.max("_open").over(last)).where("_open = _last and _last > 0")
    return current.groupBy(journal).agg(F.min(F.when(F.col(event) == "open", F.col(at))).alias("opened_at"), F.max(at).alias("last_at"), F.bool_or(F.col(event) == "close").alias("closed"))
