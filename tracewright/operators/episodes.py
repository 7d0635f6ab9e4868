"""Episodes: last record wins, pairing of arms, group statistics, missing and superfluous work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(df: DataFrame, index: str, *order: str) -> DataFrame:
    """The last row of each index by ``order``, with ``dropped``: how many earlier ones went. Rows without an index all stay."""
    own = Window.partitionBy(index)
    ranked = df.where(F.col(index).isNotNull()).withColumn("_rn", F.row_number().over(own.orderBy(*(F.col(c).desc() for c in order)))).withColumn("dropped", F.count("*").over(own) - 1)
    return ranked.where("_rn = 1").drop("_rn").unionByName(df.where(F.col(index).isNull()).withColumn("dropped", F.lit(0).cast("long")))


def paired(one: DataFrame, two: DataFrame, key: str, success: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Inner join of two arms by ``key``: ok_one, ok_two and the left arm's ``keep`` columns."""
    left = one.select(key, F.col(success).alias("ok_one"), *keep)
    return left.join(two.select(key, F.col(success).alias("ok_two")), key)


def discordant(pairs: DataFrame, *by: str) -> DataFrame:
    """n pairs, successes of each arm, and pairs that only the first (b) or only the second (c) arm solved."""
    count = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    one, two = F.col("ok_one"), F.col("ok_two")
    return pairs.groupBy(*by).agg(F.count("*").alias("n"), count(one, "k_one"), count(two, "k_two"), count(one & ~two, "b"), count(~one & two, "c"))


def group_stats(df: DataFrame, key: str, reward: str, success: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a group: size, mean and sample deviation of the reward (0 below two rows), whether it varies, and whether the
    outcomes disagree. Variation is asked of the extremes, so rounding can't make a constant reward vary."""
    return df.groupBy(key, *carry).agg(
        F.count("*").alias("n"),
        F.avg(reward).alias("mean_reward"),
        F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("sd_reward"),
        (F.max(reward) != F.min(reward)).alias("varies"),
        (F.bool_or(success) & ~F.bool_and(success)).alias("disagree"),
        F.sum(F.col(success).cast("long")).alias("successes"),
    )


def group_report(groups: DataFrame, outer: str, inner: str) -> DataFrame:
    """Fractions of groups by (outer, inner), by outer and over all; the mean success is weighted by group size."""
    return groups.groupingSets([[outer, inner], [outer], []], outer, inner).agg(
        F.count("*").alias("n_groups"),
        F.avg(F.col("varies").cast("int")).alias("varying"),
        F.avg(F.col("disagree").cast("int")).alias("disagreeing"),
        (F.sum("successes") / F.sum("n")).alias("mean_success"),
    )


def unassigned(assigned: DataFrame, traced: DataFrame, key: str) -> DataFrame:
    """Assigned rows without a trace."""
    return assigned.join(traced.select(key).distinct(), key, "left_anti")


def one_sided(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, with ``side``."""
    a, b = one.select(key).distinct().withColumn("in_one", F.lit(True)), two.select(key).distinct().withColumn("in_two", F.lit(True))
    return a.join(b, key, "full_outer").where("in_one is null or in_two is null").select(key, F.when(F.col("in_one"), "one").otherwise("two").alias("side"))


def differing(one: DataFrame, two: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Keys of both tables with the fields that differ; null equals null."""
    b = two.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    gaps = F.filter(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)), lambda x: x.isNotNull())
    return one.select(key, *fields).join(b, key).select(key, gaps.alias("fields")).where(F.size("fields") > 0)


def rollout_gaps(observed: DataFrame, tasks: DataFrame, key: str, sample: str, k: int) -> DataFrame:
    """Planned (task, 1..k) against observed rows: missing, extra and duplicate ones."""
    planned = tasks.select(key, F.explode(F.sequence(F.lit(1), F.lit(k))).alias(sample))
    seen = observed.groupBy(key, sample).agg(F.count("*").alias("seen"))
    both = planned.withColumn("planned", F.lit(True)).join(seen, [key, sample], "full_outer")
    kind = F.when(F.col("seen").isNull(), "missing").when(F.col("planned").isNull(), "extra").when(F.col("seen") > 1, "duplicate")
    return both.select(key, sample, kind.alias("kind")).where("kind is not null")


def best_of(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by ``order``, with the number of others."""
    own = Window.partitionBy(key)
    return df.withColumn("_rn", F.row_number().over(own.orderBy(*order))).withColumn("others", F.count("*").over(own) - 1).where("_rn = 1").drop("_rn")


def filled(df: DataFrame, specs: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with null or empty ``fields`` taken from ``specs``."""
    rest = [c for c in df.columns if c not in fields]
    s = specs.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return df.join(s, key, "left").select(*rest, *(F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}")).alias(f) for f in fields))
