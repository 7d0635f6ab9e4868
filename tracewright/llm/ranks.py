"""Global positions of rows by an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the rows without a key, by the leading bits of their tie.
NULL_BITS = 6


def range_bucket(df: DataFrame, key: str, buckets: int, tie: str | None = None) -> Column:
    """The range of ``key`` that a row falls in; rows without a key come first.

    Bounds are approximate quantiles, at most ``buckets - 1`` of them; what is computed by range doesn't depend on them.
    Rows without a key are dealt over 2^NULL_BITS ranges by ``tie``, a column of 64-bit hashes, in its order; without one
    they are all in the first range.
    """
    bounds = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)))) if buckets > 1 else []
    keyed = F.size(F.filter(F.lit([int(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    if tie is None:
        return F.when(F.col(key).isNull(), F.lit(0)).otherwise(keyed)
    top = (F.shiftright(F.col(tie), 64 - NULL_BITS) + (1 << (NULL_BITS - 1))).cast("int")
    return F.when(F.col(key).isNull(), top).otherwise(keyed + (1 << NULL_BITS))


def buckets_for(df: DataFrame, per_task: int = 4) -> int:
    return min(512, per_task * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_offsets(df: DataFrame, key: str, count: str, out: str, ties: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``df`` with ``out``, the sum of ``count`` over all rows before in the order of ``key`` (nulls first) and ``ties``.

    Also the sum over all rows. Sums by range come to the driver: one number for each of a bounded set of ranges. Rows
    without a key are dealt by the first tie, where there is one.
    """
    if ties:
        hashed = df.withColumn("_tie", F.when(F.col(key).isNull(), F.xxhash64(ties[0])))
        df = hashed.withColumn("_range", range_bucket(hashed, key, buckets_for(df), "_tie"))
        order = [F.col(key).asc_nulls_first(), F.col("_tie"), *ties]
    else:
        df = df.withColumn("_range", range_bucket(df, key, buckets_for(df)))
        order = [F.col(key).asc_nulls_first()]
    sums = {r["_range"]: r["total"] for r in df.groupBy("_range").agg(F.sum(count).alias("total")).collect()}
    before, total = [], 0
    for i in range(max(sums, default=-1) + 1):
        before.append(total)
        total += sums.get(i) or 0
    if not total and not before:
        return df.withColumn(out, F.lit(0).cast("long")).drop("_range", "_tie"), 0
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.element_at(F.lit(before), F.col("_range") + 1).cast("long")
    return df.withColumn(out, start + F.coalesce(F.sum(count).over(w), F.lit(0)).cast("long")).drop("_range", "_tie"), total
