"""Leakage between splits: values of a kind that more than one split has, and violations of identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Kinds of keys that no two splits may share, with the column that holds them.
KINDS = {"task_id": "task_id", "kb_namespace": "kb_namespace", "template": "template_id", "template_hash": "template_hash", "graph_signature": "graph_signature"}


def suite_keys(specs: DataFrame, split: str = "split") -> DataFrame:
    """(split, kind, value): every key of a suite's tasks that may not cross splits: five columns, and each record key.

    specs: split, the columns of KINDS (one that is missing or null has no key), kb, a map by record key. Each key once.
    """
    known = {kind: name for kind, name in KINDS.items() if name in specs.columns}
    own = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("value")) for kind, name in known.items()))
    records = F.transform(F.coalesce(F.map_keys("kb"), F.array().cast("array<string>")), lambda k: F.struct(F.lit("kb_key").alias("kind"), k.cast("string").alias("value"))) if "kb" in specs.columns else F.array().cast("array<struct<kind:string,value:string>>")
    keys = specs.select(split, F.explode(F.concat(own, records)).alias("key")).select(split, "key.kind", "key.value")
    return keys.where("value is not null").distinct()


def crossings(keys: DataFrame, kind: str, value: str, split: str, examples: int = 5) -> DataFrame:
    """(kind, split_a, split_b, n, examples): values that two splits share, with the first few as examples.

    Each value comes down to its set of splits first, so the pairs are made from sets of splits and not from rows; examples are
    the first by rank within a pair, of which each task keeps its own few before they meet.
    """
    held = keys.select(kind, value, split).distinct().groupBy(kind, value).agg(F.sort_array(F.collect_set(split)).alias("_s")).where(F.size("_s") > 1)
    pairs = F.flatten(F.transform("_s", lambda a, i: F.transform(F.slice("_s", i + 2, F.size("_s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    each = held.select(F.col(kind), F.col(value).cast("string").alias("_v"), F.explode(pairs).alias("_p")).select(kind, F.col("_p.a").alias("split_a"), F.col("_p.b").alias("split_b"), "_v")
    pair = [kind, "split_a", "split_b"]
    firsts = each.withColumn("_rank", F.row_number().over(Window.partitionBy(*pair).orderBy("_v"))).where(F.col("_rank") <= examples)
    shown = firsts.groupBy(*pair).agg(F.sort_array(F.collect_list("_v")).alias("examples"))
    return each.groupBy(*pair).agg(F.count("*").alias("n")).join(shown, pair)


def within_duplicates(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values that a group has more than once."""
    return df.groupBy(group, value).agg(F.count("*").alias("n")).where("n > 1")


def not_unique(df: DataFrame, key: str) -> DataFrame:
    """Keys of more than one row: empty when the key is one."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def set_difference(one: DataFrame, two: DataFrame, column: str) -> DataFrame:
    """Values that are listed and not permitted, or permitted and not listed."""
    a, b = one.select(column), two.select(column)
    return a.exceptAll(b).withColumn("side", F.lit("listed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("permitted")))
