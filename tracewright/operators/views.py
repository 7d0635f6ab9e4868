"""Training views of trajectories: which turns become rows, what they carry, and whether the corpus is complete."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import committed
from ..functions.canon import row_id
from ..functions.draws import words
from ..functions.values import consumes, shows_error


def selected(messages: DataFrame, episode: str, turn: str, role: str, terminal_copies: int = 2) -> DataFrame:
    """(episode, turn, view, copy): the last assistant turn ``terminal_copies`` times and every earlier one once as a pivot."""
    w = Window.partitionBy(episode)
    turns = messages.where(F.col(role) == "assistant").withColumn("_last", F.max(turn).over(w))
    last = F.col(turn) == F.col("_last")
    rows = turns.select(episode, turn, F.when(last, "terminal").otherwise("pivot").alias("view"), F.explode(F.sequence(F.lit(1), F.when(last, F.lit(terminal_copies)).otherwise(F.lit(1)))).alias("copy"))
    return rows


def built(messages: DataFrame, chosen: DataFrame, episode: str, turn: str, role: str, text: str, budget: int, tokens: Column) -> DataFrame:
    """Views with their prompt (all turns before), completion, length and row id, in one table so that nothing is matched by
    position; a view over the token budget has ``kept`` false."""
    lines = messages.groupBy(episode).agg(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.concat_ws(": ", role, text).alias("line"), F.col(text).alias("text"), tokens.alias("n")))).alias("_lines"))
    # one array a conversation, of which each chosen turn takes what stands before it
    joined = chosen.join(lines, episode).withColumn("_at", F.array_position(F.transform("_lines", lambda x: x["turn"]), F.col(turn)).cast("int"))
    before = F.slice("_lines", F.lit(1), F.col("_at") - 1)
    own = F.get("_lines", F.col("_at") - 1)
    sums = F.aggregate(before, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["n"], F.lit(0)))
    out = joined.where("_at > 0").select(*chosen.columns, own["text"].alias("completion"), F.array_join(F.transform(before, lambda x: x["line"]), "\n").alias("prompt"), (sums + own["n"]).alias("n_tokens"))
    key = row_id(F.col(episode).cast("string"), F.col(turn).cast("string"), F.col("view"), F.col("copy").cast("string"))
    return out.withColumn("row_id", key).withColumn("kept", F.col("n_tokens") <= budget)


def stratum_report(views: DataFrame, stratum: str) -> DataFrame:
    """Views planned, kept and dropped by stratum, and the longest with its row (the first of equals)."""
    return views.groupBy(stratum).agg(F.count("*").alias("planned"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("dropped"), F.max("n_tokens").alias("longest"), F.max_by("row_id", F.struct("n_tokens", F.xxhash64("row_id"))).alias("longest_row"))


def cardinality_gaps(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Strata whose count isn't what is expected; one that isn't there counts 0. Empty means complete."""
    both = expected.join(counts, key, "full_outer")
    return both.select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("n", F.lit(0)).alias("n")).where("expected != n")


def mixed_producers(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Distinct producers of a corpus; more than one row is a violation."""
    return rows.groupBy(*fields).agg(F.count("*").alias("rows"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def pivot_draws(task: pd.Series, n: pd.Series) -> pd.Series:
    """Two places of 0..n-1 from the stream of a task; none where n is 0."""

    def one(t, k):
        seed = int(hashlib.sha256(f"pivot-seed|{t}".encode()).hexdigest()[:16], 16) >> 1
        return [int(x) % int(k) for x in words(seed, f"pivot|{t}", 2)] if k else []

    return pd.Series([one(*x) for x in zip(task, n, strict=True)], dtype=object)


def erring_turns(messages: DataFrame, records: DataFrame) -> DataFrame:
    """(episode, index): assistant turns whose calls failed, up to the next turn, other than by the injected fault.

    messages: episode, index, role, content. records: episode, result_index (of the fault's result, null without one).
    """
    before = Window.partitionBy("episode").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.max(F.when(F.col("role") == "assistant", F.col("index"))).over(before)
    failed = messages.withColumn("_turn", turn).where((F.col("role") == "tool") & shows_error(F.col("content"))).join(records.select("episode", "result_index"), "episode", "left")
    return failed.where(~F.col("index").eqNullSafe(F.col("result_index"))).where("_turn is not null").select("episode", F.col("_turn").alias("index")).distinct()


def planned(messages: DataFrame, records: DataFrame, terminal_copies: int = 2, recovery_copies: int = 2, two_decision_copies: int = 1, pivots: int = 1, pivots_long: int = 2, long: int = 8) -> DataFrame:
    """(episode, index, view, copies): the turns of accepted trajectories that become training rows.

    The last turn is ``terminal``; a trajectory whose last turn commits no answer has no views. After a fault that fired the
    first later turn is ``recovery``, and so is the certified one where that is another, with copies of its own. Of the other
    turns those are eligible that consume an earlier result and aren't followed by an error that wasn't injected; one of them, or
    two of a long task, is drawn by the task's key as ``pivot``.

    messages: episode, index, role, content, arguments (of the turn's calls, a text, null without calls). records: episode,
    task_id, horizon, fired, result_index, recovery_index. An episode's messages are a bounded ledger.
    """
    whole = Window.partitionBy("episode")
    before = whole.orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.array_join(F.collect_list(F.when(F.col("role") == "tool", F.coalesce("content", F.lit("")))).over(before), "\n")
    turns = messages.withColumn("_prior", prior).where("role = 'assistant'").withColumn("_last", F.max("index").over(whole))
    turns = turns.join(records, "episode").withColumn("_commits", F.max(F.when(F.col("index") == F.col("_last"), committed(F.coalesce("content", F.lit(""))))).over(whole)).where("_commits is not null")
    after = F.coalesce("fired", F.lit(False)) & (F.col("index") > F.col("result_index")) & (F.col("index") < F.col("_last"))
    turns = turns.withColumn("_first", F.min(F.when(after, F.col("index"))).over(whole)).withColumn("_certified", F.max(F.when(after & (F.col("index") == F.col("recovery_index")), F.col("index"))).over(whole))
    two = F.col("_certified").isNotNull() & (F.col("_certified") != F.col("_first"))
    recovers = F.coalesce((F.col("index") == F.col("_first")) | (two & (F.col("index") == F.col("_certified"))), F.lit(False))
    fixed = turns.withColumn("view", F.when(F.col("index") == F.col("_last"), "terminal").when(recovers, "recovery")).withColumn("copies", F.when(F.col("index") == F.col("_last"), terminal_copies).when(two, two_decision_copies).otherwise(recovery_copies))
    open_turns = fixed.where("view is null").join(erring_turns(messages, records), ["episode", "index"], "left_anti")
    eligible = open_turns.where(F.col("arguments").isNotNull() & consumes(F.col("_prior"), F.col("arguments")))
    lists = eligible.groupBy("episode", "task_id", "horizon").agg(F.array_sort(F.collect_list("index")).alias("_at"))
    drawn = lists.withColumn("_d", pivot_draws(F.col("task_id").cast("string"), F.size("_at")))
    one, other = F.get("_d", F.lit(0)), F.get("_d", F.lit(1))
    second = F.when(other == one, (other + 1) % F.size("_at")).otherwise(other)
    more = (F.when(F.col("horizon") >= long, pivots_long).otherwise(pivots) > 1) & (F.size("_at") > 1)
    places = F.when(more, F.array(F.get("_at", one), F.get("_at", second))).otherwise(F.array(F.get("_at", one)))
    pivot_rows = drawn.select("episode", F.explode(places).alias("index"), F.lit("pivot").alias("view"), F.lit(1).alias("copies"))
    return fixed.where("view is not null").select("episode", "index", "view", "copies").unionByName(pivot_rows)


def assigned_faults(specs: DataFrame) -> DataFrame:
    """(episode, fault): the planned faults as a trace has them: class, node and its place in the plan.

    specs: episode, nodes array<string>, faults array<struct<fault_type, target_node>>.
    """
    place = lambda f: F.array_position("nodes", f["target_node"]).cast("int") - 1
    return specs.select("episode", F.transform("faults", lambda f: F.struct(f["fault_type"].alias("class"), f["target_node"].alias("node"), F.when(place(f) >= 0, place(f)).alias("node_index"))).alias("fault"))
