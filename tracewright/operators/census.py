"""Counts by unit, group, cell and stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

from ..functions.structure import fault_group

#: Calls from which on an episode has run away, first characters of a final text that are compared.
RUNAWAY_CALLS, HEAD = 10, 200
#: The claim axes.
AXES = ("recovery", "orchestration", "h8")


def _share(test: Column) -> Column:
    return F.avg(F.coalesce(test, F.lit(False)).cast("int"))


def episode_summary(episodes: DataFrame, by: str = "tag") -> DataFrame:
    """(by, n, scored, accuracy, tool_use_rate, tool_error_rate, mean_turns, mean_calls).

    Columns: ok (null is not scored), n_calls, tool_error, n_turns. The accuracy's denominator is scored rows only.
    """
    return episodes.groupBy(by).agg(F.count("*").alias("n"), F.count("ok").alias("scored"), F.avg(F.col("ok").cast("int")).alias("accuracy"), _share(F.col("n_calls") > 0).alias("tool_use_rate"), _share(F.col("tool_error")).alias("tool_error_rate"), F.avg("n_turns").alias("mean_turns"), F.avg("n_calls").alias("mean_calls"))


def tag_summary(episodes: DataFrame, by: str = "tag") -> DataFrame:
    """(by, n, calls_mean, calls_max, runaway, no_box, rescored, corrections, tools_ok).

    Columns: ok, right (the outcome after rescoring), n_calls, final.
    """
    ok, right = F.coalesce("ok", F.lit(False)), F.coalesce("right", F.lit(False))
    no_box = ~ok & ~F.coalesce("final", F.lit("")).contains("boxed")
    return episodes.groupBy(by).agg(F.count("*").alias("n"), F.avg("n_calls").alias("calls_mean"), F.max("n_calls").alias("calls_max"), F.count_if(F.col("n_calls") > RUNAWAY_CALLS).alias("runaway"), F.count_if(no_box).alias("no_box"), F.count_if(right).alias("rescored"), F.count_if(right != ok).alias("corrections"), F.count_if(right & (F.col("n_calls") > 0)).alias("tools_ok"))


def reward_means(rollouts: DataFrame, rewards: str = "rewards", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, reward, n, mean): each reward of a map over the rows that have it."""
    each = rollouts.select(*by, F.explode(rewards).alias("reward", "value")).where("value is not null")
    return each.groupBy(*by, "reward").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def axis_rates(rollouts: DataFrame, candidate: str = "candidate", axis: str = "axis", success: str = "ok", axes: tuple[str, ...] = AXES, digits: int = 4) -> DataFrame:
    """One row a candidate: its rate on each axis, and their unweighted mean over the axes that it has, to ``digits``."""
    rates = rollouts.groupBy(candidate).pivot(axis, list(axes)).agg(F.avg(F.col(success).cast("int")))
    present = F.filter(F.array(*axes), lambda x: x.isNotNull())
    return rates.withColumn("combined", F.round(F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present), digits))


def finalists(rates: DataFrame, n: int = 2, size: str = "size", index: str = "index") -> DataFrame:
    """The best candidates: the highest mean, then the smaller file, then the earlier one. A top-k report."""
    return rates.orderBy(F.desc("combined"), size, index).limit(n)


def strata_census(episodes: DataFrame, declared: DataFrame, by: tuple[str, ...] = ("arm", "condition", "control", "split")) -> DataFrame:
    """(by, n, declared): every declared stratum with its episodes, 0 where it has none, and strata that nobody declared."""
    n = episodes.groupBy(*by).agg(F.count("*").alias("n"))
    both = declared.select(*by).distinct().withColumn("declared", F.lit(True)).join(n, list(by), "full_outer")
    return both.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("declared", F.lit(False)).alias("declared"))


def fault_census(faults: DataFrame, kind: str = "kind", groups: tuple[str, ...] = ("transient_or_rate_limit", "malformed", "wrong_unit")) -> DataFrame:
    """(fault_group, n): faults by group, groups without one included; classes that aren't registered are ``unregistered``."""
    n = faults.groupBy(F.coalesce(fault_group(F.col(kind)), F.lit("unregistered")).alias("fault_group")).agg(F.count("*").alias("n"))
    known = faults.sparkSession.createDataFrame([(g,) for g in groups], "fault_group string")
    return known.join(n, "fault_group", "full_outer").select("fault_group", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_census(df: DataFrame, by: str, cluster: str) -> DataFrame:
    """(by, clusters, largest): distinct clusters and the rows of the largest one."""
    n = df.groupBy(by, cluster).agg(F.count("*").alias("n"))
    return n.groupBy(by).agg(F.count("*").alias("clusters"), F.max("n").alias("largest"))


def rejections(records: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, n): the histogram of rejection reasons; accepted records are ``accepted``."""
    return records.groupBy(F.coalesce(reason, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def acceptance(records: DataFrame, by: str, reason: str = "reason", faulted: str = "faulted") -> DataFrame:
    """(by, seen, accepted, accepted_faulted) of every cell."""
    good = F.col(reason).isNull()
    return records.groupBy(by).agg(F.count("*").alias("seen"), F.count_if(good).alias("accepted"), F.count_if(good & F.col(faulted)).alias("accepted_faulted"))


def quota_misses(cells: DataFrame, quotas: DataFrame, by: str, measured_only: tuple[str, ...] = ()) -> DataFrame:
    """(by, quota, accepted, seen, short) of the cells that don't reach their quota; cells that are only measured owe nothing."""
    both = quotas.join(cells, by, "left").where(~F.col(by).isin(*measured_only) if measured_only else F.lit(True))
    both = both.select(by, "quota", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("seen", F.lit(0)).alias("seen"))
    return both.withColumn("short", F.greatest(F.col("quota") - F.col("accepted"), F.lit(0))).where("accepted < quota")


def recovery_rates(episodes: DataFrame, by: str) -> DataFrame:
    """(by, assigned, triggered, recovered, of_assigned, of_triggered); a rate over nothing is null.

    Columns: assigned, triggered, recovered (booleans, null is false).
    """
    assigned, fired = F.coalesce("assigned", F.lit(False)), F.coalesce("triggered", F.lit(False))
    done = fired & F.coalesce("recovered", F.lit(False))
    out = episodes.groupBy(by).agg(F.count_if(assigned).alias("assigned"), F.count_if(fired).alias("triggered"), F.count_if(done).alias("recovered"))
    return out.withColumn("of_assigned", F.try_divide("recovered", "assigned")).withColumn("of_triggered", F.try_divide("recovered", "triggered"))


def shortfall(strata: DataFrame, fallback: float) -> DataFrame:
    """(stratum, rows, kept, dropped, rows_lost): what dropped trajectories would have given, by their stratum's own rate, by the
    corpus' where it kept none, by ``fallback`` where nothing was kept at all. Halves are rounded to even. Strata that lost
    nothing aren't there.

    Columns: stratum, rows, kept, dropped. Two sums over all strata are joined, one row.
    """
    total = strata.agg(F.sum("rows").alias("_rows"), F.sum("kept").alias("_kept"))
    mean = F.when(F.col("_kept") > 0, F.col("_rows") / F.col("_kept")).otherwise(F.lit(fallback))
    rate = F.when(F.col("kept") > 0, F.col("rows") / F.col("kept")).otherwise(mean)
    own = strata.where("dropped > 0 or rows = 0").withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    return own.select("stratum", "rows", "kept", "dropped", F.bround(rate * F.col("dropped"), 0).cast("long").alias("rows_lost"))


def paired_difference(pairs: DataFrame, by: str, two: str = "ok_two", one: str = "ok_one") -> DataFrame:
    """(by, n, difference): how much more often the second arm of a pair succeeds; pairs without a group don't count."""
    return pairs.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(two).cast("int") - F.col(one).cast("int")).alias("difference"))


def producers(rows: DataFrame, fields: list[str], order: str) -> DataFrame:
    """(fields, first_seen, place): distinct producers in the order in which they are first seen.

    The place is numbered over distinct producers by ranges; a corpus should have one.
    """
    seen = rows.groupBy(*fields).agg(F.min(order).alias("first_seen"))
    return numbered(seen, ["first_seen", *fields], "place")


def require_one(producers: DataFrame, what: str) -> None:
    """Raises unless there is exactly one producer; no more than two rows come to the driver."""
    n = len(producers.limit(2).collect())
    if n != 1:
        raise ValueError(f"{what} has {'no producer' if n == 0 else 'more than one producer'}")


def ledger_seconds(ledger: DataFrame, by: str, seconds: str = "elapsed_s", minutes: str = "minutes") -> DataFrame:
    """(by, seconds): measured seconds, and the minutes of rows that have none."""
    return ledger.groupBy(by).agg(F.sum(F.coalesce(F.col(seconds), F.col(minutes) * 60.0, F.lit(0.0))).alias("seconds"))


def repeated_finals(episodes: DataFrame, by: str, final: str, head: int = HEAD, least: int = 10, most: float = 0.5) -> DataFrame:
    """(by, finals, same, share, collapsed): how many final texts begin alike, by their first ``head`` characters."""
    f = episodes.where(F.trim(final) != "").groupBy(by, F.left(final, F.lit(head)).alias("_head")).agg(F.count("*").alias("n"))
    out = f.groupBy(by).agg(F.sum("n").alias("finals"), F.max("n").alias("same"))
    share = F.col("same") / F.col("finals")
    return out.withColumn("share", share).withColumn("collapsed", (F.col("finals") >= least) & (share > most))


def unit_census(expected: DataFrame, written: DataFrame, unit: str, key: str) -> DataFrame:
    """(unit, expected, written, missing, coverage): expected ids of each unit against distinct written ones."""
    got = written.select(F.col(key).alias("_written")).distinct()
    both = expected.select(unit, key).join(got, F.col(key) == F.col("_written"), "left")
    n, k = F.count("*"), F.count("_written")
    return both.groupBy(unit).agg(n.alias("expected"), k.alias("written"), (n - k).alias("missing"), (k / n).alias("coverage"))


def work_census(blocks: DataFrame, conditions: DataFrame) -> DataFrame:
    """(condition, blocks, units): the table of work, one unit for each arm of each block in each condition that it has.

    blocks: block, arm, task_id, conditions array<string>. conditions: condition; those without work count 0.
    """
    each = blocks.select("block", "arm", "task_id", F.explode("conditions").alias("condition"))
    n = each.groupBy("condition").agg(F.count_distinct("block").alias("blocks"), F.count_distinct("block", "arm", "task_id").alias("units"))
    return conditions.join(n, "condition", "left").select("condition", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("units", F.lit(0)).alias("units"))


def tool_gaps(used: DataFrame, episode: str, tool: str, required: tuple[str, ...]) -> DataFrame:
    """(episode, missing, covered): required tools that an episode didn't use."""
    seen = used.groupBy(episode).agg(F.collect_set(F.when(F.col(tool).isin(*required), F.col(tool))).alias("_used"))
    gap = F.size(F.array_except(F.array(*map(F.lit, required)), "_used"))
    return seen.select(episode, gap.alias("missing"), (gap == 0).alias("covered"))


def interleaved(pairs: DataFrame, by: str, order: str, first_arm: Column, size: int) -> DataFrame:
    """``pairs`` with block and place: blocks of ``size`` rows of each group, in which the arm that goes first alternates."""
    block = F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / size)
    rows = pairs.withColumn("block", block)
    rank = F.when((F.col("block") % 2 == 0) == first_arm, 0).otherwise(1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by, "block").orderBy(rank, order)))


def call_ids(messages: DataFrame, episode: str, turn: str, is_call: Column) -> DataFrame:
    """``messages`` that make a call, with ``ordinal``: the running number of the episode's calls, from 1."""
    running = F.count_if(is_call).over(Window.partitionBy(episode).orderBy(turn))
    return messages.withColumn("ordinal", running).where(is_call)


def shared_keys(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """Keys that two knowledge bases share, once each."""
    return one.select(key).intersect(two.select(key))


def elapsed_since_open(sessions: DataFrame, ledger: DataFrame, session: str = "session_id") -> DataFrame:
    """(session, elapsed_s, charged_s, uncharged_s): what passed since a session was opened against what the ledger has of it.

    sessions: session_id, opened_at, closed_at (timestamps). ledger: session_id, elapsed_s.
    """
    charged = ledger.groupBy(session).agg(F.sum("elapsed_s").alias("charged_s"))
    passed = F.col("closed_at").cast("double") - F.col("opened_at").cast("double")
    both = sessions.join(charged, session, "left").select(session, passed.alias("elapsed_s"), F.coalesce("charged_s", F.lit(0.0)).alias("charged_s"))
    return both.withColumn("uncharged_s", F.greatest(F.col("elapsed_s") - F.col("charged_s"), F.lit(0.0)))
