"""The registered gates, launch floors, eligibility of training cells and budgets, each as a table of statuses.

Episodes are one table: arm, condition (clean, faulted), control, task_id, family, horizon, split, cluster, pattern_id,
all_tools, fault_class, certified, recovered, orchestrated, runaway, hallucinated, n_calls, termination. Flags that are null
count as false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.structure import fault_group
from ..functions.values import stalled_or_crashed
from .shared import settle

#: The registered thresholds.
REGISTERED = {
    "core": ("main",), "mt": ("mt",), "h8": ("h8",),
    "er1_pairs": 500, "er2_margin": 0.05, "er3_low": 0.60, "er4_margin": -0.03, "er5_pairs": 900, "er5_least": 0.0, "er6_high": 0.03, "er7_high": 0.01,
    "er8_groups": ("transient_or_rate_limit", "malformed", "wrong_unit"), "er8_each": 400, "er8_least": -0.05,
    "mt_horizon": 4, "mt1_pairs": 600, "mt1_margin": 0.05, "mt2_low": 0.60, "mt3_calls": 4 + 2, "mt4_runaway": 0.03, "mt4_hallucinated": 0.01, "mt5_patterns": 6, "mt5_each": 80, "mt5_least": -0.05,
    "hr_horizon": 8, "hr_families": ("lookup_chain", "typed_relay"), "hr1_pairs": 400, "hr1_discordant": 20, "hr1_margin": 0.05, "hr2_high": 0.03, "hr3_high": 0.01,
    "f1": 0.65, "f2": 0.50, "f3": 0.40, "f4": 0.25, "f5": 0.02,
}
#: Eligibility of a training cell (inclusive), and the retired report's gates.
ELIGIBLE = {"varying": 0.60, "disagreeing": 0.40, "success": (0.15, 0.85), "clipped": 0.05}
REPORT = {"G1": 0.800, "G2": 6.0, "G3": 0.10}


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)).cast("int")


def every_pair(episodes: DataFrame, arms: tuple[str, str] = ("BP", "TP")) -> DataFrame:
    """One row a task and condition that both arms have, in one join: the first arm's key columns, each arm's flags with
    ``_one`` and ``_two``, and both splits."""
    flags = ("certified", "recovered", "orchestrated", "runaway", "hallucinated")
    own = episodes.where(F.col("control") == "none")
    one = own.where(F.col("arm") == arms[0]).select("task_id", "condition", "family", "horizon", "split", "cluster", "pattern_id", "all_tools", "fault_class", *(_flag(f).alias(f"{f}_one") for f in flags))
    two = own.where(F.col("arm") == arms[1]).select("task_id", "condition", F.col("split").alias("split_two"), "n_calls", *(_flag(f).alias(f"{f}_two") for f in flags))
    return one.join(two, ["task_id", "condition"])


def _of(pairs: DataFrame, condition: str, splits: tuple[str, ...]) -> DataFrame:
    return pairs.where((F.col("condition") == condition) & F.col("split").isin(*splits) & F.col("split_two").isin(*splits)).drop("condition", "split", "split_two")


def arm_pairs(episodes: DataFrame, condition: str, splits: tuple[str, ...], arms: tuple[str, str] = ("BP", "TP")) -> DataFrame:
    """One row a task of a condition and some splits that both arms have, as ``every_pair``."""
    return _of(every_pair(episodes, arms), condition, splits)


def common_clean(episodes: DataFrame, registered: dict = REGISTERED, of=arm_pairs) -> DataFrame:
    """Faulted pairs of the tasks that both arms certify when clean. ``of`` is ``_of`` where pairs are given."""
    clean = of(episodes, "clean", registered["core"]).where("certified_one = 1 and certified_two = 1").select("task_id")
    return of(episodes, "faulted", registered["core"]).join(clean, "task_id", "left_semi")


def orchestration_pairs(episodes: DataFrame, registered: dict = REGISTERED, of=arm_pairs) -> DataFrame:
    return of(episodes, "clean", registered["mt"]).where(F.col("all_tools") & (F.col("horizon") == registered["mt_horizon"]))


def long_pairs(episodes: DataFrame, registered: dict = REGISTERED, of=arm_pairs) -> DataFrame:
    return of(episodes, "clean", registered["h8"]).where((F.col("horizon") == registered["hr_horizon"]) & F.col("family").isin(*registered["hr_families"]))


def underpowered(status: Column, power: Column) -> tuple[Column, Column]:
    """(the official status, what was measured): a gate without power decides nothing, and what it measured stays beside it."""
    return F.when(power, status).otherwise("INCONCLUSIVE"), status


def bootstrap_status(bound: Column, degenerate: Column, margin: float) -> Column:
    return F.when(bound.isNull() | F.coalesce(degenerate, F.lit(True)), "INCONCLUSIVE").when(bound > margin, "PASS").otherwise("FAIL")


def gates(episodes: DataFrame, bounds: DataFrame, registered: dict = REGISTERED) -> DataFrame:
    """(gate, n, estimate, status, measured): ER1 to ER8, MT1 to MT5 and HR1 to HR3, one row each.

    ``bounds`` has the clustered lower bounds of ER2, ER4, MT1 and HR1: gate, bound, degenerate; one that isn't there decides
    nothing. A gate over nothing is INCONCLUSIVE, and so are ER2 and ER3 where ER1 has too few pairs; ``measured`` is the
    status before that.
    """
    r = registered
    pairs = settle(every_pair(episodes), "pairs")  # all samples are rows of this one table
    clean, faulted = _of(pairs, "clean", r["core"]), _of(pairs, "faulted", r["core"])
    both, mt, hr = common_clean(pairs, r, _of), orchestration_pairs(pairs, r, _of), long_pairs(pairs, r, _of)
    core = settle(episodes.where((F.col("arm") == "TP") & (F.col("control") == "none") & F.col("condition").isin("clean", "faulted") & F.col("split").isin(*r["core"])).select("runaway", "hallucinated"), "core")
    rows: list[DataFrame] = []

    def row(gate: str, df: DataFrame, estimate: Column, status, measured=None) -> None:
        """One gate from one aggregate over its sample; ``status`` gets (n, k)."""
        one = df.agg(F.count("*").alias("n"), estimate.cast("double").alias("estimate"))
        rows.append(one.select(F.lit(gate).alias("gate"), "n", "estimate").withColumn("status", status).withColumn("measured", measured if measured is not None else F.col("status")))

    n = F.col("n")
    successes = F.round(F.col("estimate") * n)
    rate = lambda name: F.avg(name)
    difference = lambda name: F.avg(F.col(f"{name}_two") - F.col(f"{name}_one"))
    enough = F.when(n >= r["er1_pairs"], "PASS").otherwise("INCONCLUSIVE")
    row("ER1", both, F.count("*"), enough)
    row("ER2", both, difference("recovered"), F.lit("bound"))
    row("ER3", both, rate("recovered_two"), underpowered(stats.lower_gate(successes, n, r["er3_low"]), n >= r["er1_pairs"])[0], stats.lower_gate(successes, n, r["er3_low"]))
    row("ER4", clean, difference("certified"), F.lit("bound"))
    row("ER5", faulted, difference("recovered"), F.when(n < r["er5_pairs"], "INCONCLUSIVE").when(F.col("estimate") >= r["er5_least"], "PASS").otherwise("FAIL"))
    row("ER6", core, F.avg(_flag("runaway")), stats.upper_gate(successes, n, r["er6_high"]))
    row("ER7", core, F.avg(_flag("hallucinated")), stats.upper_gate(successes, n, r["er7_high"]))
    rows.append(_group_gate("ER8", faulted.where("fault_class is not null").withColumn("_g", F.coalesce(fault_group(F.col("fault_class")), F.lit("unregistered"))), "recovered", r["er8_each"], r["er8_least"], r["er8_groups"], len(r["er8_groups"])))
    row("MT1", mt, difference("orchestrated"), F.lit("bound"))
    row("MT2", mt, rate("orchestrated_two"), stats.lower_gate(successes, n, r["mt2_low"]))
    # of an even number the upper middle one
    row("MT3", mt, F.expr("percentile_disc(0.5) within group (order by n_calls desc)"), F.when(n == 0, "INCONCLUSIVE").when(F.col("estimate") <= r["mt3_calls"], "PASS").otherwise("FAIL"))
    legs = mt.agg(F.count("*").alias("n"), F.sum("runaway_two").alias("a"), F.sum("hallucinated_two").alias("b"))
    one, two = stats.upper_gate(F.col("a"), n, r["mt4_runaway"]), stats.upper_gate(F.col("b"), n, r["mt4_hallucinated"])
    worse = F.when(n == 0, "INCONCLUSIVE").when((one == "FAIL") | (two == "FAIL"), "FAIL").when((one == "INCONCLUSIVE") | (two == "INCONCLUSIVE"), "INCONCLUSIVE").otherwise("PASS")
    rows.append(legs.select(F.lit("MT4").alias("gate"), "n", (F.greatest("a", "b") / n).alias("estimate"), worse.alias("status"), worse.alias("measured")))
    rows.append(_group_gate("MT5", mt.where("pattern_id is not null").withColumn("_g", F.col("pattern_id").cast("string")), "orchestrated", r["mt5_each"], r["mt5_least"], None, r["mt5_patterns"]))
    row("HR1", hr, difference("certified"), F.lit("bound"))
    row("HR2", hr, rate("runaway_two"), stats.upper_gate(successes, n, r["hr2_high"]))
    row("HR3", hr, rate("hallucinated_two"), stats.upper_gate(successes, n, r["hr3_high"]))

    whole = reduce(DataFrame.unionByName, rows)
    discordant = hr.agg(F.count_if(F.col("certified_one") != F.col("certified_two")).alias("_discordant"))
    margins = {"ER2": r["er2_margin"], "ER4": r["er4_margin"], "MT1": r["mt1_margin"], "HR1": r["hr1_margin"]}
    whole = whole.join(F.broadcast(bounds.select("gate", "bound", "degenerate")), "gate", "left")
    whole = whole.join(F.broadcast(discordant.withColumn("gate", F.lit("HR1"))), "gate", "left")
    out, measured = F.col("status"), F.col("measured")
    for gate, margin in margins.items():
        own = bootstrap_status(F.col("bound"), F.col("degenerate"), margin)
        power = {"ER2": n >= r["er1_pairs"], "ER4": n > 0, "MT1": n >= r["mt1_pairs"], "HR1": (n >= r["hr1_pairs"]) & (F.col("_discordant") >= r["hr1_discordant"])}[gate]
        out = F.when(F.col("gate") == gate, underpowered(own, power)[0]).otherwise(out)
        measured = F.when(F.col("gate") == gate, own).otherwise(measured)
    return whole.select("gate", "n", "estimate", out.alias("status"), measured.alias("measured"))


def _group_gate(gate: str, pairs: DataFrame, flag: str, each: int, least: float, groups: tuple[str, ...] | None, wanted: int) -> DataFrame:
    """No group's difference may be below ``least``; groups that are too few, too small or not registered decide nothing."""
    by = pairs.groupBy("_g").agg(F.count("*").alias("c"), F.avg(F.col(f"{flag}_two") - F.col(f"{flag}_one")).alias("d"))
    known = F.col("_g").isin(*groups) if groups else F.lit(True)
    one = by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.min("d").alias("estimate"), F.count_if(known & (F.col("c") >= each)).alias("whole"), F.count_if(~known | (F.col("c") < each)).alias("odd"))
    status = F.when((F.col("whole") < wanted) | (F.col("odd") > 0), "INCONCLUSIVE").when(F.col("estimate") < least, "FAIL").otherwise("PASS")
    return one.select(F.lit(gate).alias("gate"), "n", "estimate", status.alias("status"), status.alias("measured"))


def floors(episodes: DataFrame, registered: dict = REGISTERED) -> DataFrame:
    """(arm, floor, n, rate, status): F1 to F5 of each arm over its core episodes; point estimates decide.

    F1 and F2 are over clean ones, F3 and F4 over faulted ones, F5 over both; F2 and F4 take the worst family. An arm without
    clean or without faulted episodes has no verdict.
    """
    r = registered
    core = episodes.where((F.col("control") == "none") & F.col("condition").isin("clean", "faulted") & F.col("split").isin(*r["core"]))
    crash = stalled_or_crashed(F.col("runaway"), F.col("termination")).cast("int")
    family = core.groupBy("arm", "condition", "family").agg(F.count("*").alias("c"), F.sum(_flag("certified")).alias("k"), F.sum(crash).alias("x"))
    of = lambda name, condition: F.sum(F.when(F.col("condition") == condition, F.col(name)))
    low = lambda condition: F.min(F.when(F.col("condition") == condition, F.col("k") / F.col("c")))
    arm = family.groupBy("arm").agg(of("c", "clean").alias("nc"), of("k", "clean").alias("kc"), of("c", "faulted").alias("nf"), of("k", "faulted").alias("kf"), low("clean").alias("lc"), low("faulted").alias("lf"), F.sum("c").alias("n"), F.sum("x").alias("x"))
    cases = [("F1", F.col("nc"), F.col("kc") / F.col("nc"), r["f1"]), ("F2", F.col("nc"), F.col("lc"), r["f2"]), ("F3", F.col("nf"), F.col("kf") / F.col("nf"), r["f3"]), ("F4", F.col("nf"), F.col("lf"), r["f4"]), ("F5", F.col("n"), F.col("x") / F.col("n"), r["f5"])]
    missing = F.col("nc").isNull() | F.col("nf").isNull()
    passed = lambda name, rate, level: rate < level if name == "F5" else rate >= level
    rows = F.array(*(F.struct(F.lit(name).alias("floor"), F.coalesce(n, F.lit(0)).alias("n"), F.when(~missing, rate).alias("rate"), F.when(missing, "INCONCLUSIVE").when(passed(name, rate, level), "PASS").otherwise("FAIL").alias("status")) for name, n, rate, level in cases))
    return arm.select("arm", F.explode(rows).alias("x")).select("arm", "x.*")


def eligible_cells(groups: DataFrame, by: str, limits: dict = ELIGIBLE) -> DataFrame:
    """(by, n_groups, varying, disagreeing, success, clipped, leaks, eligible): which cells can be trained on; limits are inclusive.

    groups: one row a rollout group, with n, varies, disagree, successes, clipped (rollouts), unsafe, inconsistent, replay_failed.
    """
    out = groups.groupBy(by).agg(F.count("*").alias("n_groups"), F.avg(F.col("varies").cast("int")).alias("varying"), F.avg(F.col("disagree").cast("int")).alias("disagreeing"), (F.sum("successes") / F.sum("n")).alias("success"), (F.sum("clipped") / F.sum("n")).alias("clipped"), F.count_if(F.col("unsafe") | F.col("inconsistent") | F.col("replay_failed")).alias("leaks"))
    good = (F.col("varying") >= limits["varying"]) & (F.col("disagreeing") >= limits["disagreeing"]) & F.col("success").between(*limits["success"]) & (F.col("clipped") <= limits["clipped"]) & (F.col("leaks") == 0)
    return out.withColumn("eligible", good)


def report_gates(tags: DataFrame, base: str = "base", trained: str = "rssft", further: str = "rsgrpo", limits: dict = REPORT) -> DataFrame:
    """(gate, value, status): G1 to G5 of the retired report; what can't be asked is SKIP, which is neither pass nor fail.

    tags: tag, n, right, calls_mean, runaway, no_box, traced (episodes with a trace, null without one).
    """
    own = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.col(name)))
    one = tags.agg(*(own(tag, c).alias(f"{tag}_{c}") for tag in (base, trained, further) for c in ("n", "right", "calls_mean", "runaway", "no_box", "traced")))
    t = lambda c: F.col(f"{trained}_{c}")
    accuracy = lambda tag: F.col(f"{tag}_right") / F.col(f"{tag}_n")
    boxes = lambda tag: F.col(f"{tag}_no_box") / F.col(f"{tag}_traced")
    cases = [
        ("G1", accuracy(trained), accuracy(trained) >= limits["G1"]),
        ("G2", t("calls_mean"), F.when(t("traced").isNotNull(), t("calls_mean") <= limits["G2"])),
        ("G3", t("runaway") / t("traced"), t("runaway") / t("traced") <= limits["G3"]),
        ("G4", boxes(trained), boxes(trained) < boxes(base)),
        ("G5", accuracy(further), F.when(F.col(f"{further}_traced").isNotNull() & t("traced").isNotNull(), accuracy(further) >= accuracy(trained))),
    ]
    rows = F.array(*(F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.when(test.isNull(), "SKIP").when(test, "PASS").otherwise("FAIL").alias("status")) for name, value, test in cases))
    return one.select(F.explode(rows).alias("x")).select("x.*")


def budget_guard(stages: DataFrame, used_hours: float, ceiling: float) -> DataFrame:
    """(stage, minutes, source, projected_hours, allowed): the largest projection of each stage against what is left.

    stages: stage, nominal, declared, committed (minutes, null where there is none). The committed one is looked up by the
    caller under the stage, its part before the colon, and before the point. Of equal ones the first named counts.
    """
    found = F.filter(F.array(*(F.struct(F.col(c).cast("double").alias("minutes"), F.lit(-i).alias("rank"), F.lit(c).alias("source")) for i, c in enumerate(("nominal", "declared", "committed")))), lambda x: x["minutes"].isNotNull())
    top = F.array_max(found)
    hours = F.lit(float(used_hours)) + top["minutes"] / 60.0
    return stages.select("stage", top["minutes"].alias("minutes"), top["source"].alias("source"), hours.alias("projected_hours"), (hours <= ceiling).alias("allowed"))


def committed_minutes(stages: DataFrame, commitment: DataFrame) -> DataFrame:
    """``stages`` with ``committed``: of the stage itself, else of what stands before its colon, else before the point of that."""
    names = F.array(F.col("stage"), F.substring_index("stage", ":", 1), F.substring_index(F.substring_index("stage", ":", 1), ".", 1))
    tried = stages.select("stage", F.posexplode(names).alias("place", "name")).join(commitment.select(F.col("stage").alias("name"), "minutes"), "name")
    return stages.join(tried.groupBy("stage").agg(F.min_by("minutes", "place").alias("committed")), "stage", "left")


def stage_disposition(stages: DataFrame) -> DataFrame:
    """(stage, problem): training stages whose declared disposition doesn't fit; none is a valid plan.

    stages: stage, disposition (run, skip), eligible, reason, checkpoint. What runs has to be eligible, what is skipped has to
    say why and has no checkpoint.
    """
    problem = (
        F.when(F.col("disposition").isNull() | ~F.col("disposition").isin("run", "skip"), "unknown disposition")
        .when((F.col("disposition") == "run") & ~F.coalesce("eligible", F.lit(False)), "runs without being eligible")
        .when((F.col("disposition") == "skip") & (F.coalesce("reason", F.lit("")) == ""), "skipped without a reason")
        .when((F.col("disposition") == "skip") & F.col("checkpoint").isNotNull(), "skipped with a checkpoint")
    )
    return stages.select("stage", problem.alias("problem")).where("problem is not null")


def paired_test(one: DataFrame, two: DataFrame, key: str, success: str, least: int = 10, exact_up_to: int = 25) -> DataFrame:
    """(n_pairs, b, c, z, p): McNemar's test of two arms by index, exact up to 25 discordant pairs and normal beyond.

    Rows without an index don't count; with fewer than ten common indexes there is no row.
    """
    pairs = one.where(F.col(key).isNotNull()).select(key, F.coalesce(success, F.lit(False)).alias("ok_one")).join(two.where(F.col(key).isNotNull()).select(key, F.coalesce(success, F.lit(False)).alias("ok_two")), key)
    d = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("ok_one") & ~F.col("ok_two")).alias("b"), F.count_if(~F.col("ok_one") & F.col("ok_two")).alias("c")).where(F.col("n_pairs") >= least)
    z = stats.mcnemar_z(F.col("b"), F.col("c"))
    p = F.when(F.col("b") + F.col("c") <= exact_up_to, stats.mcnemar_exact("b", "c")["two_sided"]).otherwise(stats.two_sided_normal(z))
    return d.select("n_pairs", "b", "c", z.alias("z"), p.alias("p"))
