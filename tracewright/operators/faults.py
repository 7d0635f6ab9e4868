"""The fault plan: which tasks of a cell carry which faults, exactly in proportion, and on which nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.bind import let
from ..functions.numbers import wrong_units
from .order import numbered
from .shared import settle

#: Fault classes in their order; weights of tasks with and without a unit conversion; weights of the evaluation
#: by family (a short fulfillment is as a lookup chain); splits without faults; every fourth malformed fault of a fulfillment
#: cell is on a change of state.
KINDS = ("transient", "malformed", "wrong_unit", "rate_limit")
EVEN, WITHOUT_UNITS = (1, 1, 1, 1), (34, 33, 0, 33)
EVALUATION = {"lookup_chain": (25, 50, 0, 25), "typed_relay": (8, 15, 70, 7), "fulfillment": (15, 30, 40, 15)}
SHORT_FULFILLMENT = 4
CLEAN = ("eval_mt", "eval_h8", "eval_absent", "eval_perm")
TRAINING = ("oracle_sft", "distill", "grpo_train")
STRESS, EVAL, STRIDE = "eval_stress", "eval", 4


def weights(split: Column, family: Column, horizon: Column, converts: Column) -> Column:
    """array<double> of the weight of each of KINDS in a cell."""
    as_array = lambda w: F.array(*(F.lit(float(x)) for x in w))
    table = as_array(EVALUATION["fulfillment"])
    table = F.when(family == "typed_relay", as_array(EVALUATION["typed_relay"])).when((family == "lookup_chain") | (horizon <= SHORT_FULFILLMENT), as_array(EVALUATION["lookup_chain"])).otherwise(table)
    return F.when(split == EVAL, table).when(converts, as_array(EVEN)).otherwise(as_array(WITHOUT_UNITS))


def shares(n: Column, weight: Column) -> Column:
    """array<long>: n in whole shares in proportion to array<double> weights; what is left goes to the largest remainders,
    ties to the earlier one."""
    total = F.aggregate(weight, F.lit(0.0), lambda a, w: a + w)
    exact = F.transform(weight, lambda w: n * w / total)
    whole = F.transform(exact, lambda x: F.floor(x).cast("long"))
    left = n - F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x)
    ranked = F.array_sort(F.transform(exact, lambda x, i: F.struct((F.floor(x) - x).alias("rest"), i.alias("i"))))
    more = F.transform(F.slice(ranked, F.lit(1), left.cast("int")), lambda x: x["i"])
    return F.transform(whole, lambda x, i: x + F.array_contains(more, i).cast("long"))


def _pairs(kinds: Column) -> Column:
    later = lambda i: F.filter(kinds, lambda _, j: j > i)
    return F.flatten(F.transform(kinds, lambda a, i: F.transform(later(i), lambda b: F.array(a, b))))


def planned(tasks: DataFrame, order: list[str], cell: tuple[str, ...] = ("split", "family", "horizon")) -> DataFrame:
    """``tasks`` with ``faults`` array<struct<kind, ambiguous>>: what each task carries; empty for a clean one.

    tasks: split, family, horizon, converts (whether a node converts units), and what orders and tells apart the tasks of a
    cell. Of a training cell the first half is clean; clean splits have no fault; a stress task has two different ones, all
    pairs alike; any other task has one. Counts are exact; classes follow one another in the order of KINDS. Nothing is drawn.
    A cell may have any number of tasks: they are numbered by ranges of the order.
    """
    rows = numbered(tasks, order, "_place", cell, "_n")
    split = F.col("split")
    marked = F.col("family") == "fulfillment"
    weight = F.zip_with(F.array(*map(F.lit, KINDS)), weights(split, F.col("family"), F.col("horizon"), F.col("converts")), lambda k, w: F.struct(k.alias("kind"), w.alias("weight")))
    open_kinds = F.filter(weight, lambda x: x["weight"] > 0)
    kinds = F.transform(open_kinds, lambda x: x["kind"])
    clean = F.when(split.isin(*CLEAN), F.col("_n")).when(split.isin(*TRAINING), F.floor(F.col("_n") / 2)).otherwise(0).cast("long")
    rows = rows.withColumns({"_clean": clean, "_units": F.when(split == STRESS, _pairs(kinds)).otherwise(F.transform(kinds, lambda k: F.array(k)))})
    rows = rows.withColumn("_counts", shares(F.col("_n") - F.col("_clean"), F.when(split == STRESS, F.transform("_units", lambda u: F.lit(1.0))).otherwise(F.transform(open_kinds, lambda x: x["weight"]))))
    before = lambda test: F.aggregate(F.slice("_counts", F.lit(1), F.col("_unit")), F.lit(0).cast("long"), test)
    at = F.col("_place") - F.col("_clean") - 1
    upto = F.transform("_counts", lambda _, i: F.aggregate(F.slice("_counts", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("_at", at).withColumn("_unit", F.size(F.filter(upto, lambda u: u <= F.col("_at"))))
    malformed = F.transform("_counts", lambda c, i: F.when(F.array_contains(F.get("_units", i), "malformed"), c).otherwise(F.lit(0).cast("long")))
    ordinal = F.col("_at") - before(lambda a, x: a + x) + F.aggregate(F.slice(malformed, F.lit(1), F.col("_unit")), F.lit(0).cast("long"), lambda a, x: a + x)
    entry = lambda k: F.struct(k.alias("kind"), (marked & (k == "malformed") & (F.col("_ordinal") % STRIDE == 0)).alias("ambiguous"))
    rows = rows.withColumn("_ordinal", ordinal)
    faults = F.when(F.col("_at") < 0, F.array().cast("array<struct<kind:string,ambiguous:boolean>>")).otherwise(F.transform(F.get("_units", F.col("_unit")), entry))
    return rows.withColumn("faults", faults).select(*tasks.columns, "faults")


def eligible(nodes: Column, kind: Column, ambiguous: Column) -> Column:
    """The nodes, array<struct<node, tool, mutating, action, unit>>, that can carry a fault: a wrong unit needs a conversion, a
    malformed result a call that changes nothing, or a reservation where the change has to stay in doubt."""
    fits = lambda n: (
        F.when(kind == "wrong_unit", n["tool"] == "unit_convert")
        .when(kind == "malformed", F.when(ambiguous, n["mutating"] & (n["action"] == "reserve")).otherwise(~n["mutating"]))
        .otherwise(F.lit(True))
    )
    return F.filter(nodes, lambda n: F.coalesce(fits(n), F.lit(False)))


def targeted(tasks: DataFrame, bytes_drawn: int = 512) -> DataFrame:
    """``tasks`` with ``targets`` array<struct<kind, ambiguous, node, wrong_unit>>, in the order of ``faults``.

    Faults of one task are on different nodes: the one that the fewest nodes can carry chooses first, ties by its place, so a
    fault that any node can carry doesn't take the only node of another. A node is drawn from what is left, and then the unit
    of a wrong-unit fault, all from the one stream of the task's ``seed`` (hexadecimal); tasks without a node left raise.

    tasks: seed, nodes as ``eligible`` takes them, faults as ``planned`` gives them. A task's nodes are a bounded list.
    The plan and the targets are written once: what reads them would else put the whole plan in for each mention of a fault.
    """
    tasks = settle(tasks, "planned").repartition("seed")  # a small file is one task, whose rows are costly
    ranked = F.array_sort(F.transform("faults", lambda f, i: F.struct(F.size(eligible(F.col("nodes"), f["kind"], f["ambiguous"])).alias("fits"), i.alias("i"), f["kind"].alias("kind"), f["ambiguous"].alias("ambiguous"))))
    kind = "array<struct<i:int,kind:string,ambiguous:boolean,node:string,wrong_unit:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    # each step is a value that the next one is a function of, so the plan doesn't repeat a draw wherever it is used
    def take(acc: Column, f: Column) -> Column:
        taken = F.transform(acc["out"], lambda x: x["node"])
        free = F.filter(eligible(F.col("nodes"), f["kind"], f["ambiguous"]), lambda n: ~F.array_contains(taken, n["node"]))

        def of_nodes(left: Column) -> Column:
            some = F.when(F.size(left) > 0, F.size(left)).otherwise(F.raise_error(F.concat(F.lit("no node is left for "), f["kind"])).cast("int"))
            return let(draws.next_below(F.col("_stream"), acc["at"], some), lambda one: of_units(one, F.get(left, one["value"].cast("int"))))

        def of_units(one: Column, node: Column) -> Column:
            entry = lambda unit: F.struct(f["i"].alias("i"), f["kind"].alias("kind"), f["ambiguous"].alias("ambiguous"), node["node"].alias("node"), unit.cast("string").alias("wrong_unit"))
            after = lambda at, unit: F.struct(at.cast("long").alias("at"), F.concat(acc["out"], F.array(entry(unit))).cast(kind).alias("out"))
            drawn = lambda others: let(draws.next_below(F.col("_stream"), one["at"], F.size(others)), lambda two: after(F.coalesce(two["at"], one["at"]), F.get(others, two["value"].cast("int"))))
            return F.when(f["kind"] == "wrong_unit", let(wrong_units(node["unit"]), drawn)).otherwise(after(one["at"], F.lit(None)))

        return let(free, of_nodes)

    drawn = tasks.withColumn("_stream", draws.blocks(F.col("seed"), -(-bytes_drawn // 32))).withColumn("_targets", F.aggregate(ranked, start, take, lambda a: F.array_sort(a["out"])))
    out = drawn.withColumn("targets", F.transform("_targets", lambda x: F.struct(x["kind"].alias("kind"), x["ambiguous"].alias("ambiguous"), x["node"].alias("node"), x["wrong_unit"].alias("wrong_unit")))).drop("_stream", "_targets")
    return settle(out, "targets")
