"""Controls of a task set: hidden values permuted between tasks, hidden records taken away, and payloads that are right again.

specs: task_id, answer, answer_kind, answer_field, hidden_key, kb map<string, map<string,string>>, nodes array<struct<node, tool,
args map<string, struct<value, source, field, format>>>> in order, expected array<struct<node, value, record
map<string,string>>>. An argument is a value, or names the node it comes from, the field of that node's record (``value``, the
default, is the result itself) and a text whose ``{}`` it replaces. A task's nodes are a bounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.numbers import UNITS, arithmetic, written
from .order import numbered

_RESULT = "struct<value:string,record:map<string,string>>"
#: Rounds of the keyed network, and bits of a half in which numbers stay exact.
ROUNDS = 4


def permuted_place(place: Column, n: int, key: str) -> Column:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked on while it is
    outside. Fixed points are possible."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    low = (1 << half) - 1

    def once(x: Column) -> Column:
        left, right = F.shiftright(x, half), x.bitwiseAND(F.lit(low))
        for i in range(ROUNDS):
            left, right = right, left.bitwiseXOR(F.xxhash64(right, F.lit(f"{key}|{i}")).bitwiseAND(F.lit(low)))
        return F.shiftleft(left, half).bitwiseOR(right)

    # the domain is at most four times n, so a walk of this length ends with all but a chance of (3/4)^96
    start = F.struct(once(place.cast("long")).alias("x"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, lambda a, _: F.struct(F.when(a["x"] < n, a["x"]).otherwise(once(a["x"])).alias("x")), lambda a: a["x"])
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a walk of the permutation didn't end")).cast("long"))


def _converted(args: Column) -> Column:
    size = F.create_map(*(F.lit(x) for u, _, s in UNITS for x in (u, s)))
    kind = F.create_map(*(F.lit(x) for u, k, _ in UNITS for x in (u, k)))
    unit = lambda name: F.lower(F.trim(F.try_element_at(args, F.lit(name))))
    ratio = F.try_element_at(size, unit("from_unit")) / F.try_element_at(size, unit("to_unit"))
    return F.when(F.try_element_at(kind, unit("from_unit")) == F.try_element_at(kind, unit("to_unit")), written(F.try_element_at(args, F.lit("value")).try_cast("double") * ratio))


def _resolved(args: Column, done: Column) -> Column:
    """struct<args, missing>: arguments with their references replaced; missing where a referenced node has no result."""

    def value(a: Column) -> Column:
        spliced = lambda found: F.when(F.coalesce(a["format"], F.lit("")) != "", F.replace(a["format"], F.lit("{}"), F.coalesce(found, F.lit("None")))).otherwise(found)
        field = lambda source: let(F.when(F.coalesce(a["field"], F.lit("value")) == "value", source["value"]).otherwise(F.try_element_at(source["record"], a["field"])), spliced)
        return F.when(a["source"].isNull(), a["value"]).otherwise(let(F.try_element_at(done, a["source"]), field))

    missing = F.exists(F.map_values(args), lambda a: a["source"].isNotNull() & F.try_element_at(done, a["source"]).isNull())
    return F.struct(F.transform_values(args, lambda _, a: value(a)).alias("args"), missing.alias("missing"))


def executed(kb: Column, nodes: Column) -> Column:
    """struct<going, done, args>: results by node, as far as the nodes can be followed in order, and the last one's arguments.

    One fold over the nodes with the results so far as its state. A lookup's result is the record of its key, a conversion's
    and an expression's a value; another tool, a key without a record, or a result that isn't there ends it.
    """
    start = F.struct(F.lit(True).alias("going"), F.create_map().cast(f"map<string,{_RESULT}>").alias("done"), F.lit(None).cast("map<string,string>").alias("args"))

    def run(acc: Column, n: Column) -> Column:
        def result(own: Column) -> Column:
            args = own["args"]
            record = F.try_element_at(kb, F.trim(F.try_element_at(args, F.lit("key"))))
            value = F.when(n["tool"] == "unit_convert", _converted(args)).when(n["tool"] == "calculator", arithmetic(F.try_element_at(args, F.lit("expression"))))
            found = F.struct(F.when(n["tool"] != "kb_lookup", value).alias("value"), F.when(n["tool"] == "kb_lookup", record).alias("record")).cast(_RESULT)
            return let(found, lambda found: after(own, found))

        def after(own: Column, found: Column) -> Column:
            on = acc["going"] & ~own["missing"] & (found["value"].isNotNull() | found["record"].isNotNull())
            grown = F.map_concat(F.map_filter(acc["done"], lambda k, _: k != n["node"]), F.map_from_arrays(F.array(n["node"]), F.array(found)))
            return F.struct(F.coalesce(on, F.lit(False)).alias("going"), F.when(on, grown).otherwise(acc["done"]).alias("done"), F.when(acc["going"] & ~own["missing"], own["args"]).otherwise(acc["args"]).alias("args"))

        return let(_resolved(n["args"], acc["done"]), result)

    return F.aggregate(nodes, start, run)


def reconciled(specs: DataFrame) -> DataFrame:
    """``specs`` whose expected payloads are those of their own knowledge base: of every node that can be followed, the result
    that it has now; nodes beyond keep theirs, as nothing can reach them."""
    done = specs.withColumn("_done", executed(F.col("kb"), F.col("nodes"))["done"])

    def now(e: Column) -> Column:
        got = F.try_element_at("_done", e["node"])
        return F.when(got.isNull(), e).otherwise(F.struct(e["node"].alias("node"), got["value"].alias("value"), got["record"].alias("record")))

    return done.withColumn("expected", F.transform("expected", now)).drop("_done")


def permuted(specs: DataFrame, key: str) -> DataFrame:
    """The tasks with a token at the end of a lookup, each with the answer of another one: (specs, permuted_from, control).

    Tasks are numbered by their id by ranges, and a keyed permutation of the numbers says whose answer a task gets; a few may
    get their own. The answer stands in the record that the last lookup reads, and expected payloads follow. Tasks that can't be
    followed to their end, or whose last record isn't there, have no permuted version; fewer than two tasks have none at all.
    """
    last = F.try_element_at("nodes", F.lit(-1))
    open_specs = specs.where((F.coalesce("answer_kind", F.lit("token")) == "token") & (last["tool"] == "kb_lookup"))
    placed = numbered(open_specs, ["task_id"], "_place")
    n = placed.count()
    if n < 2:
        return specs.limit(0).withColumn("permuted_from", F.col("task_id")).withColumn("control", F.lit("permuted"))
    donors = placed.select(F.col("_place").alias("_donor"), F.col("task_id").alias("permuted_from"), F.col("answer").alias("_answer"))
    both = placed.withColumn("_donor", permuted_place(F.col("_place") - 1, n, key) + 1).join(donors, "_donor").withColumn("_run", executed(F.col("kb"), F.col("nodes")))
    at, field = F.trim(F.try_element_at(F.col("_run.args"), F.lit("key"))), F.coalesce("answer_field", F.lit("code"))
    both = both.withColumn("_at", at).withColumn("_field", field).where(F.col("_run.going") & F.map_contains_key("kb", F.coalesce("_at", F.lit(""))))
    changed = F.transform_values("kb", lambda k, r: F.when(k == F.col("_at"), F.map_concat(F.map_filter(r, lambda f, _: f != F.col("_field")), F.create_map("_field", "_answer"))).otherwise(r))
    out = both.withColumn("kb", changed).withColumn("answer", F.col("_answer"))
    return reconciled(out.select(*specs.columns, "permuted_from", F.lit("permuted").alias("control")))


def redacted(specs: DataFrame) -> DataFrame:
    """``specs`` without the record that hides the answer, and ``control``: the one that is named, else the last one that is read.

    Expected payloads stay: what can't be reached any more is never credited.
    """
    run = executed(F.col("kb"), F.col("nodes"))
    named = F.map_contains_key("kb", F.coalesce("hidden_key", F.lit("")))
    gone = specs.withColumn("_gone", F.when(named, F.col("hidden_key")).otherwise(F.coalesce(F.trim(F.try_element_at(run["args"], F.lit("key"))), F.lit(""))))
    return gone.withColumn("kb", F.map_filter("kb", lambda k, _: k != F.col("_gone"))).withColumn("control", F.lit("redacted")).drop("_gone")


def controlled(specs: DataFrame, key: str) -> DataFrame:
    """The tasks as they are, redacted, and permuted, by ``control``; ``permuted_from`` names the donor."""
    plain = specs.withColumn("control", F.lit("none")).unionByName(redacted(specs)).withColumn("permuted_from", F.lit(None).cast(specs.schema["task_id"].dataType))
    return plain.unionByName(permuted(specs, key))
