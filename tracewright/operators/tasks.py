"""Generated tasks and stateful warehouses, one independent row a label."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.draws import base32, hex_token


def lookup_chains(labels: DataFrame, secret: bytes) -> DataFrame:
    """A chain of lookups for each (task_id, horizon): every record names the next key and the last one holds the answer.

    A key's draws come from the task and the key's place, so rows don't depend on partitioning or order.
    """
    seed = lambda what: F.sha2(F.concat(F.lit(secret), F.encode(F.concat_ws("|", F.col("task_id"), what), "UTF-8")), 256)
    # labels are a few bytes and a chain is costly, so the labels' files don't say how many tasks share the work
    labels = labels.select(F.col("task_id").cast("string"), F.col("horizon").cast("int")).repartition("task_id")
    keys = F.transform(F.sequence(F.lit(1), F.col("horizon")), lambda i: F.concat(F.lit("K"), base32(seed(i.cast("string")), 16)))
    made = labels.withColumn("keys", keys).withColumn("answer", hex_token(seed(F.lit("answer"))))
    node = lambda k, i: F.struct(F.concat(F.lit("n"), (i + 1).cast("string")).alias("node"), F.lit("kb_lookup").alias("tool"), k.alias("key"), F.coalesce(F.get("keys", i + 1), F.col("answer")).alias("next"))
    return made.select("task_id", "horizon", "answer", F.transform("keys", node).alias("nodes"))


def walked(chains: DataFrame) -> DataFrame:
    """Each chain followed from its first key: the end reached and whether it is the answer, so a generated task is solvable."""
    table = F.map_from_entries(F.transform("nodes", lambda n: F.struct(n["key"].alias("k"), n["next"].alias("v"))))
    end = let(table, lambda t: F.aggregate(F.sequence(F.lit(1), F.col("horizon")), F.element_at("nodes", 1)["key"], lambda at, _: F.try_element_at(t, at)))
    both = let(end, lambda e: F.struct(e.alias("reached"), (e == F.col("answer")).alias("solved")))
    return chains.select("task_id", "horizon", F.inline(F.array(both)))


WAREHOUSE = "order_id string, call_id long, ok boolean, error string, mutated boolean, replay boolean, funds double, stock string"


def warehouse(actions: DataFrame, orders: DataFrame) -> DataFrame:
    """Reserve, cancel and finalise actions of each order against its stock and funds; a repeated action changes nothing.

    actions: order_id, call_id, action, line. orders: order_id, funds, lines array<struct<line, lot, quantity, total>>, stock
    map<lot, quantity>. An order's actions are a bounded ledger.
    """

    def run(key, calls: pd.DataFrame, order: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in WAREHOUSE.split(", ")]
        if not len(order):
            return pd.DataFrame(columns=columns)
        first = order.iloc[0]
        funds, stock = float(first["funds"]), dict(first["stock"])
        lines = {x["line"]: x for x in first["lines"]}
        held: set[str] = set()
        done, out = False, []
        for row in calls.sort_values("call_id").itertuples():
            ok, error, mutated, replay = True, None, False, False
            line = lines.get(row.line)
            if row.action == "finalize":
                replay = done
                if not done and held != set(lines):
                    ok, error = False, "incomplete_order"
                elif not done:
                    done = mutated = True
            elif line is None or row.action == "cancel" and row.line not in held:
                ok, error = False, "unknown_token"
            elif row.action == "reserve" and row.line in held:
                replay = True
            elif row.action == "reserve" and stock.get(line["lot"], 0) < line["quantity"]:
                ok, error = False, "insufficient_inventory"
            elif row.action == "reserve" and funds < line["total"]:
                ok, error = False, "insufficient_funds"
            elif row.action == "cancel" and done:
                ok, error = False, "already_complete"
            else:
                sign = 1 if row.action == "reserve" else -1
                stock[line["lot"]] -= sign * line["quantity"]
                funds -= sign * line["total"]
                held.symmetric_difference_update({row.line})
                mutated = True
            out.append((row.order_id, row.call_id, ok, error, mutated, replay, funds, json.dumps({k: int(v) for k, v in sorted(stock.items())})))
        return pd.DataFrame(out, columns=columns)

    return actions.groupBy("order_id").cogroup(orders.groupBy("order_id")).applyInPandas(run, WAREHOUSE)
