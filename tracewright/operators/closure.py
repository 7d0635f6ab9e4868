"""What can be reached along edges within groups."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle, settled_union

#: Edges of a group that one task follows by itself; larger groups go round by round over all tasks.
IN_TASK = 200_000


def _followed(rows: list[tuple]) -> list:
    """Nodes that are reached: rows (node, next) are edges and rows (node, null) beginnings."""
    edges, seen, open_nodes = defaultdict(list), set(), []
    for node, onward in rows:
        if onward is None:
            open_nodes.append(node)
        else:
            edges[node].append(onward)
    while open_nodes:
        node = open_nodes.pop()
        if node not in seen:
            seen.add(node)
            open_nodes += edges[node]
    return list(seen)


def _within(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups dealt by their name and sorted, so that a task has each of its groups whole, one after another."""
    kind = start.schema["node"].dataType
    both = start.select("grp", "node", F.lit(None).cast(kind).alias("next")).union(edges.select("grp", F.col("node").cast(kind), F.col("next").cast(kind)))
    dealt = both.where("grp is not null and node is not null").repartition("grp").sortWithinPartitions("grp")

    def run(batches):
        group, rows, kinds = None, [], None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in (0, 1)]
            out = ([], [])
            for grp, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != group:
                    nodes = _followed(rows)
                    out[0].extend([group] * len(nodes))
                    out[1].extend(nodes)
                    group, rows = grp, []
                rows.append(row)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["grp", "node"])
        if rows:
            nodes = _followed(rows)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(([group] * len(nodes), nodes), kinds, strict=True)], names=["grp", "node"])

    return dealt.mapInArrow(run, start.select("grp", "node").schema)


def _by_rounds(start: DataFrame, edges: DataFrame) -> DataFrame:
    """Each round joins what the last one found and writes what is new. The plan of a round reads written tables only, so it
    is as long in the last round as in the first."""
    fresh, seen, path = settled_union(start.select("grp", "node").distinct(), "reached")
    edges = settle(edges.select("grp", "node", "next"), "edges")
    while not fresh.isEmpty():
        step = fresh.join(edges, ["grp", "node"]).select("grp", F.col("next").alias("node")).distinct()
        fresh, seen, _ = settled_union(step.join(seen, ["grp", "node"], "left_anti"), "reached", path)
    return seen


def reached(start: DataFrame, edges: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(grp, node): start (grp, node) and all that edges (grp, node, next) lead to, each once, however long the way is.

    A group of at most ``in_task`` edges is followed within one task, in one pass; how many tasks there are and how rows are
    dealt has no part in the result. Larger groups are followed by rounds, as many as the longest way in them has edges.
    Loops end, as nothing in them is new; repeated rows count once, and rows without a group or a node don't. Nothing
    comes to the driver but whether there is a large group, and whether a round found something.
    """
    start = start.where("grp is not null and node is not null")
    edges = settle(edges.where("grp is not null and node is not null and next is not null").select("grp", "node", "next"), "edges")  # once, for the count and the ways
    large = settle(edges.groupBy("grp").count().where(F.col("count") > in_task).select("grp"), "large")
    if large.isEmpty():
        return _within(start, edges)
    small = _within(start.join(large, "grp", "left_anti"), edges.join(large, "grp", "left_anti"))
    return small.union(_by_rounds(start.join(large, "grp", "left_semi"), edges.join(large, "grp", "left_semi")))
