"""Global order, closure over long ways, and the register of queries."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright import registry
from tracewright.operators import closure, order, sampling, shared


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.choice("aab"), rng.choice([None, 1, 1, 1, 2, 9]), rng.randrange(5)) for i in range(500)]
    return data, spark.createDataFrame(data, "id int, grp string, v int, w int").repartition(5)


@pytest.mark.parametrize("by", [(), ("grp",)])
def test_running_sums_and_the_ring(rows, by):
    data, df = rows
    key = lambda r: (r[2] is not None, r[2] or 0, r[0])
    sums, ring, totals = {}, {}, {}
    for g in sorted({r[1] for r in data}) if by else [None]:
        own = sorted((r for r in data if not by or r[1] == g), key=key)
        for i, r in enumerate(own):
            sums[r[0]] = sum(x[3] for x in own[: i + 1])
            ring[r[0]] = own[(i + 1) % len(own)][0]
            totals[r[0]] = len(own)
    got = order.accumulated(df, ["v", "id"], "s", F.col("w"), by, ranges=7)
    assert {r["id"]: r["s"] for r in got.collect()} == sums and got.columns == [*df.columns, "s"]
    assert {r["id"]: r["n"] for r in order.numbered(df, ["v", "id"], "p", by, "n", 7).collect()} == totals
    assert {r["id"]: r["o"] for r in order.succeeded(df, ["v", "id"], "id", "o", by, 7).collect()} == ring


@pytest.mark.parametrize("alpha", [0.0, 0.025, 0.5, 0.999])
def test_order_statistics(rows, alpha):
    data, df = rows
    got = {r["grp"]: r["statistic"] for r in sampling.order_statistic(df, "v", alpha, ("grp",)).collect()}
    for g in "ab":
        own = sorted(r[2] for r in data if r[1] == g and r[2] is not None)
        assert got[g] == own[min(int(alpha * len(own)), len(own) - 1)]
    assert sampling.order_statistic(df.where("v > 100"), "v", alpha).count() == 0


def test_an_empty_and_a_lone_row(spark):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    assert order.succeeded(df, ["id"], "v", "o").first()["o"] == "x" and order.numbered(df.where("id > 1"), ["id"], "n").count() == 0


def test_apportioned_by_ranges(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate((34.0, 33.0, 33.0))], "id int, w double")
    assert [r["share"] for r in sampling.apportioned(df, "w", 20, ["id"]).orderBy("id").collect()] == [7, 7, 6]


@pytest.mark.parametrize("n", [2_000, 10_000])
def test_a_long_way_ends(spark, n):
    edges = spark.range(n).select(F.lit("g").alias("grp"), F.col("id").alias("node"), (F.col("id") + 1).alias("next")).union(spark.createDataFrame([("g", n, 0), ("h", 1, 1), ("h", 5, 6)], "grp string, node long, next long"))
    start = spark.createDataFrame([("g", 3), ("h", 1), ("k", 7), (None, 1)], "grp string, node long")
    got = closure.reached(start, edges)
    assert got.columns == ["grp", "node"] and got.groupBy("grp").count().collect() and {r["grp"]: r["count"] for r in got.groupBy("grp").count().collect()} == {"g": n + 1, "h": 1, "k": 1}


def test_rounds_keep_the_plan_small(spark, monkeypatch):
    sizes, written = [], shared.settled_union

    def watched(df, *a):
        sizes.append(len(df._jdf.queryExecution().toString()))
        return written(df, *a)

    monkeypatch.setattr(closure, "settled_union", watched)
    edges = spark.range(32).selectExpr("1 as grp", "id as node", "id + 1 as next").union(spark.createDataFrame([(1, 20, 4), (2, 1, 2)], "grp int, node long, next long"))
    got = closure.reached(spark.createDataFrame([(1, 0), (2, 1)], "grp int, node long"), edges, in_task=1)
    assert sorted(tuple(r) for r in got.collect()) == [(1, i) for i in range(33)] + [(2, 1), (2, 2)]
    assert len(sizes) > 30 and sizes[30] < 1.5 * sizes[3]


def test_a_name_is_registered_once():
    def once(spark, sf_dir):
        return None

    registry.query()(once)
    try:
        with pytest.raises(ValueError, match="once"):
            registry.query()(once)
    finally:
        del registry.QUERIES["once"]
