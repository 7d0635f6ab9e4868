"""The fault plan, its targets, and draws from a stream that goes on."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import draws
from tracewright.operators import faults


class Stream:
    """The stream of a seed, in plain Python."""

    def __init__(self, seed):
        self.data, self.at = b"".join(hashlib.sha256(seed + i.to_bytes(8, "big")).digest() for i in range(64)), 0

    def below(self, n):
        bits = max(1, (n - 1).bit_length())
        while True:
            size = -(-bits // 8)
            v = int.from_bytes(self.data[self.at : self.at + size], "big") >> (8 * size - bits)
            self.at += size
            if v < n:
                return v


def test_a_stream_that_goes_on(spark):
    seeds = [hashlib.sha256(str(i).encode()).digest() for i in range(20)]
    df = spark.createDataFrame([(s.hex(), list(range(i % 9))) for i, s in enumerate(seeds)], "seed string, v array<int>").withColumn("s", draws.blocks(F.col("seed"), 64))
    first = draws.next_below(F.col("s"), F.lit(0), F.lit(300))
    second = draws.next_below(F.col("s"), first["at"], F.lit(1))
    for r in df.select("seed", "v", first.alias("a"), second.alias("b"), draws.shuffled(F.col("s"), F.col("v"), second["at"]).alias("c")).collect():
        own = Stream(bytes.fromhex(r["seed"]))
        assert r["a"]["value"] == own.below(300) and r["a"]["at"] == own.at and r["b"]["value"] == own.below(1)
        want = list(r["v"])
        for i in range(len(want) - 1, 0, -1):
            j = own.below(i + 1)
            want[i], want[j] = want[j], want[i]
        assert (r["c"]["values"], r["c"]["at"]) == (want, own.at)


@pytest.mark.parametrize(("n", "w", "want"), [(100, (34, 33, 33), [34, 33, 33]), (20, (34, 33, 33), [7, 7, 6]), (100, (1, 1, 1, 1), [25] * 4), (0, (1, 2), [0, 0])])
def test_shares(spark, n, w, want):
    assert spark.range(1).select(faults.shares(F.lit(n), F.array(*(F.lit(float(x)) for x in w)))).first()[0] == want


def plan(spark, split, family, horizon, n, converts):
    rows = spark.range(n).select(F.lit(split).alias("split"), F.lit(family).alias("family"), F.lit(horizon).alias("horizon"), F.lit(converts).alias("converts"), "id")
    return [[(f["kind"], f["ambiguous"]) for f in r["faults"]] for r in faults.planned(rows, ["id"]).orderBy("id").collect()]


def test_cells(spark):
    p = plan(spark, "oracle_sft", "typed_relay", 8, 400, True)
    assert p.count([]) == 200 and p[:200] == [[]] * 200 and collections.Counter(x[0][0] for x in p if x) == dict.fromkeys(faults.KINDS, 50)
    p = plan(spark, "distill", "lookup_chain", 4, 200, False)
    assert p.count([]) == 100 and collections.Counter(x[0][0] for x in p if x) == {"transient": 34, "malformed": 33, "rate_limit": 33}
    p = plan(spark, "grpo_train", "fulfillment", 8, 200, True)
    bad = [x[0] for x in p if x and x[0][0] == "malformed"]
    assert len(bad) == 25 and [i for i, x in enumerate(bad) if x[1]] == [0, 4, 8, 12, 16, 20, 24]
    assert all(len(x) == 1 for x in plan(spark, "eval", "fulfillment", 14, 100, True))
    assert collections.Counter(x[0][0] for x in plan(spark, "eval", "typed_relay", 2, 100, True)) == {"transient": 8, "malformed": 15, "wrong_unit": 70, "rate_limit": 7}
    p = plan(spark, "eval_stress", "fulfillment", 12, 40, True)
    assert all(len(x) == 2 and x[0][0] != x[1][0] for x in p) and len({(x[0][0], x[1][0]) for x in p}) == 6
    bad = [f for x in p for f in x if f[0] == "malformed"]
    assert [i for i, f in enumerate(bad) if f[1]] == list(range(0, len(bad), 4))
    assert plan(spark, "eval_perm", "lookup_chain", 4, 9, False) == [[]] * 9 and plan(spark, "dev", "lookup_chain", 4, 0, False) == []


def test_targets(spark):
    """The most constrained fault chooses first; nodes and units are those of the plain stream."""
    nodes = [("n0", "kb_lookup", False, None, None), ("n1", "unit_convert", False, None, "kg"), ("n2", "warehouse_update", True, "reserve", None)]
    fits = lambda k, a: [n for n in nodes if (n[1] == "unit_convert" if k == "wrong_unit" else ((n[2] and n[3] == "reserve") if a else not n[2]) if k == "malformed" else True)]
    cases = [[("transient", False), ("wrong_unit", False)], [("rate_limit", False), ("malformed", True)], [("malformed", False), ("wrong_unit", False)], [("transient", False)], []]
    rng = random.Random(1)
    rows = [(i, hashlib.sha256(str(i).encode()).hexdigest(), nodes, rng.choice(cases)) for i in range(40)]
    df = spark.createDataFrame(rows, "task int, seed string, nodes array<struct<node:string,tool:string,mutating:boolean,action:string,unit:string>>, faults array<struct<kind:string,ambiguous:boolean>>")
    got = {r["task"]: [tuple(x) for x in r["targets"]] for r in faults.targeted(df).collect()}
    units = ["mg", "g", "lb", "oz"]
    for task, seed, _, own in rows:
        stream, taken, out = Stream(bytes.fromhex(seed)), set(), {}
        for i in sorted(range(len(own)), key=lambda i: (len(fits(*own[i])), i)):
            left = [n[0] for n in fits(*own[i]) if n[0] not in taken]
            node = left[stream.below(len(left))]
            taken.add(node)
            out[i] = (*own[i], node, units[stream.below(4)] if own[i][0] == "wrong_unit" else None)
        assert got[task] == [out[i] for i in range(len(own))]
    none = spark.createDataFrame([(1, "00" * 32, nodes[:1], [("wrong_unit", False)])], df.schema)
    with pytest.raises(Exception, match="no node is left"):
        faults.targeted(none).collect()


def test_a_plan_of_targets_stays_small(spark):
    """Neither a draw nor the plan is repeated wherever it is used: what reads targets reads a written table."""
    rows = spark.createDataFrame([("00" * 32, [("n1", "unit_convert", False, None, "kg")], [("wrong_unit", False)])], "seed string, nodes array<struct<node:string,tool:string,mutating:boolean,action:string,unit:string>>, faults array<struct<kind:string,ambiguous:boolean>>")
    read = faults.targeted(rows).select(F.posexplode("targets"))
    assert len(read._jdf.queryExecution().optimizedPlan().toString()) < 5_000 and read.count() == 1
