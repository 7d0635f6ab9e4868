"""Values in observations and references in arguments, on odd inputs."""

import json
import random

from pyspark.sql import functions as F

from tracewright.functions import values


def named_scalars(text):
    """A plain walk with a list of what is still to be looked at."""
    out = []
    for line in (text or "").split("\n"):
        try:
            top = json.loads(line) if line.strip().startswith("{") else None
        except ValueError:
            continue
        todo = [(None, top)] if isinstance(top, dict) and top.get("ok") is True else []
        while todo:
            name, x = todo.pop()
            if name in values.BOOKKEEPING:
                continue
            if isinstance(x, dict):
                todo += x.items()
            elif isinstance(x, list):
                todo += [(None, y) for y in x]
            elif name is not None and x is not None:
                out.append(str(x))
    return sorted(out)


def test_exposed_values(spark):
    rng = random.Random(3)

    def made(depth=0):
        kind = rng.randrange(9 if depth < 4 else 5)
        if kind > 6:
            return {rng.choice(["a", "b", "unit", "error", "é\"}", "c d", "status", "ok"]): made(depth + 1) for _ in range(rng.randrange(4))}
        if kind > 4:
            return [made(depth + 1) for _ in range(rng.randrange(4))]
        return rng.choice([1, 2.5, -3, "x", "a \\ \" , } ] {", "", None, True, False, "ключ", "tab\t"])

    rows = ["\n".join(json.dumps({"ok": rng.choice([True, True, False, "true"]), "v": made(), "w": made()}, ensure_ascii=bool(i % 2)) for _ in range(2)) for i in range(150)]
    rows += [None, "", "{", '{"ok":true', '[{"ok":true,"a":1}]', '  {"ok": true, "a": {"b": [1, {"c": 2}]}}  ', '{"ok":true,"value":\n{"error":"x","ok":false}', '{"ok":true,"remediation":{"a":1,"b":[{"c":2}]},"z":3}', '{"ok":true,"a":' + '{"b":' * 60 + "1" + "}" * 61]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").repartition(3)
    for r in df.select("t", values.exposed_values(F.col("t")).alias("v")).collect():
        assert sorted(r["v"]) == named_scalars(r["t"]), r["t"]


def test_resolved_arguments(spark):
    prior = json.dumps({"n1": {"ok": True, "value": 7, "record": {"code": "K", "n": 2.5, "none": None, "flag": True}}, "n2": {"value": "text"}})
    cases = [
        ({"x": {"$from": "n1"}}, {"x": 7}),
        ({"x": {"$from": "n1", "field": "code"}, "y": "plain", "z": {"a": [1, {"b": 2}]}}, {"x": "K", "y": "plain", "z": {"a": [1, {"b": 2}]}}),
        ({"x": {"$from": "n1", "field": "n", "format": "{}*4+{}"}}, {"x": "2.5*4+2.5"}),
        ({"x": {"$from": "n1", "field": "none"}}, {"x": None}),
        ({"x": {"$from": "n1", "field": "gone", "format": "<{}>"}}, {"x": "<None>"}),
        ({"x": {"$from": "n1", "field": "flag", "format": "{}"}}, {"x": "True"}),
        ({"x": {"$from": "n2", "field": "code"}}, {"x": None}),
        ({"x": {"$from": "n2", "format": ""}}, {"x": "text"}),
        ({"x": {"$from": "n3"}}, None),
        ({}, {}),
        ({"x": None, "y": {"field": "no reference"}}, {"x": None, "y": {"field": "no reference"}}),
    ]
    df = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in enumerate(cases)] + [(99, None)], "i int, a string")
    got = {r["i"]: r["r"] for r in df.select("i", values.resolved_arguments(F.col("a"), F.lit(prior)).alias("r")).collect()}
    for i, (_, want) in enumerate(cases):
        assert (got[i] if want is None else json.loads(got[i])) == want, i
    assert got[99] is None
    alone = df.where("i in (8, 9)").select("i", values.resolved_arguments(F.col("a"), F.lit(None).cast("string")).alias("r")).collect()
    assert {r["i"]: r["r"] for r in alone} == {8: None, 9: "{}"}


def test_text_feeds_are_those_of_all_pairs(spark):
    from tracewright.operators import audits

    rng = random.Random(7)
    parts = ["3", "3.0", "-3", "1,000", "1000", "1e3", "0.1", "0.1000000001", "ABCDEFGH", "xabcdefghy", "abc", "", " ", "KAB234567", "use KAB234567 now", "(3 + 4) * 2", "x3", "3.5", "5-3", "a.b", "key 1,000.", "nan", "+7", "7", "ünïcödé-long", "see ÜNÏCÖDÉ-LONG"]
    rows = [(e, c, c, [rng.choice(parts) for _ in range(rng.randrange(4))], [rng.choice(parts) + rng.choice(["", "", " ", "!", "4"]) for _ in range(rng.randrange(4))]) for e in range(40) for c in range(8)]
    df = spark.createDataFrame(rows, "episode int, call_id int, decision_id int, gives array<string>, takes array<string>")
    a = df.select("episode", F.col("call_id").alias("a"), F.explode("gives").alias("value"))
    b = df.select("episode", F.col("call_id").alias("b"), F.explode("takes").alias("taken"))
    want = a.join(b, "episode").where("a < b").where(values.feeds_match(F.col("value"), F.col("taken"))).select("episode", "a", "b").distinct().collect()
    got = audits.text_feeds(df, df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100


def test_an_observation_is_parsed_by_need(spark):
    """``ok`` is looked up in a line once, and the work on a small file of events is dealt out."""
    from tracewright.plans import verdict_queries

    plan = spark.range(1).select(F.lit(None).cast("string").alias("t")).select(values.is_error(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "schema_of_variant" not in plan
    assert "RepartitionByExpression" in verdict_queries.observed_values(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
