"""Audits fire on the fault that they are for and stay silent on a healthy run."""

import pytest

from tracewright.operators import audits, tasks

EPISODE = "tag string, ok boolean, final string, boxed_right boolean, n_calls int, predicted double, expected double, dropped int"


def run(**change):
    rows = [dict(tag="t", ok=i < 30, final=f"answer {i}", boxed_right=i < 30, n_calls=1, predicted=1.0, expected=1.0 if i < 30 else 2.0, dropped=0) for i in range(40)]
    for row in rows:
        row |= {k: v(row) for k, v in change.items()}
    return rows


@pytest.mark.parametrize(
    ("change", "summary", "want"),
    [
        ({}, (40, 0.75, 1.0), set()),
        ({"dropped": lambda r: 1}, (40, 0.75, 1.0), {("S0", "WARN")}),
        ({}, (41, 0.75, 1.0), {("S1", "BUG")}),
        ({}, (40, 0.5, 1.0), {("S2", "BUG")}),
        ({"boxed_right": lambda r: True}, (40, 0.75, 1.0), {("S3", "BUG")}),
        ({"n_calls": lambda r: 0}, (40, 0.75, 0.0), {("S4", "WARN")}),
        ({"n_calls": lambda r: 0, "final": lambda r: r["final"] + "<tool_call"}, (40, 0.75, 0.0), {("S4", "BUG")}),
        ({"expected": lambda r: 1.0}, (40, 0.75, 1.0), {("S5", "BUG")}),
        ({"final": lambda r: "same"}, (40, 0.75, 1.0), {("S6", "WARN")}),
        ({}, (40, 0.75, 0.5), {("S7", "BUG")}),
    ],
)
def test_sanity(spark, change, summary, want):
    rows = [tuple(r.values()) for r in run(**change)]
    out = audits.sanity(spark.createDataFrame(rows, EPISODE), spark.createDataFrame([("t", *summary)], "tag string, n int, accuracy double, tool_use_rate double"))
    assert {(r["code"], r["level"]) for r in out.collect()} == want


def test_dataflow(spark):
    rows = [("e", 1, 1, ["k2"], ["k1"]), ("e", 2, 2, ["5 kg"], ["k2"]), ("e", 3, 2, ["zz"], ["q"]), ("e", 4, 3, ["42"], ["5 kg"]), ("e", 5, 3, ["42"], ["42"])]
    events = spark.createDataFrame(rows, "ep string, call_id int, dec int, gives array<string>, takes array<string>")
    edges = audits.feeds(events, "ep", "dec", "gives", "takes")
    answers = spark.createDataFrame([("e", 4)], "episode string, call_id int")
    assert {r["call_id"] for r in audits.contributing(edges, answers).collect()} == {1, 2, 4}


def test_veto(spark):
    some, none = spark.range(3), spark.range(0)
    assert [audits.veto(v, c, "S8").first()["status"] for v, c in ((none, some), (some, some), (none, none))] == ["OK", "BUG", "INCONCLUSIVE"]


def test_chains_are_solvable_and_independent_of_partitioning(spark):
    labels = spark.createDataFrame([(f"t{i}", 2 + i % 5) for i in range(40)], "task_id string, horizon int")
    chains = tasks.lookup_chains(labels, b"s")
    assert tasks.walked(chains).where("solved").count() == 40
    assert sorted(map(str, chains.collect())) == sorted(map(str, tasks.lookup_chains(labels.repartition(5), b"s").collect()))


def test_warehouse(spark):
    orders = spark.createDataFrame([("o", 100.0, [("l1", "A", 2, 60.0), ("l2", "A", 1, 50.0)], {"A": 3})], "order_id string, funds double, lines array<struct<line:string,lot:string,quantity:int,total:double>>, stock map<string,int>")
    steps = ["reserve l1", "reserve l1", "reserve l2", "finalize -", "cancel l1", "cancel l1", "reserve l2", "reserve l9"]
    actions = spark.createDataFrame([("o", i, *s.split()) for i, s in enumerate(steps)], "order_id string, call_id long, action string, line string")
    got = [(r["ok"], r["error"], r["mutated"], r["replay"], r["funds"]) for r in tasks.warehouse(actions, orders).orderBy("call_id").collect()]
    assert got == [(True, None, True, False, 40.0), (True, None, False, True, 40.0), (False, "insufficient_funds", False, False, 40.0), (False, "incomplete_order", False, False, 40.0), (True, None, True, False, 100.0), (False, "unknown_token", False, False, 100.0), (True, None, True, False, 50.0), (False, "unknown_token", False, False, 50.0)]


def test_a_mean_at_the_threshold(spark, tmp_path):
    """The mean of these values is 30, to the last bit; scaled by a hundredth they were just below."""
    from tracewright.plans import ledger_queries

    values = [7.25, 19.96, 43.29, 42.67, 56.19, 25.33, 49.8, -4.49]
    rows = [(i, 1, i, "view", v, "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert [(r["rolling"], r["abort"]) for r in ledger_queries.clip_guard(spark, str(tmp_path)).orderBy("event_id").collect()] == [(None, False)] * 7 + [(30.0, True)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_dataflow_of_texts_moves_each_side_once(spark):
    df = spark.createDataFrame([("e", 1, 1, ["7", "7"], ["x"]), ("e", 1, 1, ["7"], ["x"]), ("e", 2, 2, ["y"], ["7 + 7", "7"])], "episode string, call_id int, decision_id int, gives array<string>, takes array<string>")
    feeds = audits.text_feeds(df, df)
    assert exchanges(feeds) <= 3 and [tuple(r) for r in feeds.collect()] == [("e", 1, 2)]


def test_shards_are_dealt_once_and_nameless_rows_are_nobodys(spark):
    from tracewright.operators import completeness

    shards = spark.createDataFrame([("a", ["1", None, "1"]), ("b", ["1"])], "shard string, rollouts array<string>")
    rows = spark.createDataFrame([("a", "1"), ("a", None), ("b", "1"), ("b", "1")], "shard string, rollout string")
    receipts = spark.createDataFrame([("a", 2, "d", "d", True), ("b", 2, "d", "d", True)], "shard string, rows long, digest string, rows_digest string, sealed boolean")
    gaps = completeness.shard_gaps(shards, rows, receipts)
    assert sorted(map(tuple, gaps.collect())) == [("a", "rollouts missing"), ("a", "rollouts that aren't owed"), ("b", "rollouts twice")]
    assert gaps._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1


def test_edges_are_made_once(spark):
    """The count of a group's edges and the ways along them read one written table."""
    from pyspark.sql import functions as F

    from tracewright.operators import closure

    made = spark.sparkContext.accumulator(0)
    edges = spark.sparkContext.parallelize([(1, i, i + 1) for i in range(5)], 1).map(lambda r: (made.add(1), r)[1]).toDF("grp long, node long, next long")
    start = spark.createDataFrame([(1, 0)], "grp long, node long")
    assert closure.reached(start, edges).agg(F.max("node")).first()[0] == 5 and made.value == 5


def test_few_small_labels_are_dealt_to_several_tasks(spark):
    labels = spark.range(100).selectExpr("concat('t', id) as task_id", "id % 3 + 2 as horizon").coalesce(1)
    chains = tasks.walked(tasks.lookup_chains(labels, b"s"))
    assert exchanges(chains) == 1 and {r["solved"] for r in chains.collect()} == {True}
