"""Known values and edge cases of the operators."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tracewright.functions import answers, canon, draws, numbers, stats
from tracewright.operators import episodes, gates, ledger, leakage, replay, sampling
from tracewright.sources import jsonl


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("k", "n", "want"), [(40, 50, (0.8, 0.669629, 0.887563)), (0, 0, (0, 0, 1)), (0, 9, (0, 0, None)), (9, 9, (1, None, 1))])
def test_wilson(spark, k, n, want):
    got = one(spark, *stats.wilson(F.lit(k), F.lit(n)))
    assert all(w is None or math.isclose(g, w, abs_tol=1e-6) for g, w in zip(got, want, strict=True))
    assert got[1] <= got[0] <= got[2]


def test_mcnemar_and_holm(spark):
    df = spark.createDataFrame([(1, 9), (0, 0), (600, 700)], "b int, c int")
    rows = [r[0] for r in df.select(stats.mcnemar_exact("b", "c")).collect()]
    assert (rows[0]["two_sided"], rows[0]["one_sided"]) == (22 / 1024, 11 / 1024) and rows[1]["two_sided"] == 1 and 0 < rows[2]["one_sided"] < 0.01
    p = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = [r["p_holm"] for r in stats.holm(p, "p", order=("i",)).orderBy("p").collect()]
    assert got[1] == pytest.approx(0.04) and got[1:] == sorted(got[1:]) and got[0] == 1


def test_gates_have_three_states(spark):
    state = lambda k, n: one(spark, stats.upper_gate(F.lit(k), F.lit(n), 0.03), stats.lower_gate(F.lit(k), F.lit(n), 0.6))
    assert tuple(state(0, 0)) == ("INCONCLUSIVE", "INCONCLUSIVE")
    assert state(0, 500)[0] == "PASS" and state(0, 20)[0] == "INCONCLUSIVE" and state(100, 500)[0] == "FAIL"
    assert state(500, 500)[1] == "PASS" and state(2, 4)[1] == "INCONCLUSIVE" and state(10, 500)[1] == "FAIL"
    got = one(spark, *(gates.winner(*(F.lit(x) for x in case)) for case in [(True, True, True, True, "PASS", "PASS", True), (False, True, True, True, "PASS", "PASS", False), (False, False, True, True, "PASS", "PASS", False), (False, False, True, True, "FAIL", "PASS", False), (False, False, False, False, "PASS", "PASS", True), (False, False, False, False, "PASS", "PASS", False)]))
    assert tuple(got) == (1, 2, 4, 5, 6, 7)


def test_streams_and_bootstrap(spark):
    assert gates.draws(2786983947, "ER2", 0, 6, 40).tolist() == [35, 17, 2, 0, 27, 35]
    rows = [(f"c{i % 40}", float(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "cluster string, value double")
    r = gates.bootstrap_bound(df, "cluster", F.col("value"), "X", 4000)
    same = gates.bootstrap_bound(df.repartition(7), "cluster", F.col("value"), "X", 4000)
    assert r == same and r["bound"] < r["point"] == 0.2 and r["clusters"] == 40
    assert gates.bootstrap_gate(r, 0.0) == "PASS" and gates.bootstrap_gate(r, 0.19) == "FAIL" and gates.bootstrap_gate(r, 0.0, least=41) == "INCONCLUSIVE"
    assert gates.bootstrap_bound(df.where("cluster = 'c1'"), "cluster", F.col("value"), "X")["degenerate"]
    assert sorted(draws.permutation(1, "a", 50)) == list(range(50))
    seed = F.sha2(F.col("id").cast("string"), 256)
    got = spark.range(200).select(draws.between(seed, 3, 9).alias("n"), draws.base32(seed, 50).alias("t"), draws.hex_token(seed).alias("h"), seed.alias("s")).collect()
    for r in got:  # the same bytes, taken one by one
        stream = b"".join(hashlib.sha256(bytes.fromhex(r["s"]) + i.to_bytes(8, "big")).digest() for i in range(4))
        assert r["n"] == 3 + next(b >> 5 for b in stream if b >> 5 < 7)
        assert r["t"] == "".join(draws.BASE32[b >> 3] for b in stream[:50]) and r["h"] == stream[:16].hex()


def test_answers(spark):
    cases = {"ANSWER: \\boxed{abc123}.": "abc123", "ANSWER: \\boxed{}": "\\boxed{}", "ANSWER: `abc123`\n\\boxed{zz}": "zz", "answer : a, then ANSWER: b;": "b", "\\boxed{1} and \\boxed{2}": "2", "nothing": None, "ANSWER: \\boxed{two words} x": "two words"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert [r["t"] for r in df.where(~answers.committed(F.col("t")).eqNullSafe(F.col("want"))).collect()] == []
    nums = {"24\\%": 24.0, "$1,234.": 1234.0, "x": None, " 5 ": 5.0}
    df = spark.createDataFrame(list(nums.items()), "t string, want double")
    assert df.where(~answers.number(F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    got = one(spark, answers.without_thinking(F.lit("a</think> b <think>c</think> d")), answers.thinking(F.lit("x <think> y </think> z")), answers.thinking(F.lit("y </think> z")), answers.thinking(F.lit("z")))
    assert tuple(got) == ("b d", "y", "y", "")


def test_tool_calls(spark):
    cases = {
        'x <tool_call><function=kb_lookup>\n<parameter=key>\nK1 "a"\n</parameter>\n</function></tool_call>': [("kb_lookup", '{"key":"K1 \\"a\\""}')],
        "<function=a><parameter=p>1</parameter><parameter=q>2": [("a", '{"p":"1","q":"2"}')],
        '<tool_call>{"name": "calc", "arguments": {"e":"1+1"}}</tool_call>': [("calc", '{"e":"1+1"}')],
        '<tool_call>{"name": "calc", "arguments": "{\\"e\\":1}"}': [("calc", '{"e":1}')],
        "<tool_call>{broken</tool_call>": [],
        "none": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: [tuple(c) for c in r["c"]] for r in df.select("t", answers.tool_calls(F.col("t")).alias("c")).collect()}
    assert got == cases


def test_receipts_and_canonical_json(spark):
    got = one(spark, canon.receipt(b"\xaa" * 32, F.lit("t1"), F.lit(1), F.lit('{"ok":true}')), sampling.keyed("view-cap-v1", F.lit("lookup_chain-h4"), F.lit("distill-lookup_chain-h4-0007")))
    assert tuple(got) == ("r-60ea31536c481b17e7a6b2195da52a76", "3d713b29d609ee09b8a99c886a408f9b89b7b2bf9d7683d9f793e373ea40bf9c")
    assert canon.canonical({"b": 2.0, "a": [1.5, "é", None, True]}) == '{"a":[1.5,"é",null,true],"b":2}'


def test_arithmetic(spark):
    cases = [("3 * (17 + 5) / 2", "33"), ("1/3", "0.333333"), ("2**64", str(2**64)), ("2**65", "error: exponent too large"), ("1/0", "error: division by zero"), ("-7 // 2", "-4"), ("-2 ** 2", "-4"), ("2 ** 3 ** 2", "512"), ("2 * -3", "-6"), ("7 - 2 - 1", "4"), ("(1 + 2", "error: not arithmetic"), ("1 2", "error: not arithmetic"), ("2 ** -1", "0.5"), ("1.5e1 % 4", "3")]
    df = spark.createDataFrame(cases, "e string, want string")
    assert df.where(numbers.calculated("e") != F.col("want")).count() == 0
    assert one(spark, numbers.calculated(F.lit("__import__('os')")))[0].startswith("error:")
    assert one(spark, numbers.wrong_units(F.lit("kg")))[0] == ["mg", "g", "lb", "oz"]


@pytest.mark.parametrize(("total", "weights", "want"), [(100, (34, 33, 33), [34, 33, 33]), (25, (34, 33, 33), [9, 8, 8]), (10, (1, 1, 1, 1), [3, 3, 2, 2])])
def test_apportionment(spark, total, weights, want):
    df = spark.createDataFrame(list(enumerate(weights)), "i int, w int")
    assert [r["share"] for r in sampling.apportioned(df, "w", total, ["i"]).orderBy("i").collect()] == want


def test_order_statistic_and_slices(spark):
    df = spark.range(100).withColumn("g", F.lit("a"))
    assert sampling.order_statistic(df, "id", 0.025).first()["statistic"] == 2
    with pytest.raises(Exception, match="too few"):
        sampling.cell_slice(df, ["g"], ["id"], 101).collect()
    cycle = {r["id"]: r["other"] for r in sampling.deranged(df, F.col("id"), "id").collect()}
    assert all(a != b for a, b in cycle.items()) and sorted(cycle.values()) == list(range(100))


def test_last_wins_and_gaps(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 3, "c"), (None, 4, "d")], "idx int, line int, v string")
    assert {(r["v"], r["dropped"]) for r in episodes.last_wins(df, "idx", "line").collect()} == {("b", 1), ("c", 0), ("d", 0)}
    seen = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 1)], "t int, s int")
    tasks = spark.createDataFrame([(1,), (2,)], "t int")
    assert {tuple(r) for r in episodes.rollout_gaps(seen, tasks, "t", "s", 2).collect()} == {(1, 1, "duplicate"), (1, 2, "missing"), (2, 2, "missing"), (3, 1, "extra")}


def test_ledger(spark):
    rows = [("e", i, "x", True) for i in range(3)] + [("e", 3, "y", False), ("f", 1, "x", True), ("f", 2, "x", False), ("f", 3, "x", True)]
    df = spark.createDataFrame(rows, "ep string, i int, d string, err boolean")
    assert [tuple(r) for r in ledger.repeated_errors(df, "ep", ["i"], "d", F.col("err")).collect()] == [("e", 3, 1)]
    assert {tuple(r) for r in ledger.duplicate_calls(df, "ep", "d").collect()} == {("e", 2, 4), ("f", 2, 3)}
    seq = spark.createDataFrame([("a", 1, 1, "n1"), ("a", 2, 1, "n2"), ("a", 3, 2, "n2"), ("b", 1, 1, "n2"), ("b", 2, 2, "n1")], "ep string, i int, dec int, node string")
    assert {tuple(r) for r in ledger.completed(seq, "ep", "i", "dec", "node", ["n1", "n2"]).collect()} == {("a", 2, True), ("b", 1, False)}
    j = spark.createDataFrame([("j", 1, "open"), ("j", 2, "close"), ("j", 3, "open"), ("j", 4, "heartbeat")], "j string, t int, e string")
    assert tuple(ledger.journal_state(j, "j", ["t"], "e", "t").first()) == ("j", 3, 4, False)


def test_leakage(spark):
    k = spark.createDataFrame([("id", "x", "train"), ("id", "x", "eval"), ("id", "x", "dev"), ("id", "y", "train"), ("id", "y", "train")], "kind string, v string, split string")
    assert {tuple(r)[:4] for r in leakage.crossings(k, "kind", "v", "split").collect()} == {("id", "dev", "eval", 1), ("id", "dev", "train", 1), ("id", "eval", "train", 1)}


SPEC = "episode string, plan array<string>, faults array<struct<node int, kind string, turns int>>"


def ledger_rows():
    return [("e", 1, 1, "a"), ("e", 2, 1, "b"), ("e", 3, 2, "b"), ("e", 4, 3, "b"), ("e", 5, 4, "b"), ("e", 6, 5, "c"), ("e", 7, 6, "c"), ("e", 8, 7, "a"), ("e", 9, 8, "zz")]


WANT = {1: (0, True, None, False), 2: (1, False, None, False), 3: (1, False, "rate_limit", True), 4: (1, False, "rate_limit", False), 5: (1, True, None, False), 6: (2, False, "transient", True), 7: (2, True, None, False), 8: (0, False, None, False), 9: (None, False, None, False)}


def test_replay(spark):
    calls = spark.createDataFrame(ledger_rows(), "episode string, call_id long, decision_id long, identity string")
    spec = spark.createDataFrame([("e", ["a", "b", "c"], [(1, "rate_limit", 2), (2, "transient", 0)])], SPEC)
    out = replay.replayed(calls, spec).collect()
    assert {r["call_id"]: (r["node"], r["credited"], r["fault"], r["fired"]) for r in out} == WANT
    assert {r["call_id"] for r in out if r["repeat"]} == {8}
    again = replay.replayed(calls.repartition(5), spec)
    assert replay.agreement(again, replay.replayed(calls, spec)).isEmpty()


def test_replay_as_a_stream_keeps_state_between_batches(spark, tmp_path):
    spec = spark.createDataFrame([("e", ["a", "b", "c"], [(1, "rate_limit", 2), (2, "transient", 0)])], SPEC)
    calls = spark.createDataFrame(ledger_rows(), "episode string, call_id long, decision_id long, identity string").join(spec, "episode")
    folder = str(tmp_path / "calls")
    for low, high in ((1, 3), (4, 6), (7, 9)):
        calls.where(F.col("call_id").between(low, high)).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = replay.replay_stream(stream).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["call_id"]: (r["node"], r["credited"], r["fault"], r["fired"]) for r in spark.table("replayed").collect()} == WANT


def test_json_lines(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.jsonl").write_text('{"i":1,"v":"x"}\n\n{"i":1,"v":"y"}\nnot json\n')
    good, bad = jsonl.tolerant(spark, str(path), "i int, v string")
    assert good.count() == 2 and bad.count() == 1
    assert jsonl.tolerant(spark, str(tmp_path / "none"), "i int")[0].count() == 0
    with pytest.raises(Exception):
        jsonl.strict(spark, str(path), "i int, v string").collect()
    (path / "a.jsonl").write_text('{"i":1,"v":"x"}\n\n{"i":1,"v":"y"}\n')
    ordered = jsonl.in_file_order(spark, str(path), "i int, v string")
    assert [r["v"] for r in episodes.last_wins(ordered, "i", "src_file", "line_no").collect()] == ["y"]
    out = str(tmp_path / "out")
    jsonl.write_canonical(good.select("v", "i"), out, ["i", "v"])
    assert [r["value"] for r in spark.read.text(out).orderBy("value").collect()] == ['{"i":1,"v":"x"}', '{"i":1,"v":"y"}']
    with pytest.raises(ValueError, match="lack v"):
        jsonl.write_attested(spark.createDataFrame([(1, "")], "i int, v string"), str(tmp_path / "att"), ["v"])
    (tmp_path / "sums").write_text("0" * 64 + "  ok/file\n" + "1" * 64 + "  ../bad\n")
    with pytest.raises(Exception, match="bad line"):
        jsonl.checksums(spark, str(tmp_path / "sums")).collect()
