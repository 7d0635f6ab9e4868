"""Acceptance, verdicts, gates, vetoes and completeness on made-up episodes, one defect at a time."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.functions import canon, structure, values
from tracewright.operators import acceptance, audits, census, closure, completeness, registered, verifier, vetoes, views
from tracewright.sources import files, tables


def column(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i int, {schema}").orderBy("_i").select(*columns).collect()]


def test_answers_by_kind(spark):
    rows = [("\\boxed{`AB\\_c`}.", "ab_c", "token"), ("\\boxed{24\\%}", "24", "integer"), ("\\boxed{zz}", "ab", "token"), ("\\boxed{3}", "4", "integer"), ("none", "4", "integer"), ("\\boxed{x}", None, "token")]
    got = column(spark, rows, "f string, t string, k string", values.boxed_right(F.col("f"), F.col("t"), F.col("k")), values.rescored(F.lit(True), F.col("f"), F.col("t"), F.col("k")))
    assert got == [(True, True), (True, True), (False, True), (False, False), (None, True), (None, True)]
    pairs = [("1,000", "1000", "integer"), (" Ab ", "aB", "token"), ("1.00001", "1", "integer"), (None, "1", "integer")]
    assert column(spark, pairs, "a string, b string, k string", values.answers_equal(F.col("a"), F.col("b"), F.col("k")), values.answers_match(F.col("a"), F.col("b"))) == [(True, True), (True, False), (False, True), (False, False)]
    assert column(spark, [("7", None), ("ab", ""), ("ab", "Integer ")], "t string, k string", values.answer_kind(F.col("k"), F.col("t"))) == [("integer",), ("token",), ("integer",)]


def test_values_in_texts(spark):
    rows = [("3", "3*4"), ("3", "13"), ("3.0", "3"), ("ABCDEFGH", "xabcdefghy"), ("ABC", "xabcy"), ("", "x"), ("1.5", "1.55")]
    assert column(spark, rows, "p string, c string", values.feeds_match(F.col("p"), F.col("c"))) == [(True,), (False,), (True,), (True,), (False,), (False,), (False,)]
    observed = '{"ok":true,"value":7,"unit":"kg","record":{"code":"XY","deep":[{"n":1.5},4],"status":"s"}}\n{"ok":false,"error":"e","x":1}\nnot json\nreceipt: r-1 '
    errors = ['{"ok": false}', '{"ok":"false"}', "x\n {\"ok\":false,\"a\":1}", '{"ok":true,"value":', None]
    assert column(spark, [(observed,)], "t string", values.exposed_values(F.col("t")), values.observation(F.col("t")))[0][0] == ["7", "XY", "1.5"]
    o = column(spark, [(observed,), ('{"ok":true,"value":\n{"a":1}',), (None,)], "t string", values.observation(F.col("t")))
    assert [(len(x[0]["objects"]), x[0]["receipt"], x[0]["cut_off"]) for x in o] == [(2, "r-1", False), (1, None, True), (0, None, False)]
    assert column(spark, [(e,) for e in errors], "t string", values.is_error(F.col("t"))) == [(True,), (False,), (True,), (False,), (False,)]
    assert column(spark, [("got KAB234567 and 5", "use KAB234567"), ("5 kg", "5.0 * 2"), ("", "5"), ("x", "y")], "a string, b string", values.consumes(F.col("a"), F.col("b"))) == [(True,), (True,), (False,), (False,)]


def test_identities(spark):
    calls = [("unit_convert", '{"value":" 2000 ","from_unit":" kg","recovery_token":"t"}'), ("unit_convert", '{"from_unit":"kg","value":2000}')]
    got = column(spark, calls, "t string, a string", values.call_digest(F.col("t"), F.col("a")))
    want = hashlib.sha256(b'{"args":{"from_unit":"kg","value":2000},"tool":"unit_convert"}').hexdigest()
    assert got == [(want,), (want,)]
    assert column(spark, [('{"x":{"$from":"n1","field":"code"},"y":{"$from":"n1","format":"{}*4"},"z":1}', '{"n1":{"value":3,"record":{"code":"K"}}}'), ('{"x":{"$from":"n9"}}', "{}")], "a string, p string", values.resolved_arguments(F.col("a"), F.col("p"))) == [('{"x":"K","y":"3*4","z":1}',), (None,)]
    assert column(spark, [("1200 * 7 + 5",), ("(48+91)*3",), ("-2 ** 2",), ("f(x)",)], "t string", structure.expression_shape(F.col("t"))) == [("((c*c)+c)",), ("((c+c)*c)",), ("(-(c**c))",), ("?",)]
    roles = [F.lit(None).cast("string")]
    described = structure.structure(F.lit("typed_relay"), F.lit(2), F.array(F.lit("kb_lookup"), F.lit("calculator")), F.array(structure.node_role(F.lit("kb_lookup"), F.lit("{}"), F.lit('{"b":1,"a":2}')), structure.node_role(F.lit("calculator"), F.lit('{"expression":"1+2"}'), *roles)))
    text, cluster = spark.range(1).select(described, structure.cluster_id(described)).first()
    value = {"family": "typed_relay", "horizon": 2, "pattern": "kb>calc", "edges": [[0, 1]], "roles": [{"t": "kb", "f": ["a", "b"]}, {"t": "calc", "e": "(c+c)"}]}
    assert text == canon.canonical(value) and cluster == "tc-" + hashlib.sha256(text.encode()).hexdigest()[:16]
    body = canon.canonical({"a": 1, "b": [2]})
    seal = hashlib.sha256(body.encode()).hexdigest()
    whole = json.dumps({"b": [2], "a": 1, "receipt_sha256": seal})
    assert column(spark, [(whole,), (whole.replace("2", "3", 1),), ("{}",)], "r string", structure.seal_holds(F.col("r"))) == [(True,), (False,), (False,)]
    shown = spark.range(1).select(structure.envelope(F.lit("rate_limit"), F.lit("t0"), 2), structure.envelope(F.lit("wrong_unit"), F.lit("t0")), structure.remediation(F.lit("rate_limit"))["later_decision"], structure.eligible_nodes(F.array(F.lit("kb_lookup"), F.lit("unit_convert")), F.lit("wrong_unit"))).first()
    assert json.loads(shown[0])["remediation"]["retry_after_turns"] == 2 and tuple(shown)[1:] == (None, True, [1])


TRAJECTORY = dict(exhausted=False, truncated=False, final="so \\boxed{5}", truth="5", n_calls=2, tools=["calculator"], tool_error=False)


def test_each_defect_of_a_trajectory_has_its_reason(spark):
    cases = [({}, None), ({"exhausted": True}, "max_turns_exhausted"), ({"truncated": True}, "truncated_final"), ({"final": ""}, "no_final"), ({"final": "</think> \\boxed{5}"}, "stray_think"), ({"final": "5"}, "no_box"), ({"truth": "6"}, "wrong"), ({"n_calls": 0}, "no_tool"), ({"n_calls": 7}, "too_many_calls"), ({"final": "w " * 130 + "\\boxed{5}"}, "final_too_long"), ({"tools": ["kb_lookup"]}, "irrelevant_tool"), ({"tool_error": True}, "tool_error"), ({"exhausted": True, "final": ""}, "max_turns_exhausted")]
    rows = [tuple((TRAJECTORY | c).values()) for c, _ in cases]
    schema = "exhausted boolean, truncated boolean, final string, truth string, n_calls int, tools array<string>, tool_error boolean"
    assert [r[0] for r in column(spark, rows, schema, acceptance.trajectory_reason(6))] == [want for _, want in cases]
    assert column(spark, rows[11:12], schema, acceptance.trajectory_reason(6, allow_tool_error=True)) == [(None,)]


PROVENANCE = dict(gpu_execution=True, producer=None, gpu_uuid="u", gpu_name="g", cuda_visible_bytes="1", run_id="r", engine_fingerprint="e", enable_thinking_effective="false", config_hash="c", runtime_manifest_sha256="m", session_id="s")
RECORD = dict(provenance=PROVENANCE, exhausted=False, truncated=False, unknown_tool=False, arg_error=False, call_cap=False, final="ANSWER: K1", messages=[("tool", "fine")], consistent=True, certified=True, replayed=True, calls=4, horizon=4, slack=2, redundant=0, faults=["wrong_unit"], fired=True, recovered=True, recovery="ok", fault_decision=1, recovery_decision=2, retries=0, trapped="9", answer="8")
RECORD_SCHEMA = f"provenance struct<gpu_execution:boolean,{','.join(f'{k}:string' for k in list(PROVENANCE)[1:])}>, exhausted boolean, truncated boolean, unknown_tool boolean, arg_error boolean, call_cap boolean, final string, messages array<struct<role:string,content:string>>, consistent boolean, certified boolean, replayed boolean, calls int, horizon int, slack int, redundant int, faults array<string>, fired boolean, recovered boolean, recovery string, fault_decision int, recovery_decision int, retries int, trapped string, answer string"


def test_each_defect_of_a_record_has_its_reason(spark):
    cpu = dict.fromkeys(PROVENANCE) | {"gpu_execution": False, "producer": "p"}
    cases = [
        ({}, None), ({"provenance": cpu}, None), ({"provenance": None}, "missing_provenance:provenance_absent"), ({"provenance": PROVENANCE | {"session_id": ""}}, "missing_provenance:session_id"), ({"provenance": cpu | {"gpu_name": "x"}}, "missing_provenance:gpu_name_on_a_cpu_attestation"),
        ({"exhausted": True}, "max_decisions_exhausted"), ({"truncated": True}, "truncated_final"), ({"unknown_tool": True}, "unknown_tool"), ({"arg_error": True}, "bad_call_arguments"), ({"call_cap": True}, "call_cap_hit"), ({"final": None}, "no_final"), ({"final": "a</think>"}, "stray_think"), ({"final": "K1"}, "no_committed_answer"),
        ({"messages": [("user", "\\boxed{1}"), ("tool", "x \\boxed{1}")]}, "answer_leakage"), ({"messages": [("tool", "y" * 60)]}, "tool_output_too_long"), ({"consistent": False}, "verifier_runtime_disagreement"), ({"certified": None}, "verifier_rejected"),
        ({"calls": 7}, "call_count"), ({"redundant": 2}, "too_many_redundant_calls"), ({"fired": False}, "fault_not_fired"), ({"recovered": False}, "recovery_not_verified"), ({"recovery": "blind_retry"}, "recovery_blind_retry"), ({"recovery_decision": 9}, "recovery_too_late"), ({"retries": 3}, "too_many_retries"), ({"trapped": "8.0"}, "trapped_value_used"), ({"replayed": None}, "replay_failed"), ({"faults": [], "fired": False}, None),
    ]
    rows = [tuple(tuple(v.values()) if isinstance(v, dict) else v for v in (RECORD | c).values()) for c, _ in cases]
    assert [r[0] for r in column(spark, rows, RECORD_SCHEMA, acceptance.record_reason(50, 1, 3, 2))] == [want for _, want in cases]


def test_pools_controls_and_shards(spark):
    specs = spark.createDataFrame([(1, "typed_relay", 4, ["transient"], ["kb_lookup", "unit_convert", "calculator"], 9), (2, "lookup_chain", 8, [], ["kb_lookup"], 11), (3, "fulfillment", 8, ["malformed"], [], 11)], "task_id int, family string, horizon int, faults array<string>, tools array<string>, max_decisions int")
    pools = acceptance.axis_pool(specs)
    assert {(r["task_id"], r["axis"], len(r["faults"]), r["max_decisions"]) for r in pools.collect()} == {(1, "recovery", 1, 9), (3, "recovery", 1, 11), (1, "orchestration", 0, 7), (2, "h8", 0, 11)}
    need = spark.createDataFrame([("recovery", 2), ("h8", 3), ("none", 1)], "axis string, needed int")
    cap = {tuple(r) for r in acceptance.axis_capacity(pools.withColumn("cell", F.col("family")), need).collect()}
    assert cap == {("recovery", 2, 2, 1, True), ("h8", 1, 3, 3, False), ("none", 0, 1, None, False)}
    kb = spark.createDataFrame([(1, {"a": "x", "b": "y"}, "b"), (2, {"c": "z"}, None)], "task_id int, kb map<string,string>, hidden_key string")
    assert {(r["task_id"], r["control"], len(r["kb"])) for r in acceptance.controlled(kb, kb.where("task_id = 2")).collect()} == {(1, "none", 2), (2, "none", 1), (1, "redacted", 1), (2, "permuted", 1)}
    assert [r["id"] for r in acceptance.shard(spark.range(10), "id", 4, 1).collect()] == [1, 5, 9]


EVENT = "episode string, call_id long, decision_id long, tool string, args_digest string, exposed_text string, exposed_digest string, oracle_node string, exposed_canonical boolean, credited boolean, fault_triggered boolean, fault_type string, state_mutated boolean, replay boolean, token_provided string, recovery_token string, requested_unit string, token_known boolean, ok boolean, unsafe boolean, receipt string, receipt_ok boolean"
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def event(episode, call, node, **more):
    own = dict(episode=episode, call_id=call, decision_id=call, tool="kb_lookup", args_digest=f"a{node}", exposed_text='{"ok":true,"value":"%s"}' % (f"ANSWERVALUE{node}" if node == "n2" else node), exposed_digest=f"d{call}", oracle_node=node, exposed_canonical=True, credited=True, fault_triggered=False, fault_type=None, state_mutated=False, replay=False, token_provided=None, recovery_token=None, requested_unit=None, token_known=True, ok=True, unsafe=False, receipt="r-" + f"{call:032x}", receipt_ok=True)
    return tuple((own | more)[n] for n in NAMES)


def faulty(episode, call, node, kind, **more):
    return event(episode, call, node, exposed_canonical=False, credited=False, fault_triggered=True, fault_type=kind, recovery_token="T", exposed_text='{"ok":false}', ok=False, **more)


def test_strict_verdicts(spark):
    good = lambda e: [event(e, 1, "n1"), event(e, 2, "n2")]
    final = "ANSWER: ANSWERVALUEn2"
    cases = {
        "good": (good("good"), {}, []),
        "wrong": (good("wrong"), {"final": "ANSWER: other"}, ["answer_ok", "hallucinated"]),
        "silent": (good("silent"), {"final": "ANSWERVALUEn2"}, ["answer_ok"]),
        "missing": ([event("missing", 2, "n2", credited=False)], {}, ["all_nodes"]),
        "same_decision": ([event("same_decision", 1, "n1"), event("same_decision", 2, "n2", decision_id=1, credited=False)], {}, ["all_nodes"]),
        "disagrees": ([event("disagrees", 1, "n1", credited=False), event("disagrees", 2, "n2")], {}, ["consistent"]),
        "unsafe": ([*good("unsafe"), event("unsafe", 3, None, credited=False, unsafe=True)], {}, ["safe"]),
        "token": ([event("token", 1, "n1", token_known=False), event("token", 2, "n2")], {}, ["tokens_ok"]),
        "over": ([*good("over"), *(event("over", c, None, credited=False) for c in range(3, 8))], {}, ["within_budget", "runaway"]),
        "receipt": ([event("receipt", 1, "n1", receipt_ok=False), event("receipt", 2, "n2")], {}, ["receipts_ok"]),
        "unsourced": ([event("unsourced", 1, "n1"), event("unsourced", 2, "n2", exposed_text='{"ok":true}')], {}, ["unsourced", "hallucinated"]),
        "stopped": (good("stopped"), {"termination": "wall_clock"}, ["runaway"]),
        "cites": (good("cites"), {"final": final + " r-" + "f" * 32}, ["hallucinated"]),
        "state": (good("state"), {"state_ok": False}, ["state_ok"]),
        "recovers": ([faulty("recovers", 1, "n1", "transient"), event("recovers", 2, "n1", token_provided="T"), event("recovers", 3, "n2")], {"fault": "transient"}, []),
        "blind": ([faulty("blind", 1, "n1", "transient"), event("blind", 2, "n1"), event("blind", 3, "n2")], {"fault": "transient"}, ["unrecovered"]),
        "early": ([faulty("early", 1, "n1", "rate_limit"), event("early", 2, "n1", token_provided="T", decision_id=1), event("early", 3, "n2")], {"fault": "rate_limit"}, ["unrecovered"]),
        "unit": ([faulty("unit", 1, "n1", "wrong_unit", requested_unit="kg"), event("unit", 2, "n1", tool="unit_convert", requested_unit="kg"), event("unit", 3, "n2")], {"fault": "wrong_unit"}, []),
        "unfired": (good("unfired"), {"fault": "transient"}, ["unrecovered"]),
    }
    events = spark.createDataFrame([e for es, _, _ in cases.values() for e in es], EVENT)
    specs = spark.createDataFrame([(k, ["n1", "n2"], 4, 6, "answervaluen2", "token", o.get("state_ok", True), [(o["fault"], "n1", False)] if "fault" in o else []) for k, (_, o, _) in cases.items()], "episode string, nodes array<string>, max_calls int, max_decisions int, answer string, answer_kind string, state_ok boolean, faults array<struct<fault_type:string,target_node:string,ambiguous:boolean>>")
    finals = spark.createDataFrame([(k, o.get("final", final), 0, o.get("termination", "answered")) for k, (_, o, _) in cases.items()], "episode string, final string, tool_messages int, termination string")
    out = verifier.verdicts(events, specs, finals).persist()
    rows = {r["episode"]: r for r in out.collect()}
    assert {k: r["reasons"] for k, r in rows.items()} == {k: want for k, (_, _, want) in cases.items()}
    assert all(r["certified"] == (not r["reasons"]) for r in rows.values())
    assert {k: rows[k]["recovery_reason"] for k in ("recovers", "blind", "early", "unit", "unfired", "good")} == {"recovers": "ok", "blind": "blind_retry", "early": "blind_retry", "unit": "ok", "unfired": "not_exposed", "good": None}
    recorded = out.select("episode", F.col("answer_ok").alias("raw_success"), (F.col("receipts_ok") & (F.col("episode") != "good")).alias("receipts_ok"), "runaway", "hallucinated", "answer_call", (F.col("certified") | (F.col("episode") == "stopped")).alias("certified"), F.when(F.col("episode") == "unsafe", F.array().cast("array<string>")).otherwise(F.col("reasons")).alias("reasons"))
    ledger = {r["episode"]: r for r in verifier.certified_from_ledger(out, recorded).collect()}
    assert ledger["good"]["mismatches"] == ["receipts_ok"] and ledger["stopped"]["contradiction"] and ledger["blind"]["strict_refusal"] and ledger["unsafe"]["unexplained"]
    calls = events.where("fault_triggered").groupBy("episode").agg(F.min("call_id").alias("fault_call"))
    labels = {r["episode"]: r["reason"] for r in verifier.recovery_labels(out, calls).collect()}
    assert (labels["good"], labels["unfired"], labels["blind"], labels["recovers"]) == ("not_assigned", "not_exposed", "blind_retry", "ok")
    out.unpersist()


def test_long_dataflow_and_absent_information(spark):
    edges = spark.createDataFrame([("e", i, i + 1) for i in range(1, 70)], "episode string, a int, b int")
    assert audits.contributing(edges, spark.createDataFrame([("e", 70)], "episode string, call_id int")).count() == 70
    assert closure.reached(spark.createDataFrame([(1, "x")], "grp int, node string"), spark.createDataFrame([(1, "x", "y"), (1, "y", "x")], "grp int, node string, next string")).count() == 2
    specs = spark.createDataFrame([(1, "start KAB234567", "SECRET99", "KGONE22222", {"KAB234567": "see KCD234567", "KCD234567": "nothing"}), (2, "start KAB234567", "SECRET99", None, {"KAB234567": "see KCD234567", "KCD234567": "secret99"}), (3, "go", "SECRET99", None, {"KCD234567": "secret99"})], "task_id int, prompt string, answer string, hidden_key string, kb map<string,string>")
    assert {tuple(r) for r in verifier.absent_information(specs).collect()} == {(2, "the answer can be read")}


def episodes(spark, n=700, **flags):
    """n tasks of the core stratum in both arms and conditions; ``flags`` are functions of (arm, condition, i)."""
    base = dict(certified=lambda a, c, i: True, recovered=lambda a, c, i: c == "faulted", orchestrated=lambda a, c, i: True, runaway=lambda a, c, i: False, hallucinated=lambda a, c, i: False)
    kinds = ["transient", "rate_limit", "malformed", "wrong_unit", "malformed", "wrong_unit"]
    rows = [(a, c, "none", i, "lookup_chain", 4, "main", f"c{i % 50}", i % 6, True, kinds[i % 6] if c == "faulted" else None, *((base | flags)[k](a, c, i) for k in base), 4, "answered") for i in range(n) for a in ("BP", "TP") for c in ("clean", "faulted")]
    return spark.createDataFrame(rows, "arm string, condition string, control string, task_id int, family string, horizon int, split string, cluster string, pattern_id int, all_tools boolean, fault_class string, certified boolean, recovered boolean, orchestrated boolean, runaway boolean, hallucinated boolean, n_calls int, termination string")


def test_gates_and_floors(spark):
    bounds = spark.createDataFrame([("ER2", 0.06, False), ("ER4", -0.02, False)], "gate string, bound double, degenerate boolean")
    status = lambda e: {r["gate"]: (r["status"], r["measured"]) for r in registered.gates(e, bounds).collect()}
    e = episodes(spark, 1260)
    got = status(e)
    assert len(got) == 16 and {k: got[k][0] for k in ("ER1", "ER2", "ER3", "ER4", "ER5", "ER6", "ER7", "ER8", "MT1", "MT2", "HR1")} == {"ER1": "PASS", "ER2": "PASS", "ER3": "PASS", "ER4": "PASS", "ER5": "PASS", "ER6": "PASS", "ER7": "PASS", "ER8": "PASS", "MT1": "INCONCLUSIVE", "MT2": "INCONCLUSIVE", "HR1": "INCONCLUSIVE"}
    worse = status(episodes(spark, 1260, recovered=lambda a, c, i: c == "faulted" and (a == "BP" or i % 6 not in (2, 4)), runaway=lambda a, c, i: i % 10 == 0))
    assert (worse["ER5"][0], worse["ER6"][0], worse["ER8"][0]) == ("FAIL", "FAIL", "FAIL")
    few = status(episodes(spark, 60))
    assert few["ER1"][0] == few["ER3"][0] == few["ER2"][0] == "INCONCLUSIVE" and few["ER3"][1] == few["ER2"][1] == "PASS"
    floors = {(r["arm"], r["floor"]): r["status"] for r in registered.floors(episodes(spark, 100, certified=lambda a, c, i: a == "TP" or i % 2 == 0)).collect()}
    assert floors["TP", "F1"] == floors["TP", "F5"] == floors["BP", "F3"] == "PASS" and floors["BP", "F1"] == "FAIL"
    assert {r["status"] for r in registered.floors(e.where("condition = 'clean'")).collect()} == {"INCONCLUSIVE"}


def test_smaller_decisions(spark):
    groups = spark.createDataFrame([("a", 4, True, True, 2, 0, False, False, False)] * 5 + [("b", 4, True, True, 2, 1, False, False, False)] * 4 + [("c", 4, True, True, 4, 0, False, False, False)] * 3 + [("d", 4, True, True, 2, 0, True, False, False)], "cell string, n int, varies boolean, disagree boolean, successes int, clipped int, unsafe boolean, inconsistent boolean, replay_failed boolean")
    assert {r["cell"]: r["eligible"] for r in registered.eligible_cells(groups, "cell").collect()} == {"a": True, "b": False, "c": False, "d": False}
    tags = spark.createDataFrame([("base", 100, 81, 3.0, 5, 20, 100), ("rssft", 100, 92, 2.0, 1, 3, 100), ("rsgrpo", 100, 95, 2.0, 1, 3, None)], "tag string, n int, right int, calls_mean double, runaway int, no_box int, traced int")
    assert {r["gate"]: r["status"] for r in registered.report_gates(tags).collect()} == {"G1": "PASS", "G2": "PASS", "G3": "PASS", "G4": "PASS", "G5": "SKIP"}
    stages = registered.committed_minutes(spark.createDataFrame([("eval:BP.clean", 6.0, None), ("train", 90.0, 95.0)], "stage string, nominal double, declared double"), spark.createDataFrame([("eval", 2400.0)], "stage string, minutes double"))
    assert {(r["stage"], r["source"], r["allowed"]) for r in registered.budget_guard(stages, 10.0, 48.0).collect()} == {("eval:BP.clean", "committed", False), ("train", "declared", True)}
    plan = spark.createDataFrame([("a", "run", True, None, None), ("b", "run", False, None, None), ("c", "skip", False, "", None), ("d", "skip", False, "no variance", "x"), ("e", None, True, None, None)], "stage string, disposition string, eligible boolean, reason string, checkpoint string")
    assert {r["stage"] for r in registered.stage_disposition(plan).collect()} == {"b", "c", "d", "e"}
    arm = lambda f, n: spark.createDataFrame([(i if i < n else None, f(i)) for i in range(n + 2)], "k int, ok boolean")
    r = registered.paired_test(arm(lambda i: i < 9, 40), arm(lambda i: i >= 30, 40), "k", "ok").first()
    assert (r["n_pairs"], r["b"], r["c"]) == (40, 9, 10) and r["p"] == pytest.approx(1.0)
    assert registered.paired_test(arm(bool, 9), arm(bool, 9), "k", "ok").count() == 0
    assert registered.paired_test(arm(lambda i: True, 60), arm(lambda i: i >= 30, 60), "k", "ok").first()["p"] == pytest.approx(4.3e-8, rel=0.05)
    lost = census.shortfall(spark.createDataFrame([("a", 10, 4, 1), ("b", 0, 0, 2), ("c", 9, 3, 0)], "stratum string, rows int, kept int, dropped int"), 2.0)
    assert {(r["stratum"], r["rows_lost"]) for r in lost.collect()} == {("a", 2), ("b", 5)}


def test_vetoes(spark):
    schema = "arm string, condition string, control string, task_id int, family string, budgets int, raw_success boolean, certified boolean, n_decisions int, termination string, receipts_ok boolean, answer string, committed string, base_id string, prompt_sha256 string, adapter string, run_id string, gpu_uuid string, engine_fingerprint string"
    own = dict(arm="BP", condition="clean", control="none", task_id=1, family="f", budgets=1, raw_success=True, certified=True, n_decisions=3, termination="answered", receipts_ok=True, answer="x", committed="x", base_id="m", prompt_sha256="p", adapter=None, run_id="r", gpu_uuid="u", engine_fingerprint="e")
    frame = lambda *rows: spark.createDataFrame([tuple((own | r).values()) for r in rows], schema)
    details = lambda df: sorted(r["detail"] for r in df.collect())
    tp = {"arm": "TP", "adapter": "ck"}
    pair = frame({}, tp)
    assert details(vetoes.pairing(pair, fields=("budgets",))) == []
    assert details(vetoes.pairing(frame({}, tp | {"budgets": 2}, {"task_id": 2}), fields=("budgets",))) == ["budgets differ", "only one arm has the task"]
    redacted = frame({"control": "redacted"}, {"control": "redacted", "raw_success": False, "certified": False, "n_decisions": 0}, {"control": "redacted", "raw_success": False, "certified": False, "arm": "TP"})
    assert details(vetoes.absent_information(redacted)) == ["never ran a decision", "succeeds without the information"]
    assert {tuple(r) for r in vetoes.absent_coverage(redacted.union(pair), 2).collect()} == {("f", "BP", 1), ("f", "TP", 1)}
    assert details(vetoes.receipts(frame({}, {"receipts_ok": None}))) == ["invalid receipts"]
    specs = spark.createDataFrame([(1, "a", "b", "k", False), (2, "a", "a", "k", False), (3, "a", None, None, False), (4, "a", None, None, True)], "task_id int, answer string, mutated_answer string, hidden_key string, sensitive boolean")
    assert details(vetoes.counterfactual(frame({"control": "permuted", "committed": "y"}, {"control": "permuted"}), specs)) == ["insensitive to the hidden value", "no hidden key", "succeeds without the permuted answer"]
    assert {tuple(r) for r in vetoes.attrition(pair, spark.range(1, 3).select(F.col("id").cast("int").alias("task_id"))).collect()} == {("BP", "clean", 1), ("TP", "clean", 1), ("BP", "faulted", 2), ("TP", "faulted", 2)}
    assert details(vetoes.control_integrity(pair, "m", ("p",), "p", "ck")) == []
    assert details(vetoes.control_integrity(frame({"adapter": "z"}, tp | {"adapter": "other"}), "m2", ("q",), "p", "ck")) == ["adapter in a prompt-only arm", "adapter isn't the locked one", "another base", "another base", "prompt isn't registered", "prompt isn't registered"]
    required = ("run_id", "gpu_uuid", "engine_fingerprint")
    assert details(vetoes.fingerprints(pair, required, {"gpu_uuid": "u"})) == [] and details(vetoes.unprinted(frame({"gpu_uuid": None}), required)) == ["gpu_uuid is missing"]
    assert details(vetoes.fingerprints(frame({}, tp | {"gpu_uuid": "v"}), required, {})) == ["gpu_uuid differs from TP", "one run on more than one card"]
    oracle = spark.createDataFrame([(1, 4, "a", 4, "a"), (2, 4, "a", 3, None), (3, 4, "a", 4, "b")], "task_id int, horizon int, answer string, reached int, derived string")
    assert details(vetoes.oracle(oracle)) == ["another answer", "not all nodes are reached"]
    events = spark.createDataFrame([("BP", "faulted", "none", i, c, "d", True) for i, c in ((1, 1), (2, 1), (2, 2), (3, 9))], "arm string, condition string, control string, task_id int, call_id int, args_digest string, fault_triggered boolean")
    injected = frame(*({"condition": "faulted", "task_id": i} for i in (1, 2, 3, 4))).withColumns({"planned_digest": F.lit("d"), "fault_node": F.lit(0), "horizon": F.lit(4), "max_calls": F.lit(10)})
    assert details(vetoes.injection(injected, events)) == ["can't be recovered from", "fires more than once"]
    checked = spark.createDataFrame([("S8", 2), ("S13", 0), ("S19", 2)], "veto string, n_checked int")
    assert {(r["veto"], r["status"]) for r in vetoes.table(vetoes.receipts(frame({"receipts_ok": False})).withColumn("veto", F.lit("S8")), checked, vetoes.unprinted(frame({"gpu_uuid": None}), required)).collect()} == {("S8", "BUG"), ("S13", "INCONCLUSIVE"), ("S19", "INCONCLUSIVE")}


def test_completeness(spark):
    gaps = lambda df: sorted((r["key"], r["gap"]) for r in df.collect())
    shards = spark.createDataFrame([("s1", ["a", "b"]), ("s2", ["c"])], "shard string, rollouts array<string>")
    rows = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "c"), ("s2", "z")], "shard string, rollout string")
    receipts = spark.createDataFrame([("s1", 2, "x", "x", True), ("s2", 1, "x", "y", False)], "shard string, rows long, digest string, rows_digest string, sealed boolean")
    assert gaps(completeness.shard_gaps(shards, rows, receipts)) == [("s1", "rollouts missing"), ("s1", "rollouts twice"), ("s2", "another number of rows"), ("s2", "bytes differ"), ("s2", "rollouts that aren't owed"), ("s2", "seal doesn't hold")]
    f = lambda *r: spark.createDataFrame(r, "path string, sha256 string")
    assert gaps(completeness.frozen_gaps(f(("a", "1"), ("b", "1"), ("c", "1")), f(("a", "1"), ("b", "2"), ("d", "1")))) == [("b", "changed"), ("c", "removed"), ("d", "added")]
    views = spark.createDataFrame([("r1", "terminal", "x"), ("r2", "pivot", "x"), ("r3", "pivot", "y")], "row_id string, view string, source string")
    meta = spark.createDataFrame([("r1", "x"), ("r3", "x")], "row_id string, source string")
    assert gaps(completeness.view_gaps(views, meta, 4, 9, 0.5)) == [("corpus", "too few rows"), ("corpus", "too few terminal rows"), ("r2", "no metadata"), ("r3", "another source")]
    traces = spark.createDataFrame([("f1", "c", "p", "u"), ("f1", "old", "q", ""), ("f2", "c", "p", "u")], "file string, contract string, fingerprint string, gpu_uuid string")
    assert gaps(completeness.trace_gaps(traces, "c", ("gpu_uuid",))) == [("f1", "more than one fingerprint"), ("f1", "rows without hardware"), ("f1", "stale rows")]
    specs = spark.createDataFrame([(1, "train", 3, "k", "token"), (2, "eval", 11, "k", "token"), (3, "eval", 2, "5", "integer"), (3, "train", 3, "5", "integer")], "task_id int, split string, template_id int, answer string, answer_kind string")
    ranges = spark.createDataFrame([("train", 0, 9), ("eval", 10, 11)], "split string, low int, high int")
    assert gaps(completeness.template_isolation(specs, ranges)) == [("3", "id used twice"), ("3", "wording out of range"), ("k", "answer in two splits")]
    values_of = lambda *r: spark.createDataFrame(r, "task_id int, family string, value string")
    assert gaps(completeness.permutation_gaps(values_of((1, "f", "a"), (2, "f", "b")), values_of((1, "f", "b"), (2, "f", "a")))) == []
    assert gaps(completeness.permutation_gaps(values_of((1, "f", "a"), (2, "f", "b")), values_of((1, "f", "c")))) == [("2", "no permuted task"), ("f/a", "values differ"), ("f/b", "values differ"), ("f/c", "values differ")]
    node = lambda n, *d: (n, "t", list(d))
    suite = [(1, 2, [node("n1"), node("n2", "n1")], "c", "c", "d", "d", True, True, True, False, "ask", "KEY9", "token"), (2, 3, [node("n1", "zz"), node("n1")], "c", "e", "d", "f", None, False, False, None, "ask key9", "KEY9", "token")]
    checks = spark.createDataFrame(suite, "task_id int, horizon int, nodes array<struct<node:string,tool:string,depends:array<string>>>, cluster string, recomputed_cluster string, digest string, regenerated_digest string, oracle_ok boolean, missing_node_rejected boolean, same_decision_rejected boolean, miss_leaks boolean, prompt string, answer string, answer_kind string")
    found = gaps(completeness.suite_checks(checks))
    assert {k for k, _ in found} == {"2"} and len(found) == 10
    sizes = spark.createDataFrame([("t", "f", 4, 2), ("t", "f", 8, 1)], "split string, family string, horizon int, n int")
    assert gaps(completeness.suite_sizes(spark.createDataFrame([("t", "f", 4), ("t", "g", 4)], "split string, family string, horizon int"), sizes)) == [("t/f/4", "another size"), ("t/f/8", "another size"), ("t/g/4", "not registered")]
    many = spark.createDataFrame([(f"p{i:02d}", s) for i, s in enumerate([5, 5, 1, 20, 3, 3, 3])], "path string, size long")
    assert [r["batch"] for r in completeness.batches(many, "path", 2, 10).orderBy("path").collect()] == [0, 0, 1, 2, 3, 3, 4]
    with pytest.raises(ValueError, match="changed"):
        completeness.require(completeness.frozen_gaps(f(("a", "1")), f(("a", "2"))), "frozen")
    journal = spark.createDataFrame([("s", 1, "open"), ("s", 61, "beat"), ("t", 1, "open"), ("t", 9, "close")], "session string, at int, event string").withColumn("at", F.col("at").cast("timestamp"))
    assert [(r["session"], r["charge_s"]) for r in completeness.open_sessions(journal, spark.createDataFrame([("s", 20.0)], "session string, elapsed_s double")).collect()] == [("s", 40.0)]
    artifacts = spark.createDataFrame([("a", "d", ("x", "r1"), None, ("d", "r3")), ("b", "d", None, None, None)], "artifact string, digest string, sidecar struct<digest:string,receipt:string>, own struct<digest:string,receipt:string>, embedded struct<digest:string,receipt:string>")
    assert {tuple(r) for r in completeness.resolved_receipts(artifacts).collect()} == {("a", "r3", "embedded"), ("b", None, None)}
    m = spark.createDataFrame([("e", i, r) for i, r in enumerate(["user", "assistant", "tool", "assistant", "tool", "assistant", "assistant"])], "episode string, index int, role string")
    assert tuple(completeness.first_after_fault(m, spark.createDataFrame([("e", 2, 5)], "episode string, result_index int, recovery_index int")).first()) == ("e", 3, 5)


def test_files(spark, tmp_path):
    (tmp_path / "doc.json").write_text('{\n "a": 1,\n "b": "x"\n}')
    assert files.document(spark, str(tmp_path / "doc.json"), "a int, b string").first() == (1, "x")
    (tmp_path / "c.toml").write_text('[x]\ny = 2\n')
    assert files.settings(spark, str(tmp_path / "c.toml")) == {"x": {"y": 2}} and files.settings(spark, str(tmp_path / "doc.json"))["a"] == 1
    specs = spark.createDataFrame([(1, "s1"), (2, "s2")], "task_id int, prompt string")
    kb, oracle = specs.select("task_id", F.lit("k").alias("v")), specs.select("task_id", F.lit(3).alias("n"))
    whole = files.bundles(specs, kb, oracle)
    assert {(r["task_id"], r["kb"]["v"], r["oracle"]["n"]) for r in whole.collect()} == {(1, "k", 3), (2, "k", 3)}
    with pytest.raises(Exception, match="no oracle of 2"):
        files.bundles(specs, kb, oracle.where("task_id = 1")).collect()
    with pytest.raises(Exception, match="no specification of 9"):
        files.bundles(specs, kb, oracle, spark.createDataFrame([(1, 0), (9, 1)], "task_id int, ordinal int")).select("prompt").collect()
    sha = hashlib.sha256((tmp_path / "doc.json").read_bytes()).hexdigest()
    assert files.pinned(spark, str(tmp_path / "doc.json"), sha)
    with pytest.raises(ValueError, match="pinned"):
        files.pinned(spark, str(tmp_path / "doc.json"), "0" * 64)
    q = spark.createDataFrame([(i, f"text #### {i},00{i}" if i else "none") for i in range(9)], "id int, answer string")
    one, two = files.questions(q, "s", 0, 4), files.questions(q, "s", 4)
    assert sorted(r["id"] for r in one.union(two).collect()) == list(range(9)) and {r["truth"] for r in one.union(two).where("id < 2").collect()} == {None, "1001"}
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert [files.append(rows, path, "k"), files.append(rows.union(spark.createDataFrame([(3, "c")], "k int, v string")), path, "k")] == [2, 1]
    for n in (1, 2):
        files.write_staged(rows.limit(n), str(tmp_path / "staged"))
    assert tables.table(spark, str(tmp_path / "staged"), rows.schema).count() == 2 and tables.swept(spark, str(tmp_path / "staged")) == 1
    files.write_lines(rows, str(tmp_path / "lines"), ["k"])
    (part,) = (tmp_path / "lines").glob("part-*")
    assert part.read_text() == '{"k":1,"v":"a"}\n{"k":2,"v":"b"}\n'
    files.publish(rows, rows, rows.limit(1), str(tmp_path / "pub"))
    assert {p.name for p in (tmp_path / "pub").iterdir()} == {"rows", "metadata", "report"}
    files.write_split(rows.withColumn("split", F.lit("dev")), str(tmp_path / "split"))
    assert (tmp_path / "split" / "split=dev").is_dir()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"1")
    (tmp_path / "in" / "b.bin").symlink_to(tmp_path / "in" / "a.bin")
    assert [r["path"].rsplit("/", 1)[1] for r in files.listing(spark, [str(tmp_path / "in"), str(tmp_path / "in")]).collect()] == ["a.bin"]
    with pytest.raises(ValueError, match="no rows"):
        (tmp_path / "none.jsonl").write_text("")
        files.corpus(spark, str(tmp_path / "none.jsonl"), "a int")
    good = lambda df: df.where("false").selectExpr("cast(k as string) as key", "'x' as gap")
    completeness.published(rows, str(tmp_path / "sealed"), good, lambda df: df.agg(F.count("*").alias("rows")))
    assert spark.read.json(str(tmp_path / "sealed" / "receipt")).first()["rows"] == 2


def test_view_plan(spark):
    """Terminal, recovery and drawn pivot turns against the rule in plain Python."""
    turn = lambda i, args=None, text="thinking": (i, "assistant", text, args)
    tool = lambda i, text: (i, "tool", text, None)
    long = [turn(0, "K"), tool(1, '{"ok":true,"v":"KAB234567"}'), turn(2, "KAB234567"), tool(3, '{"ok":true,"v":12}'), turn(4, "12 * 2"), tool(5, '{"ok":false}'), turn(6, "12 * 2"), tool(7, '{"ok": true,"v":24}'), turn(8, "24"), tool(9, "x 99"), turn(10, "24"), tool(11, "y"), turn(12, None, "ANSWER: 24")]
    cases = {
        "plain": (long, ("t1", 4, False, None, None)),
        "long": (long, ("t2", 8, False, None, None)),
        "fault": (long, ("t3", 8, True, 5, 8)),
        "same": (long, ("t4", 4, True, 5, 6)),
        "uncommitted": (long[:-1] + [turn(12, None, "no idea")], ("t5", 8, False, None, None)),
    }
    messages = spark.createDataFrame([(k, *m) for k, (ms, _) in cases.items() for m in ms], "episode string, index int, role string, content string, arguments string")
    records = spark.createDataFrame([(k, *r) for k, (_, r) in cases.items()], "episode string, task_id string, horizon int, fired boolean, result_index int, recovery_index int")

    def rule(task, horizon, fired, result, certified):
        recovery = ([6] if certified == 6 else [6, certified]) if fired else []
        # turn 4 is followed by an error, which counts unless it was injected
        eligible = [i for i in (2, 4, 6, 8, 10) if i not in recovery and (i != 4 or result == 5)]
        seed = int(hashlib.sha256(f"pivot-seed|{task}".encode()).hexdigest()[:16], 16) >> 1
        stream = hashlib.shake_256(f"{seed:#x}:pivot|{task}".encode()).digest(16)
        a, b = (int.from_bytes(stream[i : i + 8], "little") % len(eligible) for i in (0, 8))
        picked = {eligible[a]} | ({eligible[(b + 1) % len(eligible) if a == b else b]} if horizon >= 8 else set())
        return {(12, "terminal", 2)} | {(i, "recovery", 1 if len(recovery) == 2 else 2) for i in recovery} | {(i, "pivot", 1) for i in picked}

    got = {}
    for r in views.planned(messages, records).collect():
        got.setdefault(r["episode"], set()).add((r["index"], r["view"], r["copies"]))
    assert got == {k: rule(*r) for k, (_, r) in cases.items() if k != "uncommitted"}
    specs = spark.createDataFrame([("e", ["n1", "n2"], [("transient", "n2"), ("malformed", "n9")])], "episode string, nodes array<string>, faults array<struct<fault_type:string,target_node:string>>")
    assert [tuple(f) for f in views.assigned_faults(specs).first()["fault"]] == [("transient", "n2", 1), ("malformed", "n9", None)]


def test_verdicts_move_events_once(spark):
    """Events, specs and finals are each dealt by episode once, whatever is judged of them."""
    events = spark.createDataFrame([event("a", 1, "n1")], EVENT)
    specs = spark.createDataFrame([("a", ["n1"], 4, 6, "x", "token", True, [])], "episode string, nodes array<string>, max_calls int, max_decisions int, answer string, answer_kind string, state_ok boolean, faults array<struct<fault_type:string,target_node:string,ambiguous:boolean>>")
    finals = spark.createDataFrame([("a", "ANSWER: x", 0, "answered")], "episode string, final string, tool_messages int, termination string")
    plan = verifier.verdicts(events, specs, finals)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and plan.count("Join") <= 2
