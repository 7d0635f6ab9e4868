"""Queries of strict verdicts, records, views, vetoes, suites and values: episodes built from a table's numbers.

Each order is an episode whose number says in what it departs from a good one, so that every reason comes up; the SQL beside says
what has to come out.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structure, values
from ..operators import acceptance, audits, completeness, controls, leakage, verifier, vetoes, views
from ..operators.shared import new_path, settle
from ..registry import query
from ..sources import jsonl
from ..streaming import journals
from .proxies import table


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _orders(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """k and its case, 0 to n - 1."""
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select(k.alias("k"), (k % n).cast("int").alias("c"))


def _when(c: Column, case: int, value, other) -> Column:
    return F.when(c == case, F.lit(value) if not isinstance(value, Column) else value).otherwise(other if isinstance(other, Column) else F.lit(other))


def strict_episodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, specs, finals) of two calls each: a lookup, and one that shows the answer. Cases 0 to 15."""
    o, c = _orders(spark, sf_dir, 16), F.col("c")
    code = F.concat(F.lit("CODE"), F.col("k").cast("string"))
    shown = F.array(F.lit('{"ok":true,"value":5,"unit":"kg"}'), F.concat(F.lit('{"ok":true,"record":{"code":"'), code, F.lit('","list":[1]}}')))
    fired = (F.col("i") == 1) & c.isin(12, 13, 14, 15)
    e = o.select("k", "c", F.posexplode(F.sequence(F.lit(1), F.lit(2)))).select("k", "c", F.col("col").alias("i"))
    three = e.where("i = 2 and c in (12, 13, 15)").withColumn("i", F.lit(3))  # the call after a fault
    e = e.union(three)
    node = F.when(fired, "n1").when(F.col("i") == 1, "n1").when((F.col("i") == 2) & c.isin(12, 13, 15), "n1").otherwise("n2")
    canonical = ~fired & ~((c == 2) & (F.col("i") == 2))
    events = e.select(
        F.col("k").alias("episode"), F.col("i").alias("call_id"), F.col("i").cast("long").alias("decision_id"), F.lit("kb_lookup").alias("tool"), F.concat(node, F.lit("-args")).alias("args_digest"),
        F.when(fired, F.lit('{"ok":false,"recovery_token":"t"}')).otherwise(F.get(shown, F.when(node == "n1", 0).otherwise(1))).alias("exposed_text"), F.concat(node, F.lit("-shown-"), F.col("i").cast("string")).alias("exposed_digest"),
        node.alias("oracle_node"), canonical.alias("exposed_canonical"), (canonical & ~((c == 11) & (F.col("i") == 2)) & (c != 14)).alias("credited"), fired.alias("fault_triggered"), F.when(fired, "transient").alias("fault_type"), F.lit(False).alias("state_mutated"), F.lit(False).alias("replay"),
        F.when((c == 12) & (F.col("i") == 2), "t").alias("token_provided"), F.when(fired, "t").alias("recovery_token"), F.lit(None).cast("string").alias("requested_unit"), (~((c == 7) & (F.col("i") == 1))).alias("token_known"), (~fired).alias("ok"),
        ((c == 3) & (F.col("i") == 2)).alias("unsafe"), F.concat(F.lit("r-"), F.md5(F.concat_ws("|", "k", "i"))).alias("receipt"), (~((c == 6) & (F.col("i") == 1))).alias("receipt_ok"), F.lit("{}").alias("args"),
    )
    planned = F.array(F.struct(F.lit("transient").alias("fault_type"), F.lit("n1").alias("target_node"), F.lit(False).alias("ambiguous")))
    none = F.array().cast("array<struct<fault_type:string,target_node:string,ambiguous:boolean>>")
    specs = o.select(F.col("k").alias("episode"), F.array(F.lit("n1"), F.lit("n2")).alias("nodes"), _when(c, 5, 1, 4).alias("max_calls"), F.lit(9).cast("long").alias("max_decisions"), code.alias("answer"), F.lit("token").alias("answer_kind"), (c != 4).alias("state_ok"), F.when(c.isin(10, 12, 13, 14, 15), planned).otherwise(none).alias("faults"))
    finals = o.select(F.col("k").alias("episode"), F.when(c == 1, "ANSWER: nothing here").when(c == 15, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ANSWER: "), code)).alias("final"), _when(c, 9, 4, 2).cast("long").alias("tool_messages"), F.when(c == 8, "wall_clock").otherwise("answered").alias("termination"))
    return events, specs, finals


_VERDICTS = """x AS (SELECT CAST(o_orderkey AS BIGINT) AS k, (o_orderkey % 16)::INT AS c FROM orders),
v AS (SELECT k, c, CASE c WHEN 1 THEN 'answer_ok,hallucinated' WHEN 2 THEN 'all_nodes' WHEN 3 THEN 'safe' WHEN 4 THEN 'state_ok' WHEN 5 THEN 'within_budget,runaway' WHEN 6 THEN 'receipts_ok' WHEN 7 THEN 'tokens_ok' WHEN 8 THEN 'runaway' WHEN 9 THEN 'hallucinated' WHEN 10 THEN 'unrecovered' WHEN 11 THEN 'consistent' WHEN 13 THEN 'unrecovered' WHEN 14 THEN 'all_nodes,unrecovered' WHEN 15 THEN 'answer_ok,unrecovered' ELSE '' END AS reasons,
CASE c WHEN 10 THEN 'not_exposed' WHEN 12 THEN 'ok' WHEN 13 THEN 'blind_retry' WHEN 14 THEN 'no_remediation' WHEN 15 THEN 'blind_retry' END AS recovery, CASE WHEN c IN (1, 15) THEN NULL WHEN c IN (12, 13) THEN 3 ELSE 2 END AS answer_call, CASE WHEN c = 2 THEN 1 WHEN c = 14 THEN 0 ELSE 2 END AS valid_nodes FROM x)"""


def _strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verifier.verdicts(*strict_episodes(spark, sf_dir))


@query(f"WITH {_VERDICTS} SELECT k AS episode, c IN (0, 12) AS certified, c NOT IN (1, 2, 3, 4, 5, 7, 11, 14, 15) AS task_success, valid_nodes::BIGINT AS valid_nodes, answer_call, recovery AS recovery_reason, reasons FROM v")
def strict_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict verdict on every order's episode, with the reasons against it."""
    return _strict(spark, sf_dir).select("episode", "certified", "task_success", F.col("valid_nodes").cast("long").alias("valid_nodes"), "answer_call", "recovery_reason", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_VERDICTS}, r AS (SELECT *, c IN (0, 2, 3, 4, 5, 7, 10, 11, 12, 13, 14) AND c NOT IN (5, 6, 8, 9) AS ledger, k // 16 % 4 AS d FROM v)
SELECT k AS episode, ledger AS ledger_ok, ledger AND (c IN (0, 12) OR d = 1) AND d <> 3 AS certified, CASE WHEN d = 2 THEN 'receipts_ok' ELSE '' END AS mismatches, (c IN (0, 12) OR d = 1) AND d <> 3 AND NOT ledger AS contradiction, ledger AND NOT ((c IN (0, 12) OR d = 1) AND d <> 3) AS strict_refusal, NOT ((c IN (0, 12) OR d = 1) AND d <> 3) AND reasons = '' AS unexplained FROM r""")
def ledger_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ledger supports, against recorded verdicts of which a quarter is certified, has another receipt flag, or is refused."""
    v = settle(_strict(spark, sf_dir).select("episode", "answer_ok", "receipts_ok", "sourced", "runaway", "hallucinated", "answer_call", "certified", "reasons"), "verdicts")  # once, for both sides
    d = F.call_function("div", F.col("episode"), F.lit(16)) % 4
    recorded = v.select("episode", F.col("answer_ok").alias("raw_success"), F.when(d == 2, ~F.col("receipts_ok")).otherwise(F.col("receipts_ok")).alias("receipts_ok"), "runaway", "hallucinated", "answer_call", ((F.col("certified") | (d == 1)) & (d != 3)).alias("certified"), "reasons")
    return verifier.certified_from_ledger(v, recorded).select("episode", "ledger_ok", "certified", F.array_join("mismatches", ",").alias("mismatches"), "contradiction", "strict_refusal", "unexplained")


@query(f"WITH {_VERDICTS} SELECT CASE WHEN c NOT IN (10, 12, 13, 14, 15) THEN 'not_assigned' WHEN c = 10 THEN 'not_exposed' WHEN c IN (13, 15) THEN 'blind_retry' WHEN c = 14 THEN 'no_remediation' ELSE 'ok' END AS reason, count(*) AS n FROM v GROUP BY 1")
def recovery_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the recoveries of assigned faults count or don't."""
    events, specs, finals = strict_episodes(spark, sf_dir)
    calls = events.where("fault_triggered").groupBy("episode").agg(F.min("call_id").alias("fault_call"))
    return verifier.recovery_labels(verifier.verdicts(events, specs, finals), calls).groupBy("reason").agg(F.count("*").alias("n"))


_RECORD = ("accepted", "missing_provenance:provenance_absent", "missing_provenance:gpu_execution", "missing_provenance:gpu_name", "missing_provenance:producer", "missing_provenance:gpu_uuid_on_a_cpu_attestation", "max_decisions_exhausted", "truncated_final", "unknown_tool", "bad_call_arguments", "call_cap_hit", "no_final", "stray_think", "no_committed_answer", "answer_leakage", "tool_output_too_long", "verifier_runtime_disagreement", "verifier_rejected", "call_count", "too_many_redundant_calls", "fault_not_fired", "recovery_not_verified", "recovery_blind_retry", "recovery_too_late", "too_many_retries", "trapped_value_used", "replay_failed")
_NAMES = ", ".join(f"'{x}'" for x in _RECORD)


@query(f"SELECT ([{_NAMES}])[(o_orderkey % {len(_RECORD)} + 1)::INT] AS reason, count(*) AS n FROM orders GROUP BY 1")
def record_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why episode records are rejected: every reason of provenance, commitment, results, verdict, budget and recovery."""
    case = {name: i for i, name in enumerate(_RECORD)}
    c = F.col("c")
    at = lambda *names: c.isin(*(case[n] for n in names))
    text = lambda x: F.lit(x).cast("string")
    on_cpu = at("missing_provenance:producer", "missing_provenance:gpu_uuid_on_a_cpu_attestation")
    block = F.struct(
        F.when(~at("missing_provenance:gpu_execution"), ~on_cpu).alias("gpu_execution"), F.when(~at("missing_provenance:producer"), "tool").alias("producer"), F.when(~on_cpu | at("missing_provenance:gpu_uuid_on_a_cpu_attestation"), "u").alias("gpu_uuid"), F.when(~on_cpu & ~at("missing_provenance:gpu_name"), "card").alias("gpu_name"),
        F.when(~on_cpu, 7).alias("cuda_visible_bytes"), *(text("x").alias(f) for f in ("run_id", "engine_fingerprint", "enable_thinking_effective", "config_hash", "runtime_manifest_sha256", "session_id")),
    )
    faulted = at("fault_not_fired", "recovery_not_verified", "recovery_blind_retry", "recovery_too_late", "too_many_retries", "trapped_value_used")
    final = F.when(at("no_final"), "").when(at("stray_think"), "x</think> ANSWER: 5").when(at("no_committed_answer"), "done").otherwise("ANSWER: 5")
    result = F.when(at("answer_leakage"), r"so \boxed{5}").when(at("tool_output_too_long"), F.repeat(F.lit("w"), 90)).otherwise("fine")
    flags = {"exhausted": "max_decisions_exhausted", "truncated": "truncated_final", "unknown_tool": "unknown_tool", "arg_error": "bad_call_arguments", "call_cap": "call_cap_hit"}
    rows = _orders(spark, sf_dir, len(_RECORD)).select(
        "k", F.when(~at("missing_provenance:provenance_absent"), block).alias("provenance"), *(at(reason).alias(flag) for flag, reason in flags.items()), final.alias("final"), F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content")), F.struct(F.lit("tool").alias("role"), result.alias("content"))).alias("messages"),
        (~at("verifier_runtime_disagreement")).alias("consistent"), (~at("verifier_rejected")).alias("certified"), (~at("replay_failed")).alias("replayed"), F.when(at("call_count"), 9).otherwise(4).alias("calls"), F.lit(4).alias("horizon"), F.lit(1).alias("slack"), F.when(at("too_many_redundant_calls"), 2).otherwise(0).alias("redundant"),
        F.when(faulted, F.array(F.lit("wrong_unit"))).otherwise(F.array().cast("array<string>")).alias("faults"), (~at("fault_not_fired")).alias("fired"), (~at("recovery_not_verified")).alias("recovered"), F.when(at("recovery_blind_retry"), "blind_retry").otherwise("ok").alias("recovery"), F.lit(1).alias("fault_decision"),
        F.when(at("recovery_too_late"), 9).otherwise(2).alias("recovery_decision"), F.when(at("too_many_retries"), 7).otherwise(1).alias("retries"), F.when(at("trapped_value_used"), "5.0").otherwise("6").alias("trapped"), F.lit("5").alias("answer"),
    )
    reason = acceptance.record_reason(80, 1, 3, 2)
    return rows.select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("WITH x AS (SELECT CAST(o_orderkey AS BIGINT) AS k, (o_orderkey % 6)::INT AS c FROM orders), v AS (SELECT k, c, unnest(CASE c WHEN 1 THEN [] WHEN 2 THEN ['5:terminal:2', '3:recovery:2'] WHEN 3 THEN ['5:terminal:2'] WHEN 4 THEN ['5:terminal:2'] WHEN 5 THEN ['5:terminal:2', '3:recovery:1', '4:recovery:1'] ELSE ['5:terminal:2', '3:pivot:1'] END) AS row FROM x) SELECT k AS episode, split_part(row, ':', 1)::INT + CASE WHEN c = 5 AND split_part(row, ':', 2) = 'terminal' THEN 1 ELSE 0 END AS index, split_part(row, ':', 2) AS view, split_part(row, ':', 3)::INT AS copies FROM v")
def planned_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which turns of each order's trajectory become rows: the last one, recoveries, and pivots that consume a result."""
    o, c = _orders(spark, sf_dir, 6), F.col("c")
    message = lambda i, role, content, arguments=None: F.struct(F.lit(i).alias("index"), F.lit(role).alias("role"), (content if isinstance(content, Column) else F.lit(content)).alias("content"), (arguments if isinstance(arguments, Column) else F.lit(arguments)).cast("string").alias("arguments"))
    last = F.when(c == 1, "no commitment").otherwise("ANSWER: 7")
    start = [message(0, "user", "q"), message(1, "assistant", "call", '{"x":"first"}'), message(2, "tool", '{"ok":true,"value":41}'), message(3, "assistant", "call", F.when(c == 4, '{"x":"other"}').otherwise('{"x":"41"}'))]
    rest = [message(4, "tool", F.when(c == 3, '{"ok": false}').otherwise('{"ok":true}')), message(5, "assistant", last)]
    two = [message(4, "assistant", "call", '{"x":"new"}'), message(5, "tool", "{}"), message(6, "assistant", "ANSWER: 7")]
    messages = o.select(F.col("k").alias("episode"), F.explode(F.when(c == 5, F.array(*start, *two)).otherwise(F.array(*start, *rest))).alias("m")).select("episode", "m.*")
    fired = c.isin(2, 5)
    records = o.select(F.col("k").alias("episode"), F.col("k").alias("task_id"), F.lit(4).alias("horizon"), fired.alias("fired"), F.when(fired, 2).alias("result_index"), F.when(c == 5, 4).when(c == 2, 3).alias("recovery_index"))
    return views.planned(messages, records).select("episode", "index", "view", "copies")


@query("""WITH e AS (SELECT o_orderpriority AS tag, o_orderkey AS k, o_orderkey % 10 < 6 AS ok, CASE WHEN o_orderpriority LIKE '1%' AND o_orderkey % 3 > 0 THEN 'same' WHEN o_orderkey % 41 = 0 THEN ' ' WHEN o_orderpriority LIKE '2%' THEN 'x <tool_call ' || o_orderkey ELSE 'final ' || o_orderkey END AS final, o_orderpriority LIKE '3%' AND o_orderkey % 10 >= 6 AS boxed, CASE WHEN o_orderpriority LIKE '2%' THEN 0 ELSE o_orderkey % 3 END AS calls, o_orderkey % 5 AS predicted, CASE WHEN o_orderpriority LIKE '5%' AND o_orderkey % 7 = 0 THEN 9 END AS expected, CASE WHEN o_orderpriority LIKE '4%' AND o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS dropped FROM orders),
s AS (SELECT tag, count(*) + CASE WHEN tag LIKE '4%' THEN 1 ELSE 0 END AS n, avg(ok::INT) + CASE WHEN tag LIKE '1%' THEN 0.1 ELSE 0 END AS accuracy, CASE WHEN tag LIKE '2%' THEN 0.0 ELSE avg((calls > 0)::INT) - CASE WHEN tag LIKE '5%' THEN 0.1 ELSE 0 END END AS used FROM e GROUP BY tag),
a AS (SELECT tag, count(*) AS rows, sum(dropped) AS dropped, avg(ok::INT) AS rate, count_if(NOT ok AND boxed) AS blind, count_if(contains(final, '<tool_call')) AS syntactic, count_if(coalesce(ok AND trim(final) = '', false) OR coalesce(ok <> (abs(predicted - expected) < 1e-4), false)) AS misflagged, count_if(trim(final) <> '') AS finals, avg((calls > 0)::INT) AS own FROM e GROUP BY tag),
t AS (SELECT tag, max(c) AS same FROM (SELECT tag, left(final, 200) AS f, count(*) AS c FROM e WHERE trim(final) <> '' GROUP BY 1, 2) GROUP BY tag),
j AS (SELECT * FROM s JOIN a USING (tag) LEFT JOIN t USING (tag))
SELECT tag, split_part(x, ':', 1) AS code, split_part(x, ':', 2) AS level FROM (SELECT tag, unnest(list_filter([CASE WHEN dropped > 0 THEN 'S0:WARN' END, CASE WHEN rows <> n THEN 'S1:BUG' END, CASE WHEN abs(rate - accuracy) > 0.02 THEN 'S2:BUG' END, CASE WHEN blind >= greatest(2.0, 0.05 * rows) THEN 'S3:BUG' END, CASE WHEN blind < greatest(2.0, 0.05 * rows) AND accuracy = 0 AND rows >= 10 THEN 'S3:WARN' END, CASE WHEN used = 0 AND rows >= 10 AND syntactic > 0 THEN 'S4:BUG' END, CASE WHEN used = 0 AND rows >= 10 AND syntactic = 0 THEN 'S4:WARN' END, CASE WHEN misflagged > 0 THEN 'S5:BUG' END, CASE WHEN finals >= 10 AND same / finals > 0.5 THEN 'S6:WARN' END, CASE WHEN abs(own - used) > 0.05 THEN 'S7:BUG' END], lambda x: x IS NOT NULL)) AS x FROM j)""")
def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S0 to S7 over the orders of each priority as a tag, each with a fault of its own."""
    k, tag = F.col("o_orderkey"), F.col("o_orderpriority")
    is_tag = lambda i: tag.startswith(str(i))
    text = k.cast("string")
    final = F.when(is_tag(1) & (k % 3 > 0), "same").when(k % 41 == 0, " ").when(is_tag(2), F.concat(F.lit("x <tool_call "), text)).otherwise(F.concat(F.lit("final "), text))
    e = table(spark, sf_dir, "orders").select(tag.alias("tag"), (k % 10 < 6).alias("ok"), final.alias("final"), (is_tag(3) & (k % 10 >= 6)).alias("boxed_right"), F.when(is_tag(2), 0).otherwise(k % 3).alias("n_calls"), (k % 5).alias("predicted"), F.when(is_tag(5) & (k % 7 == 0), 9).alias("expected"), F.when(is_tag(4) & (k % 11 == 0), 1).otherwise(0).alias("dropped"))
    s = e.groupBy("tag").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("accuracy"), F.avg((F.col("n_calls") > 0).cast("int")).alias("tool_use_rate"))
    own = lambda i: F.col("tag").startswith(str(i))
    s = s.select("tag", (F.col("n") + own(4).cast("int")).alias("n"), (F.col("accuracy") + F.when(own(1), 0.1).otherwise(0.0)).alias("accuracy"), F.when(own(2), 0.0).otherwise(F.col("tool_use_rate") - F.when(own(5), 0.1).otherwise(0.0)).alias("tool_use_rate"))
    return audits.sanity(e, s)


@query("WITH x AS (SELECT CAST(o_orderkey AS BIGINT) AS k, (o_orderkey % 6)::INT AS c FROM orders) SELECT 'S12' AS veto, CASE c WHEN 1 THEN 'fires more than once' WHEN 2 THEN 'fires at another node' ELSE 'can''t be recovered from' END AS detail, count(*) AS n FROM x WHERE c IN (1, 2, 3) GROUP BY c UNION ALL SELECT 'S14', CASE c WHEN 1 THEN 'no hidden key' WHEN 2 THEN 'insensitive to the hidden value' ELSE 'succeeds without the permuted answer' END, count(*) FROM x WHERE c IN (1, 2, 4) GROUP BY c UNION ALL SELECT 'S11', CASE c WHEN 1 THEN 'succeeds without the information' ELSE 'never ran a decision' END, count(*) FROM x WHERE c IN (1, 2, 3) GROUP BY ALL")
def control_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected faults, permuted and redacted tasks that break their rules, by veto and detail."""
    o, c = _orders(spark, sf_dir, 6), F.col("c")
    key = [F.lit("TP").alias("arm"), F.lit("faulted").alias("condition"), F.lit("none").alias("control"), F.col("k").alias("task_id")]
    faulted = o.select(*key, "c", F.when(c != 4, "d").alias("planned_digest"), F.lit(1).alias("fault_node"), F.lit(4).alias("horizon"), F.when(c == 3, 2).otherwise(9).alias("max_calls"))
    events = o.where("c != 5").select(*key, F.explode(F.when(c == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("call_id"), F.when(c.isin(2, 4), "e").otherwise("d").alias("args_digest"), F.lit(True).alias("fault_triggered"))
    permuted = o.select(F.lit("TP").alias("arm"), F.lit("clean").alias("condition"), F.lit("permuted").alias("control"), F.col("k").alias("task_id"), F.when(c == 4, "other").when(c == 5, F.lit(None)).otherwise(" Want").alias("committed"), F.lit(True).alias("raw_success"), F.lit("want").alias("answer"))
    specs = o.select(*key[:1], key[1], key[2], F.col("k").alias("task_id"), F.lit("a").alias("answer"), F.when(c == 2, "a").when(c == 3, F.lit(None)).otherwise("b").alias("mutated_answer"), F.when(c != 1, "K").alias("hidden_key"), F.lit(False).alias("sensitive"))
    redacted = o.select(F.lit("BP").alias("arm"), F.lit("clean").alias("condition"), F.lit("redacted").alias("control"), F.col("k").alias("task_id"), (c == 1).alias("raw_success"), F.lit(False).alias("certified"), F.when(c == 2, "spec_error").otherwise("answered").alias("termination"), F.when(c == 3, 0).otherwise(4).alias("n_decisions"))
    rows = vetoes.injection(faulted, events).unionByName(vetoes.counterfactual(permuted, specs)).unionByName(vetoes.absent_information(redacted))
    return rows.groupBy("veto", "detail").agg(F.count("*").alias("n"))


_SUITE = ("regeneration differs", "horizon differs", "node ids repeat", "depends on an unknown node", "cluster differs", "oracle fails", "a missing node is accepted", "one decision for two hops is accepted", "a missed lookup leaks", "the prompt has the answer", "no answer")


@query("WITH x AS (SELECT (o_orderkey % 13)::INT AS c FROM orders) SELECT ([" + ", ".join(f"'{g}'" for g in _SUITE) + "])[c] AS gap, count(*) AS n FROM x WHERE c BETWEEN 1 AND 11 GROUP BY 1")
def suite_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content checks of a suite, one of eleven failing in most tasks."""
    o, c = _orders(spark, sf_dir, 13), F.col("c")
    node = lambda name, depends: F.struct((name if isinstance(name, Column) else F.lit(name)).alias("node"), F.lit("t").alias("tool"), depends.cast("array<string>").alias("depends"))
    nodes = F.array(node("n1", F.array()), node(F.when(c == 3, "n1").otherwise("n2"), F.array(F.when(c == 4, "n9").otherwise("n1"))))
    specs = o.select(
        F.col("k").alias("task_id"), F.when(c == 2, 3).otherwise(2).alias("horizon"), nodes.alias("nodes"), F.lit("t1").alias("cluster"), F.when(c == 5, "t2").otherwise("t1").alias("recomputed_cluster"), F.lit("d").alias("digest"), F.when(c != 1, "d").alias("regenerated_digest"), (c != 6).alias("oracle_ok"), F.when(c != 7, True).alias("missing_node_rejected"),
        (c != 8).alias("same_decision_rejected"), (c == 9).alias("miss_leaks"), F.when(c == 10, "find key9 now").otherwise("find it").alias("prompt"), F.when(c == 11, F.lit(None)).otherwise("KEY9").alias("answer"), F.lit("token").alias("answer_kind"),
    )
    return completeness.suite_checks(specs).groupBy("gap").agg(F.count("*").alias("n"))


@query("WITH v AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) SELECT CAST(k AS VARCHAR) AS key, CASE WHEN k % 9 = 0 THEN 'no metadata' ELSE 'another source' END AS gap FROM v WHERE k % 9 = 0 OR k % 7 = 0 UNION ALL SELECT 'corpus', unnest(list_filter([CASE WHEN count(*) > 100 THEN 'too many rows' END, CASE WHEN count_if(k % 4 = 0) / count(*) < 0.3 THEN 'too few terminal rows' END], lambda x: x IS NOT NULL)) FROM v")
def view_corpus_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views without metadata or of another source, and the corpus against its range."""
    k = F.col("k")
    o = _orders(spark, sf_dir, 2)
    return completeness.view_gaps(o.select(k.cast("string").alias("row_id"), F.when(k % 4 == 0, "terminal").otherwise("pivot").alias("view"), F.lit("s").alias("source")), o.where("k % 9 != 0").select(k.cast("string").alias("row_id"), F.when(k % 7 == 0, "t").otherwise("s").alias("source")), 0, 100, 0.3)


@query("WITH t AS (SELECT o_custkey % 60 AS f, o_custkey % 60 % 4 = 1 AND o_orderkey % 5 = 0 AS stale, o_custkey % 60 % 4 = 2 AND o_orderkey % 5 = 0 AS bare, CASE WHEN o_custkey % 60 % 4 = 3 THEN o_orderkey % 2 ELSE 0 END AS p FROM orders), g AS (SELECT f, bool_or(stale) AS a, bool_or(bare) AS b, count(DISTINCT p) > 1 AS c FROM t GROUP BY f) SELECT CAST(f AS VARCHAR) AS key, unnest(list_filter([CASE WHEN a THEN 'stale rows' END, CASE WHEN b THEN 'rows without hardware' END, CASE WHEN c THEN 'more than one fingerprint' END], lambda x: x IS NOT NULL)) AS gap FROM g")
def trace_file_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty trace files: stale rows, rows without hardware, more than one fingerprint."""
    f, k = F.col("o_custkey") % 60, F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(f.alias("file"), F.when((f % 4 == 1) & (k % 5 == 0), "old").otherwise("c").alias("contract"), F.when(f % 4 == 3, k % 2).otherwise(0).cast("string").alias("fingerprint"), F.when((f % 4 == 2) & (k % 5 == 0), "").otherwise("u").alias("gpu_uuid"))
    return completeness.trace_gaps(rows, "c", ("gpu_uuid",))


@query("""WITH e AS (SELECT event_id AS i, event_type AS t, CAST(floor(value) AS INTEGER) AS v FROM events)
SELECT i AS event_id, CASE WHEN i % 5 = 1 THEN '' ELSE array_to_string(CASE WHEN i % 5 = 2 THEN [CAST(v AS VARCHAR), t, 'True'] ELSE [CAST(v AS VARCHAR), t] END, ',') END AS shown, CASE WHEN i % 5 = 2 THEN 2 WHEN i % 5 = 3 THEN 0 ELSE 1 END AS objects, CASE WHEN i % 3 = 0 THEN 'r-' || i END AS receipt, i % 5 = 3 AS cut_off, i % 5 IN (1, 2) AS is_error, lower(t) || '_x' AS token, (i % 5 <> 1 AND i % 2 = 0) AS consumes, CASE WHEN i % 4 = 3 THEN NULL ELSE '{"a":' || CASE i % 4 WHEN 0 THEN CAST(v AS VARCHAR) ELSE '"' || CASE i % 4 WHEN 1 THEN t ELSE CAST(v AS VARCHAR) || '*2' END || '"' END || ',"b":1}' END AS resolved FROM e""".replace("CASE WHEN i % 5 = 1 THEN ''", "CASE WHEN i % 5 IN (1, 3) THEN ''"))
def observed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations made of events: exposed values, objects, receipts, errors, tokens, consumption and resolved references."""
    i, kind, v = F.col("event_id"), F.col("event_type"), F.col("value").cast("int").cast("string")
    good = F.concat(F.lit('{"ok":true,"value":'), v, F.lit(',"unit":"kg","record":{"kind":"'), kind, F.lit('","status":"s"}}'))
    text = F.when(i % 5 == 1, F.lit('{"ok": false, "x": 1}')).when(i % 5 == 2, F.concat(good, F.lit('\n{"ok":false,"y":2}'))).when(i % 5 == 3, F.lit('{"ok":true,"value":')).otherwise(good)
    text = F.when(i % 5 == 2, F.concat(F.lit('{"ok":true,"value":'), v, F.lit(',"record":{"kind":"'), kind, F.lit('","deep":[{"flag":true},3]}}\n{"ok":false,"y":2}'))).otherwise(text)
    text = F.concat(text, F.when(i % 3 == 0, F.concat(F.lit("\nreceipt: r-"), i.cast("string"))).otherwise(""))
    node = F.concat(F.lit('{"n1":{"value":'), v, F.lit(',"record":{"kind":"'), kind, F.lit('"}}}'))
    ref = F.when(i % 4 == 0, F.lit('{"$from":"n1"}')).when(i % 4 == 1, F.lit('{"$from":"n1","field":"kind"}')).when(i % 4 == 2, F.lit('{"$from":"n1","format":"{}*2"}')).otherwise(F.lit('{"$from":"n2"}'))
    # dealt by id first: a small file is one task, whose rows are costly
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value").repartition("event_id").select("event_id", "event_type", text.alias("text"), node.alias("prior"), F.concat(F.lit('{"b":1,"a":'), ref, F.lit("}")).alias("arguments"), F.concat(F.lit("**`"), F.upper("event_type"), F.lit("\\_x`**.")).alias("quoted"), F.when(i % 5 == 1, "").otherwise(F.concat(F.lit("got KAB234567 and "), v)).alias("seen"), F.when(i % 2 == 0, "use KAB234567").otherwise("use 0.123456789").alias("used"))
    o = values.observation(F.col("text"))
    return e.select("event_id", F.array_join(values.exposed_values(F.col("text")), ",").alias("shown"), F.size(o["objects"]).alias("objects"), o["receipt"].alias("receipt"), o["cut_off"].alias("cut_off"), values.is_error(F.col("text")).alias("is_error"), values.token_value(F.col("quoted")).alias("token"), values.consumes(F.col("seen"), F.col("used")).alias("consumes"), values.resolved_arguments(F.col("arguments"), F.col("prior")).alias("resolved"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '((c*c)+c)' WHEN 1 THEN '((c+c)*c)' WHEN 2 THEN '(-(c**c))' ELSE '?' END AS shape, sha256('{\"edges\":[[0,1]],\"family\":\"f\",\"horizon\":2,\"pattern\":\"kb>' || CASE WHEN p_partkey % 2 = 0 THEN 'calc' ELSE 'uc' END || '\",\"roles\":[]}') AS structure, CASE WHEN p_size % 4 = 0 THEN 'transient_or_rate_limit' WHEN p_size % 4 = 1 THEN 'malformed' WHEN p_size % 4 = 2 THEN 'wrong_unit' END AS fault_group FROM part")
def structural_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of expressions, structures of two-node tasks, and pooled fault groups."""
    k, text = F.col("p_partkey"), F.col("p_partkey").cast("string")
    expression = F.when(k % 4 == 0, F.concat(text, F.lit(" * 7 + 5"))).when(k % 4 == 1, F.concat(F.lit("("), text, F.lit(" + 91) * 3"))).when(k % 4 == 2, F.concat(F.lit("-"), text, F.lit(" ** 2"))).otherwise(F.concat(F.lit("f("), text, F.lit(")")))
    tools = F.array(F.lit("kb_lookup"), F.when(k % 2 == 0, "calculator").otherwise("unit_convert"))
    described = structure.structure(F.lit("f"), F.lit(2), tools, F.array().cast("array<string>"))
    fault = F.get(F.array(*map(F.lit, ("rate_limit", "malformed", "wrong_unit", "unregistered"))), (F.col("p_size") % 4).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), structure.expression_shape(expression).alias("shape"), F.sha2(described, 256).alias("structure"), structure.fault_group(fault).alias("fault_group"))


def relay_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's task: a lookup of its nation, one of the nation's size, and an expression of that; the size is one more
    than when the payloads were written."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("task_id"), F.col("c_nationkey").cast("string").alias("nation"), (F.col("c_custkey") % 9).alias("size"))
    arg = lambda value=None, source=None, field=None, form=None: F.struct(*((x if isinstance(x, Column) else F.lit(x)).cast("string").alias(n) for n, x in (("value", value), ("source", source), ("field", field), ("format", form))))
    node = lambda name, tool, key, a: F.struct(F.lit(name).alias("node"), F.lit(tool).alias("tool"), F.create_map(F.lit(key), a).alias("args"))
    own, nation = F.concat(F.lit("C"), F.col("task_id").cast("string")), F.concat(F.lit("N"), "nation")
    record = lambda name, value: F.create_map(F.lit(name), value.cast("string"))
    kb = F.map_from_arrays(F.array(own, nation), F.array(record("next", F.col("nation")), record("size", F.col("size") + 1)))
    nodes = F.array(node("n0", "kb_lookup", "key", arg(own)), node("n1", "kb_lookup", "key", arg(None, "n0", "next", "N{}")), node("n2", "calculator", "expression", arg(None, "n1", "size", F.when(F.col("size") == 0, "{} / 0").otherwise("{}*4+1"))))
    payload = lambda name, value, rec: F.struct(F.lit(name).alias("node"), value.cast("string").alias("value"), rec.alias("record"))
    none = F.lit(None).cast("map<string,string>")
    expected = F.array(payload("n0", F.lit(None), record("next", F.col("nation"))), payload("n1", F.lit(None), record("size", F.col("size"))), payload("n2", F.col("size") * 4 + 1, none))
    return c.select("task_id", F.col("nation").alias("answer"), F.lit("token").alias("answer_kind"), F.lit(None).cast("string").alias("answer_field"), F.when(F.col("size") % 2 == 0, nation).alias("hidden_key"), kb.alias("kb"), nodes.alias("nodes"), expected.alias("expected"))


@query("WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_custkey % 9 AS s, c_nationkey AS n FROM customer) SELECT k AS task_id, CAST(s + 1 AS VARCHAR) AS size, CASE WHEN s = 0 THEN '1' ELSE CAST((s + 1) * 4 + 1 AS VARCHAR) END AS value, CASE WHEN s % 2 = 0 THEN 'C' || k ELSE 'C' || k || ',N' || n END AS left_keys FROM c")
def reconciled_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that follow a changed record through a lookup and an expression, and what redaction leaves."""
    t = relay_tasks(spark, sf_dir)
    right = controls.reconciled(t).select("task_id", F.get("expected", F.lit(1))["record"]["size"].alias("size"), F.get("expected", F.lit(2))["value"].alias("value"))
    left = controls.redacted(t).select("task_id", F.array_join(F.array_sort(F.map_keys("kb")), ",").alias("left_keys"))
    return right.join(left, "task_id")


@query("WITH RECURSIVE f AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, n_chars AS s FROM documents), w AS (SELECT i, doc_id, 0 AS batch, 1 AS n, CAST(s AS BIGINT) AS t FROM f WHERE i = 1 UNION ALL SELECT f.i, f.doc_id, w.batch + (w.n >= 7 OR w.t + f.s > 20000)::INT, CASE WHEN w.n >= 7 OR w.t + f.s > 20000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 7 OR w.t + f.s > 20000 THEN 0 ELSE w.t END + f.s FROM w JOIN f ON f.i = w.i + 1) SELECT doc_id, batch FROM w")
def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in batches of up to 7 files and 20,000 characters."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.format_string("%012d", F.col("doc_id").cast("long")).alias("path"), F.col("n_chars").cast("long").alias("size"))
    return completeness.batches(d, "path", 7, 20_000).select("doc_id", "batch")


@query("WITH l AS (SELECT user_id AS rollout, event_type AS name FROM events WHERE event_type IN ('view','click','purchase') GROUP BY 1, 2) SELECT CAST(rollout AS VARCHAR) AS rollout, round(rollout % 7 * 1.0 + rollout % 5 * 0.2 + rollout % 3 * 0.1, 4) AS total FROM l GROUP BY rollout HAVING count(*) = 3")
def streamed_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that have all three kinds of events, once each, by a stream that holds the parts until all are there."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    u, kind = F.col("user_id"), F.col("event_type")
    parts = stream.select(u.alias("rollout"), kind.alias("name"), F.when(kind == "view", u % 7).when(kind == "click", u % 5).otherwise(u % 3).cast("double").alias("score"), F.col("ts").cast("timestamp").alias("at"))
    return journals.run_to_end(journals.completed_rewards(parts, ("view", "click", "purchase"), (1.0, 0.2, 0.1), "3650 days"), new_path(spark, "rewards")).select("rollout", F.round("total", 4).alias("total"))


_SUITE_KEYS = "x AS (SELECT o_orderkey AS k, (['train','dev','eval'])[(o_orderkey % 3 + 1)::INT] AS split, o_custkey AS c FROM orders), q AS (SELECT split, 'task_id' AS kind, CAST(k // 2 AS VARCHAR) AS value FROM x UNION SELECT split, 'kb_namespace', 's/' || split FROM x UNION SELECT split, 'template', CAST(c % 12 + CASE split WHEN 'eval' THEN 10 ELSE 0 END AS VARCHAR) FROM x UNION SELECT split, 'template_hash', sha256('t' || (k % 50)) FROM x UNION SELECT split, 'graph_signature', 'g' || (c % 40) FROM x WHERE c % 40 <> 7 UNION SELECT split, 'kb_key', 'K' || c FROM x UNION SELECT split, 'kb_key', 'N' || k FROM x)"


@query(f"WITH {_SUITE_KEYS}, p AS (SELECT a.kind, a.split AS split_a, b.split AS split_b, a.value FROM q a JOIN q b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split), r AS (SELECT *, row_number() OVER (PARTITION BY kind, split_a, split_b ORDER BY value) AS i FROM p) SELECT kind, split_a, split_b, count(*) AS n, string_agg(value, ',' ORDER BY value) FILTER (i <= 5) AS examples FROM r GROUP BY ALL")
def suite_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six kinds of keys of a suite's tasks that two splits share, with the first examples."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    split = F.get(F.array(*map(F.lit, ("train", "dev", "eval"))), (k % 3).cast("int"))
    text = lambda x: x.cast("string")
    specs = table(spark, sf_dir, "orders").select(split.alias("split"), F.call_function("div", k, F.lit(2)).alias("task_id"), F.concat(F.lit("s/"), split).alias("kb_namespace"), (c % 12 + F.when(split == "eval", 10).otherwise(0)).alias("template_id"), F.sha2(F.concat(F.lit("t"), text(k % 50)), 256).alias("template_hash"), F.when(c % 40 != 7, F.concat(F.lit("g"), text(c % 40))).alias("graph_signature"), F.map_from_arrays(F.array(F.concat(F.lit("K"), text(c)), F.concat(F.lit("N"), text(k))), F.array(F.lit("a"), F.lit("b"))).alias("kb"))
    return leakage.crossings(leakage.suite_keys(specs), "kind", "value", "split").select("kind", "split_a", "split_b", "n", F.array_join("examples", ",").alias("examples"))


@query("""WITH x AS (SELECT CAST(c_custkey AS BIGINT) AS k, c_custkey % 4 AS c FROM customer)
SELECT k AS task_id, sha256('template ' || k % 12) AS template_hash, 'core/' || CASE WHEN c = 3 THEN 'eval' ELSE 'train' END AS kb_namespace, CASE c WHEN 0 THEN 'kb>uc>calc' WHEN 1 THEN 'wq>wu' ELSE 'kb>kb' END AS tool_pattern, c = 0 AS all_tools_required, CASE c WHEN 0 THEN 'A' WHEN 1 THEN NULL ELSE 'B' END AS hidden_key, c <> 1 OR k % 8 = 1 AS redactable, CASE WHEN c = 2 THEN 'transient@1' END AS fault, CASE c WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE NULL END AS n_faults, CASE WHEN c = 3 THEN 'r1' END AS release, CASE WHEN k % 8 = 1 THEN 'why' END AS redaction, CASE WHEN k % 8 = 2 THEN 'old' END AS original_answer, CASE WHEN k % 8 = 2 THEN 't9' END AS permuted_from, sha256('contract') AS contract FROM x""")
def certification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's task as a certification row: patterns, hidden keys, faults by place, controls and releases."""
    k, c = F.col("c_custkey").cast("long"), F.col("c_custkey") % 4
    node = lambda name, tool, key=None: F.struct(F.lit(name).alias("node"), F.lit(tool).alias("tool"), (F.create_map(F.lit("key"), F.lit(key)) if key else F.create_map().cast("map<string,string>")).alias("args"), F.lit("x").alias("expect"))
    nodes = F.when(c == 0, F.array(node("n0", "kb_lookup", "A"), node("n1", "unit_convert"), node("n2", "calculator"))).when(c == 1, F.array(node("n0", "warehouse_query"), node("n1", "warehouse_update"))).otherwise(F.array(node("n0", "kb_lookup", "A"), node("n1", "kb_lookup", "B")))
    fault = lambda kind, target: F.struct(F.lit(kind).alias("fault_type"), F.lit(target).alias("target_node"), F.create_map().cast("map<string,string>").alias("params"))
    faults = F.when(c == 2, F.array(fault("transient", "n1"))).when(c == 3, F.array(fault("transient", "n1"), fault("malformed", "n0"))).otherwise(F.array().cast("array<struct<fault_type:string,target_node:string,params:map<string,string>>>"))
    split, text = F.when(c == 3, "eval").otherwise("train"), lambda x: F.lit(x).cast("string")
    control = F.when(k % 8 == 1, "redacted").when(k % 8 == 2, "permuted")
    meta = F.map_from_arrays(F.array(*map(F.lit, ("reason", "original_answer", "donor_task_id"))), F.array(*map(F.lit, ("why", "old", "t9"))))
    specs = table(spark, sf_dir, "customer").select(
        k.alias("task_id"), text("core").alias("suite"), text("f").alias("family"), split.alias("split"), F.lit(2).alias("horizon"), (k % 12).alias("template_id"), F.concat(F.lit("template "), (k % 12).cast("string")).alias("template"), text("tc").alias("template_cluster_id"), F.lit(1).alias("pattern_id"), text("p").alias("prompt"), F.create_map(F.lit("A"), F.lit("a")).alias("kb"), text(None).alias("env"),
        nodes.alias("nodes"), text("ans").alias("answer"), text("token").alias("answer_kind"), faults.alias("faults"), F.lit(9).alias("max_decisions"), F.lit(9).alias("max_calls"), F.array().cast("array<string>").alias("secret_tokens"), control.alias("control"), meta.alias("control_meta"), F.when(c == 3, "r1").alias("release_id"),
    )
    rows = acceptance.certification_specs(specs, hashlib.sha256(b"contract").hexdigest(), ("eval",))
    return rows.select("task_id", "template_hash", "kb_namespace", "tool_pattern", "all_tools_required", "hidden_key", "redactable", F.concat_ws("@", "fault.class", F.col("fault.node_index").cast("string")).alias("_f"), F.size("faults").alias("_n"), F.col("heldout_release_id").alias("release"), F.col("redaction")["reason"].alias("redaction"), "original_answer", "permuted_from", F.col("environment_contract_sha256").alias("contract")).withColumns({"fault": F.nullif("_f", F.lit("")), "n_faults": F.when(F.col("_n") > 0, F.col("_n"))}).drop("_f", "_n")


@query("SELECT doc_id, CASE WHEN doc_id % 6 IN (1, 2) THEN 'held-out release' WHEN doc_id % 6 = 3 THEN 'receipt of its own' WHEN doc_id % 6 = 4 THEN 'plaintext secret' END AS refusal FROM documents")
def publication_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of some paths a bulk publication may not carry."""
    i = F.col("doc_id")
    name = i.cast("string")
    path = F.when(i % 6 == 1, F.concat(F.lit("./data/HeldOut/"), name)).when(i % 6 == 2, F.concat(F.lit("data\\held-out\\"), name)).when(i % 6 == 3, "results/locks.json").when(i % 6 == 4, "/out/run.hex").otherwise(F.concat(F.lit("results/locks.json."), name))
    return table(spark, sf_dir, "documents").select("doc_id", jsonl.publication_refusal(path, ("results/locks.json",), ("out/run.hex",)).alias("refusal"))
