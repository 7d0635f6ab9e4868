"""The strict verdict on an episode, its certification from the ledger, and why a recovery doesn't count.

events: episode, call_id, decision_id, tool, args_digest, exposed_text, exposed_digest, oracle_node, exposed_canonical,
credited, fault_triggered, fault_type, state_mutated, replay, token_provided, recovery_token, requested_unit, token_known, ok,
unsafe, receipt, receipt_ok, args (JSON). specs: episode, nodes array<string> in order, max_calls, max_decisions, answer,
answer_kind, state_ok, faults array<struct<fault_type, target_node, ambiguous>>. finals: episode, final, tool_messages,
termination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import committed
from ..functions.bind import let
from ..functions.values import answers_equal, exposed_values, is_error, keys_in, value_matches
from .closure import reached

#: Terminations that are runaways, reasons of recovery from the worst to the best, and the order of labels.
RUNAWAY = ("token_budget", "wall_clock", "parser_budget", "call_cap")
REASONS = ("not_exposed", "no_remediation", "blind_retry", "no_post_fault_result", "ok")
RECEIPT = r"\br-[0-9a-f]{32}\b"
STALE_RUN = 4


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def ledger(events: DataFrame, specs: DataFrame, finals: DataFrame | None = None) -> DataFrame:
    """One row a spec: its columns, those of its final, what was committed and cited, and its events as one sorted array, steps.

    Events go to their episode's task in one shuffle before anything is taken from their texts; an episode's ledger is bounded by
    its caps. calls, decisions, unsafe, unknown_token and bad_receipt are null for an episode without events.
    """
    good = (_flag("exposed_canonical") & ~_flag("fault_triggered")) | (_flag("fault_triggered") & (F.col("fault_type") == "malformed") & _flag("state_mutated"))
    step = F.struct(
        "call_id", "decision_id", "oracle_node", "args_digest", "recovery_token", "requested_unit", "tool", "exposed_digest", "token_provided", "fault_type", "receipt", is_error(F.col("exposed_text")).alias("error"),
        (F.coalesce(good, F.lit(False)) & F.col("oracle_node").isNotNull()).alias("good"), *(_flag(c).alias(c) for c in ("credited", "fault_triggered", "exposed_canonical", "replay", "receipt_ok")), F.when(_flag("receipt_ok"), exposed_values(F.col("exposed_text"))).alias("values"),
    )
    tests = {"unsafe": _flag("unsafe"), "unknown_token": (_flag("ok") | _flag("state_mutated")) & ~_flag("token_known"), "bad_receipt": ~_flag("receipt_ok")}
    rows = events.repartition("episode").select("episode", "decision_id", step.alias("step"), *(test.alias(name) for name, test in tests.items()))
    per = rows.groupBy("episode").agg(F.count("*").alias("calls"), F.max("decision_id").alias("decisions"), *(F.bool_or(name).alias(name) for name in tests), F.array_sort(F.collect_list("step")).alias("steps"))
    out = specs.join(per, "episode", "left")
    if finals is None:
        return out
    final = F.coalesce("final", F.lit(""))
    said = finals.select("episode", "final", "tool_messages", "termination", committed(final).alias("got"), F.regexp_extract_all(final, F.lit(RECEIPT), F.lit(0)).alias("cited"))
    return out.join(said, "episode", "left")


def _where(test) -> Column:
    return F.filter("steps", test)


def _named(tests: list[tuple[str, Column]], *more: Column) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests), *more), lambda x: x.isNotNull())


def _done() -> Column:
    """array<struct<node, decision>>: the chain is followed node by node over each node's candidate events, sorted by call."""
    start = F.struct(F.lit(0).cast("long").alias("call"), F.lit(-1).cast("long").alias("decision"), F.array().cast("array<struct<node:string,decision:bigint>>").alias("done"), F.lit(True).alias("going"))

    def follow(acc: Column, node: Column) -> Column:
        def on(nxt: Column) -> Column:
            grown = F.concat(acc["done"], F.array(F.struct(node.alias("node"), nxt["decision_id"].cast("long").alias("decision"))))
            ended = F.struct(acc["call"].alias("call"), acc["decision"].alias("decision"), acc["done"].alias("done"), F.lit(False).alias("going"))
            return F.when(nxt.isNull(), ended).otherwise(F.struct(nxt["call_id"].cast("long").alias("call"), nxt["decision_id"].cast("long").alias("decision"), grown.alias("done"), F.lit(True).alias("going")))

        found = F.try_element_at(_where(lambda e: e["good"] & (e["oracle_node"] == node) & (e["call_id"] > acc["call"]) & (e["decision_id"] > acc["decision"])), F.lit(1))
        return F.when(acc["going"], let(found, on)).otherwise(acc)

    return F.coalesce(F.aggregate("nodes", start, follow, lambda a: a["done"]), F.array().cast("array<struct<node:string,decision:bigint>>"))


def completion(events: DataFrame, specs: DataFrame) -> DataFrame:
    """(episode, node, decision): nodes credited by the rules alone: each once, in order, on a later decision than the one
    before it, by its canonical observation, or by an ambiguous change of state."""
    return ledger(events, specs).select("episode", F.explode(_done()).alias("x")).select("episode", "x.node", "x.decision")


def _runaway() -> Column:
    n = F.col("calls").cast("int")
    at = lambda i: F.get("steps", i)
    same = lambda i, j, c: at(i)[c].eqNullSafe(at(j)[c])
    loop = F.exists(F.sequence(F.lit(0), n - 3), lambda i: at(i)["error"] & same(i, i + 1, "args_digest") & same(i, i + 2, "args_digest") & same(i, i + 1, "exposed_digest") & same(i, i + 2, "exposed_digest"))
    # stale results since the last fresh one, and the most of them
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def one(acc: Column, e: Column) -> Column:
        name = F.coalesce(F.concat(F.lit("d"), e["exposed_digest"]), F.lit("none"))
        run = F.when(F.array_contains(acc["seen"], name), acc["run"] + 1).otherwise(0)
        return F.struct(F.array_union(acc["seen"], F.array(name)).alias("seen"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    most = F.aggregate("steps", start, one, lambda acc: acc["most"])
    # the first result is fresh, so a run of stale ones has more calls than it is long
    tests = [("over_call_cap", F.col("calls") > F.col("max_calls")), ("identical_error_loop", (n >= 3) & F.when(n >= 3, loop)), ("no_ledger_advance", (n > STALE_RUN) & F.when(n > STALE_RUN, most >= STALE_RUN))]
    return _named(tests, F.when(F.col("termination").isin(*RUNAWAY), F.concat(F.lit("terminated:"), "termination")))


def runaway(events: DataFrame, specs: DataFrame, finals: DataFrame) -> DataFrame:
    """(episode, reasons): more calls than allowed, three equal failed calls in a row, four stale results in a row, or a runner
    that stopped at a bound. Using exactly the allowed calls is no runaway."""
    return ledger(events, specs, finals).select("episode", _runaway().alias("reasons"))


def _last_shown() -> Column:
    """The last valid event that shows what was committed."""
    met = _where(lambda e: e["receipt_ok"] & F.exists(e["values"], lambda v: value_matches(F.col("got"), v)))
    return F.when(F.col("got").isNotNull(), F.array_max(F.transform(met, lambda e: e["call_id"])))


def answer_sources(events: DataFrame, specs: DataFrame, finals: DataFrame) -> DataFrame:
    """(episode, answer_call, sourced): the last valid event that shows the committed answer where it is right, and whether any
    event shows what was committed."""
    both = ledger(events, specs, finals).withColumn("last", _last_shown())
    return both.select("episode", F.when(answers_equal(F.col("got"), F.col("answer"), F.col("answer_kind")), F.col("last")).alias("answer_call"), F.col("last").isNotNull().alias("sourced"), F.col("got").isNotNull().alias("commits"))


def _hallucinations(last: Column) -> Column:
    minted = F.transform(_where(lambda e: e["receipt_ok"] & e["receipt"].isNotNull()), lambda e: e["receipt"])
    unminted = F.exists("cited", lambda r: ~F.coalesce(F.array_contains(minted, r), F.lit(False)))
    return _named([("cited_unminted_receipt", unminted), ("tool_message_without_event", F.col("tool_messages") > F.coalesce("calls", F.lit(0))), ("answer_value_unvalidated", F.col("got").isNotNull() & last.isNull())])


def hallucinations(events: DataFrame, specs: DataFrame, finals: DataFrame) -> DataFrame:
    """(episode, reasons): a cited receipt that no event has, more tool messages than events, a committed value that no valid
    event shows. An episode that commits nothing is a failure and no fabrication."""
    return ledger(events, specs, finals).select("episode", _hallucinations(_last_shown()).alias("reasons"))


def _reports() -> Column:
    """array<struct<fault_type, target_node, fires, reason, fault_decision, recovery_decision>>, one a planned fault."""

    def report(f: Column) -> Column:
        is_own = lambda g: (g["fault_type"] == f["fault_type"]) & (g["target_node"] == f["target_node"])
        unit, malformed = f["fault_type"] == "wrong_unit", f["fault_type"] == "malformed"
        # of one fault that is planned with and without doubt, the plain one counts
        ambiguous = malformed & ~F.exists("faults", lambda g: F.coalesce(is_own(g) & ~F.coalesce(g["ambiguous"], F.lit(False)), F.lit(False)))

        def judged(fires: Column) -> Column:
            fire = F.get(fires, F.lit(0))

            def attempt(e: Column) -> Column:
                after, same = e["decision_id"] > fire["decision_id"], e["args_digest"] == fire["args_digest"]
                other = same & fire["recovery_token"].isNotNull() & (e["token_provided"] == fire["recovery_token"]) & ((f["fault_type"] != "rate_limit") | after)
                return F.coalesce(F.when(unit, (e["tool"] == "unit_convert") & e["requested_unit"].eqNullSafe(fire["requested_unit"]) & after).otherwise(other), F.lit(False))

            def settles(e: Column) -> Column:
                own = F.when(unit, e["oracle_node"] == f["target_node"]).otherwise((e["args_digest"] == fire["args_digest"]) & (~ambiguous | e["replay"]))
                return e["exposed_canonical"] & F.coalesce(own, F.lit(False))

            later = _where(lambda e: e["call_id"] > fire["call_id"])
            first = F.array_min(F.transform(F.filter(later, settles), lambda e: F.struct(e["call_id"].alias("call"), e["decision_id"].alias("decision"), attempt(e).alias("earned"))))

            def told(first: Column) -> Column:
                n = F.coalesce(F.size(fires), F.lit(0)).cast("long")
                earned = F.coalesce(first["earned"], F.lit(False))
                reason = F.when(n == 0, "not_exposed").when(earned, "ok").when(first.isNotNull(), "blind_retry").when(F.exists(later, attempt), "no_post_fault_result").otherwise("no_remediation")
                return F.struct(f["fault_type"].alias("fault_type"), f["target_node"].alias("target_node"), n.alias("fires"), reason.alias("reason"), fire["decision_id"].alias("fault_decision"), F.when(earned & (n > 0), first["decision"]).alias("recovery_decision"))

            return let(first, told)

        fires = _where(lambda e: e["fault_triggered"] & (e["fault_type"] == f["fault_type"]) & (e["oracle_node"] == f["target_node"]))
        return let(F.coalesce(fires, F.slice("steps", 1, 0)), judged)

    return F.transform("faults", report)


def fault_reports(events: DataFrame, specs: DataFrame) -> DataFrame:
    """(episode, fault_type, target_node, fires, reason, fault_decision, recovery_decision): what became of each planned fault.

    Recovered is the first canonical result after the fault if it comes from the registered remediation: the token on the same
    call, on a later decision after a rate limit, as a replay where the state is ambiguous; the right unit, on a later decision,
    after a wrong one.
    """
    return ledger(events, specs).select("episode", F.explode(F.array_distinct(_reports())).alias("r")).select("episode", "r.*")


def verdicts(events: DataFrame, specs: DataFrame, finals: DataFrame) -> DataFrame:
    """One row an episode: certified, task_success and each condition, the recovery's reason, and the reasons against.

    Certified is the conjunction of: the right answer committed, all nodes, crediting as the runtime's, no unsafe change, the
    expected state, known tokens, within budget, valid receipts, a source of the answer, no runaway, no hallucination, and with
    faults their recovery. An episode without events has no calls, no decisions and valid receipts. Everything but the joins of
    events, specs and finals is taken from one row an episode.
    """
    done = F.array_sort(_done())
    credited = F.coalesce(F.array_sort(F.transform(_where(lambda e: e["credited"]), lambda e: F.struct(e["oracle_node"].alias("node"), e["decision_id"].cast("long").alias("decision")))), F.array().cast("array<struct<node:string,decision:bigint>>"))
    rank = lambda r: F.array_position(F.array(*map(F.lit, REASONS)), r["reason"])
    planned = F.coalesce(F.size("faults"), F.lit(0)) > 0
    judged = lambda reports: F.struct(F.array_min(F.transform(reports, lambda r: F.struct(rank(r).alias("rank"), r["reason"].alias("reason")))).alias("worst"), F.forall(reports, lambda r: r["reason"] == "ok").alias("recovered"))
    follows = let(done, lambda d: F.struct(F.size(d).cast("long").alias("n"), (d == credited).alias("consistent")))
    x = ledger(events, specs, finals).withColumns({"chain": follows, "last": _last_shown(), "runaway_reasons": _runaway(), "fault": F.when(planned, let(_reports(), judged)), "right": answers_equal(F.col("got"), F.col("answer"), F.col("answer_kind"))})
    x = x.withColumn("hallucination_reasons", _hallucinations(F.col("last"))).withColumn("answer_call", F.when(F.col("right"), F.col("last")))
    calls, decisions = F.coalesce("calls", F.lit(0)), F.coalesce("decisions", F.lit(0))
    x = x.select(
        "episode", F.size("nodes").alias("nodes_total"), F.col("chain.n").alias("valid_nodes"), calls.alias("calls"), decisions.alias("decisions"), F.col("right").alias("answer_ok"),
        (F.col("chain.n") == F.size("nodes")).alias("all_nodes"), F.col("chain.consistent").alias("consistent"), (~_flag("unsafe")).alias("safe"), F.coalesce("state_ok", F.lit(True)).alias("state_ok"), (~_flag("unknown_token")).alias("tokens_ok"),
        ((calls <= F.col("max_calls")) & (decisions <= F.col("max_decisions"))).alias("within_budget"), (~_flag("bad_receipt")).alias("receipts_ok"), "answer_call", F.col("answer_call").isNotNull().alias("sourced"),
        (F.size("runaway_reasons") > 0).alias("runaway"), "runaway_reasons", (F.size("hallucination_reasons") > 0).alias("hallucinated"), "hallucination_reasons",
        planned.alias("faulted"), _flag("fault.recovered").alias("recovered"), F.col("fault.worst.reason").alias("recovery_reason"),
    )
    task = ["answer_ok", "all_nodes", "consistent", "safe", "state_ok", "tokens_ok", "within_budget"]
    task_success = F.lit(True)
    for c in task:
        task_success = task_success & F.col(c)
    strict = task_success & F.col("receipts_ok") & F.col("sourced") & ~F.col("runaway") & ~F.col("hallucinated")
    against = _named([*((c, ~F.col(c)) for c in (*task, "receipts_ok")), ("unsourced", F.col("answer_ok") & ~F.col("sourced")), ("runaway", F.col("runaway")), ("hallucinated", F.col("hallucinated")), ("unrecovered", F.col("faulted") & ~F.col("recovered"))])
    return x.withColumn("task_success", task_success).withColumn("certified", strict & (~F.col("faulted") | F.col("recovered"))).withColumn("reasons", against)


def certified_from_ledger(verdict: DataFrame, recorded: DataFrame) -> DataFrame:
    """(episode, ledger_ok, certified, mismatches, contradiction, strict_refusal, unexplained): what the ledger alone supports,
    against a recorded verdict.

    verdict: as ``verdicts``. recorded: episode, raw_success, receipts_ok, runaway, hallucinated, answer_call, certified, reasons.
    """
    fields = {"raw_success": "answer_ok", "receipts_ok": "receipts_ok", "runaway": "runaway", "hallucinated": "hallucinated", "answer_call": "answer_call"}
    r = recorded.select("episode", *(F.col(f).alias(f"r_{f}") for f in (*fields, "certified", "reasons")), F.lit(True).alias("present"))
    x = verdict.join(r, "episode", "left")
    ledger = F.col("answer_ok") & F.col("receipts_ok") & F.col("sourced") & ~F.col("runaway") & ~F.col("hallucinated")
    gaps = F.filter(F.array(*(F.when(F.col("present") & ~F.col(f"r_{f}").eqNullSafe(F.col(own)), F.lit(f)) for f, own in fields.items())), lambda g: g.isNotNull())
    certified = _flag("r_certified")
    silent = _flag("present") & ~certified & (F.coalesce(F.size("r_reasons"), F.lit(0)) <= 0)
    return x.select("episode", ledger.alias("ledger_ok"), (ledger & certified).alias("certified"), gaps.alias("mismatches"), (certified & ~ledger).alias("contradiction"), (_flag("present") & ledger & ~certified).alias("strict_refusal"), silent.alias("unexplained"))


def recovery_labels(verdict: DataFrame, fault_calls: DataFrame) -> DataFrame:
    """(episode, reason): why an assigned episode's recovery doesn't count, the first that holds, or ``ok``.

    fault_calls: episode, fault_call (the first call that showed the fault, null if none did).
    """
    x = verdict.join(fault_calls, "episode", "left")
    remedy = F.col("recovery_reason")
    reason = (
        F.when(~F.col("faulted"), "not_assigned")
        .when(F.col("fault_call").isNull() | (remedy == "not_exposed"), "not_exposed")
        .when(F.col("hallucinated"), "hallucinated")
        .when(F.col("runaway"), "runaway")
        .when(remedy.isin("no_remediation", "blind_retry"), remedy)
        .when(remedy == "no_post_fault_result", "no_post_fault_result")
        .when(~F.col("answer_ok"), "wrong_final")
        .when(~F.col("sourced"), "unvalidated_answer")
        .when(F.col("answer_call") <= F.col("fault_call"), "pre_fault_answer")
        .when(~F.col("certified"), "uncertified_episode")
        .otherwise("ok")
    )
    return x.select("episode", reason.alias("reason"))


def orchestration(contributing: DataFrame, events: DataFrame, verdict: DataFrame, required: tuple[str, ...] = ("kb_lookup", "unit_convert", "calculator")) -> DataFrame:
    """(episode, tools, reason): certified episodes in which every required tool is on the dataflow into the answer are ``ok``.

    contributing: episode, call_id, as ``audits.contributing`` gives them.
    """
    on = contributing.join(events.select("episode", "call_id", "tool"), ["episode", "call_id"]).groupBy("episode").agg(F.array_sort(F.collect_set("tool")).alias("tools"))
    x = verdict.select("episode", "certified", "answer_call").join(on, "episode", "left").withColumn("tools", F.coalesce("tools", F.array().cast("array<string>")))
    missing = F.array_except(F.array(*map(F.lit, required)), "tools")
    reason = F.when(~F.col("certified"), "episode_not_certified").when(F.col("answer_call").isNull(), "no_answer_event").when(F.size(missing) > 0, F.concat(F.lit("tools_not_on_causal_chain:"), F.array_join(missing, ","))).otherwise("ok")
    return x.select("episode", "tools", reason.alias("reason"))


def trapped_values(messages: DataFrame, faults: DataFrame) -> DataFrame:
    """(episode, trapped): the value that a wrong-unit fault showed, from the message at its place.

    messages: episode, index, content. faults: episode, result_index.
    """
    line = F.filter(F.split("content", "\n"), lambda x: F.get_json_object(x, "$.value").isNotNull())
    return faults.withColumnRenamed("result_index", "index").join(messages, ["episode", "index"]).select("episode", F.get_json_object(F.try_element_at(line, F.lit(1)), "$.value").alias("trapped"))


def absent_information(specs: DataFrame) -> DataFrame:
    """(task_id, problem): redacted tasks whose hidden value can still be reached or read.

    The frontier of a task is what can be seen from its prompt: keys in it, and in the records of seen keys, again and again
    until nothing is new. specs: task_id, prompt, answer, hidden_key, kb map<string,string> (redacted).
    """
    edges = specs.select("task_id", F.explode("kb").alias("key", "record"))
    links = edges.select(F.col("task_id").alias("grp"), F.col("key").alias("node"), F.explode(keys_in(F.col("record"))).alias("next"))
    prompted = specs.select(F.col("task_id").alias("grp"), F.explode(keys_in(F.col("prompt"))).alias("node"))
    seen = reached(prompted, links).toDF("task_id", "key")
    shown = edges.join(seen, ["task_id", "key"]).join(specs.select("task_id", "answer", "hidden_key"), "task_id")
    leaks = shown.where(F.contains(F.lower("record"), F.lower("answer"))).select("task_id", F.lit("the answer can be read").alias("problem"))
    hidden = specs.where(F.map_contains_key("kb", F.coalesce("hidden_key", F.lit("")))).select("task_id", F.lit("the hidden record is still there").alias("problem"))
    told = specs.where(F.contains(F.lower("prompt"), F.lower("answer"))).select("task_id", F.lit("the prompt has the answer").alias("problem"))
    return leaks.union(hidden).union(told).distinct()
