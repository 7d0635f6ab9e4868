"""Which trajectories may train: ordered rejection reasons, provenance gaps, controls, shards and pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import boxed, committed, first_rejection, number
from ..functions.structure import tool_pattern
from ..functions.values import answers_match

#: Tolerance of the trajectory filter, and the tools that it allows.
CLOSE = 1e-4
ALLOWED = ("calculator", "unit_convert")
#: What a record of a graphics-card producer has to name, and what one without must not.
CARD = ("gpu_uuid", "gpu_name", "cuda_visible_bytes")
FINGERPRINT = (*CARD, "run_id", "engine_fingerprint", "enable_thinking_effective", "config_hash")
MANIFEST = ("runtime_manifest_sha256", "session_id")


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def trajectory_reason(max_calls: int, max_words: int = 128, allowed: tuple[str, ...] = ALLOWED, allow_tool_error: bool = False) -> Column:
    """Why a trajectory is rejected, null if it isn't: the first of eleven reasons that holds.

    Columns: exhausted, truncated, final, truth, n_calls, tools array<string>, tool_error.
    """
    final = F.coalesce(F.col("final"), F.lit(""))
    got, want = number(boxed(final)), number(F.col("truth"))
    foreign = F.size(F.array_except(F.coalesce("tools", F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))) > 0
    reasons = [
        ("max_turns_exhausted", _flag("exhausted")),
        ("truncated_final", _flag("truncated")),
        ("no_final", final == ""),
        ("stray_think", final.contains("</think>")),
        ("no_box", got.isNull()),
        ("wrong", want.isNull() | (F.abs(got - want) > CLOSE)),
        ("no_tool", F.col("n_calls") == 0),
        ("too_many_calls", F.col("n_calls") > max_calls),
        ("final_too_long", F.size(F.filter(F.split(final, r"\s+"), lambda w: w != "")) > max_words),
        ("irrelevant_tool", foreign),
    ]
    return first_rejection(reasons if allow_tool_error else [*reasons, ("tool_error", _flag("tool_error"))])


def fingerprint_gaps(block: Column) -> Column:
    """Names of the fingerprint's fields that a provenance block, a struct, lacks."""
    return _named([(f, _blank(block[f])) for f in FINGERPRINT])


def manifest_gaps(block: Column) -> Column:
    return _named([(f, _blank(block[f])) for f in MANIFEST])


def _named(tests: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in tests)), lambda x: x.isNotNull())


def provenance_gaps(block: Column) -> Column:
    """Why a provenance block isn't evidence; empty means that it is.

    A struct with gpu_execution, producer and the fields of FINGERPRINT and MANIFEST. A producer on a card names all of them;
    one without names itself and no card.
    """
    off_card = F.concat(_named([("producer", _blank(block["producer"]))]), _named([(f"{f}_on_a_cpu_attestation", ~_blank(block[f])) for f in CARD]))
    return F.when(block.isNull(), F.array(F.lit("provenance_absent"))).when(block["gpu_execution"].isNull(), F.array(F.lit("gpu_execution"))).when(block["gpu_execution"], F.concat(fingerprint_gaps(block), manifest_gaps(block))).otherwise(off_card)


def call_slack(slack: dict[str, int], faulted_extra: int) -> Column:
    """Calls beyond the horizon that a family may make, more with a fault; columns family and faults array<string>."""
    own = F.element_at(F.create_map(*(F.lit(x) for pair in slack.items() for x in pair)), F.col("family"))
    return own + F.when(F.size("faults") > 0, faulted_extra).otherwise(0)


def redundant_calls(events: DataFrame, episode: str = "episode") -> DataFrame:
    """(episode, redundant): calls that repeat a tool and its arguments' digest."""
    return events.groupBy(episode).agg((F.count("*") - F.count_distinct("tool", "args_digest")).alias("redundant"))


def budget_reason(max_redundant: Column | int) -> Column:
    """Columns calls, horizon, slack, redundant."""
    return first_rejection([("call_count", ~F.col("calls").between(F.col("horizon"), F.col("horizon") + F.col("slack"))), ("too_many_redundant_calls", F.col("redundant") > max_redundant)])


def recovery_reason(max_decisions: int, max_retries: int) -> Column:
    """Recovery has to be certified, prompt and without the trapped value; an episode without a fault needs none.

    Columns: faults, fired, recovered, recovery (the verifier's reason), fault_decision, recovery_decision, retries, trapped, answer.
    """
    late = F.col("fault_decision").isNull() | F.col("recovery_decision").isNull() | (F.col("recovery_decision") - F.col("fault_decision") > max_decisions)
    trap = F.array_contains("faults", "wrong_unit") & F.col("trapped").isNotNull() & answers_match(F.col("trapped"), F.col("answer"))
    found = F.coalesce(
        F.when(~_flag("fired"), F.lit("fault_not_fired")),
        F.when(~_flag("recovered"), F.lit("recovery_not_verified")),
        F.when(~F.col("recovery").eqNullSafe(F.lit("ok")), F.concat(F.lit("recovery_"), F.coalesce("recovery", F.lit("none")))),
        F.when(late, F.lit("recovery_too_late")),
        F.when(F.coalesce("retries", F.lit(0)) > max_retries, F.lit("too_many_retries")),
        F.when(trap, F.lit("trapped_value_used")),
    )
    return F.when(F.size("faults") > 0, found)


def record_reason(max_chars: int, max_redundant: Column | int, max_decisions: int, max_retries: int) -> Column:
    """Why an episode record is rejected, null if it is accepted: provenance, flags, commitment, leakage and length of tool
    results, verdict, budget, recovery, replay, in this order.

    Columns: provenance, exhausted, truncated, unknown_tool, arg_error, call_cap, final, messages array<struct<role, content>>,
    consistent, certified, replayed (null counts as a failed replay), and those of ``budget_reason`` and ``recovery_reason``.
    """
    final = F.coalesce(F.col("final"), F.lit(""))
    gaps = provenance_gaps(F.col("provenance"))
    results = F.transform(F.filter("messages", lambda m: m["role"] == "tool"), lambda m: F.coalesce(m["content"], F.lit("")))
    # the first tool result that is at fault decides, and a box in it comes before its length
    problem = lambda c: F.when(c.rlike(r"\\boxed\s*\{"), "answer_leakage").when(F.char_length(c) > max_chars, "tool_output_too_long")
    at_fault = F.try_element_at(F.filter(F.transform(results, problem), lambda p: p.isNotNull()), F.lit(1))
    return F.coalesce(
        F.when(F.size(gaps) > 0, F.concat(F.lit("missing_provenance:"), F.try_element_at(gaps, F.lit(1)))),
        first_rejection([("max_decisions_exhausted", _flag("exhausted")), ("truncated_final", _flag("truncated")), ("unknown_tool", _flag("unknown_tool")), ("bad_call_arguments", _flag("arg_error")), ("call_cap_hit", _flag("call_cap")), ("no_final", final == ""), ("stray_think", final.contains("</think>")), ("no_committed_answer", committed(final).isNull())]),
        at_fault,
        first_rejection([("verifier_runtime_disagreement", ~_flag("consistent")), ("verifier_rejected", ~_flag("certified"))]),
        budget_reason(max_redundant),
        recovery_reason(max_decisions, max_retries),
        F.when(~_flag("replayed"), F.lit("replay_failed")),
    )


def current(df: DataFrame, stamp: str, contract: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the contract in force, all others): what is stale is kept apart and never dropped."""
    now = F.col(stamp).eqNullSafe(F.lit(contract))
    return df.where(now), df.where(~now)


def controlled(specs: DataFrame, permuted: DataFrame, task: str = "task_id", hidden: str = "hidden_key") -> DataFrame:
    """The specifications as they are, those whose hidden record can be taken away without it, and the permuted ones, by ``control``."""
    redacted = specs.where(F.col(hidden).isNotNull()).withColumn("kb", F.map_filter("kb", lambda k, _: k != F.col(hidden)))
    return specs.withColumn("control", F.lit("none")).unionByName(redacted.withColumn("control", F.lit("redacted"))).unionByName(permuted.withColumn("control", F.lit("permuted")))


def shard(df: DataFrame, ordinal: str, shards: int, index: int) -> DataFrame:
    """Every ``shards``-th row of a manifest by its ordinal, counted from 0."""
    return df.where(F.pmod(F.col(ordinal), F.lit(shards)) == index)


def clean_arm(specs: DataFrame) -> DataFrame:
    """The paired clean tasks: no faults, and the decisions that a task without a fault has (columns faults, horizon, max_decisions)."""
    return specs.withColumn("faults", F.slice("faults", 1, 0)).withColumn("max_decisions", F.col("horizon") + 3)


#: The families of the long axis, and the tools that orchestration needs.
LONG_FAMILIES = ("lookup_chain", "typed_relay")
ALL_TOOLS = ("kb_lookup", "unit_convert", "calculator")


def axis_pool(specs: DataFrame) -> DataFrame:
    """Each task once for each claim axis that it is eligible for, as ``axis``; the clean axes take the paired clean arm.

    Columns: family, horizon, faults, tools array<string>, max_decisions.
    """
    recovery = specs.where(F.size("faults") > 0).withColumn("axis", F.lit("recovery"))
    tools = F.size(F.array_except(F.array(*map(F.lit, ALL_TOOLS)), F.col("tools"))) == 0
    clean = clean_arm(specs)
    orchestration = clean.where((F.col("family") == "typed_relay") & (F.col("horizon") == 4) & tools).withColumn("axis", F.lit("orchestration"))
    long = clean.where((F.col("horizon") == 8) & F.col("family").isin(*LONG_FAMILIES)).withColumn("axis", F.lit("h8"))
    return recovery.unionByName(orchestration).unionByName(long)


def axis_capacity(pools: DataFrame, required: DataFrame) -> DataFrame:
    """(axis, available, needed, per_cell, enough): pools (axis, cell) against required (axis, needed); a cell owes its even
    share, rounded up."""
    have = pools.groupBy("axis").agg(F.count("*").alias("available"), F.count_distinct("cell").alias("cells"))
    both = required.join(have, "axis", "left").na.fill(0, ["available", "cells"])
    return both.select("axis", "available", "needed", F.when(F.col("cells") > 0, F.ceil(F.col("needed") / F.col("cells"))).alias("per_cell"), (F.col("available") >= F.col("needed")).alias("enough"))


def slim(df: DataFrame, surface: tuple[str, ...]) -> DataFrame:
    """The columns that scoring needs, without transcripts; the scan reads no others."""
    return df.select(*(c for c in surface if c in df.columns))


def certification_rows(specs: DataFrame) -> DataFrame:
    """One flat row a task: (task_id, family, horizon, split, answer, tools, all_tools_required, hidden_key, redactable).

    Columns: task_id, family, horizon, split, answer, kb map<string,string>, nodes array<struct<tool, key>>. The hidden key is
    that of the last lookup; a task is redactable where its knowledge base has it.
    """
    tools = F.array_distinct(F.transform("nodes", lambda n: n["tool"]))
    looked_up = F.filter("nodes", lambda n: n["tool"] == "kb_lookup")
    hidden = F.try_element_at(looked_up, F.lit(-1))["key"]
    need = F.size(F.array_except(F.array(*map(F.lit, ALL_TOOLS)), tools)) == 0
    return specs.select("task_id", "family", "horizon", "split", "answer", tools.alias("tools"), need.alias("all_tools_required"), hidden.alias("hidden_key"), F.coalesce(F.array_contains(F.map_keys("kb"), hidden), F.lit(False)).alias("redactable"))


def certification_specs(specs: DataFrame, contract: str, heldout: tuple[str, ...] = ()) -> DataFrame:
    """The certification row of each task, with everything that an evaluator needs and nothing that it has to look up.

    specs: task_id, suite, family, split, horizon, template_id, template, template_cluster_id, pattern_id, prompt, kb (a map by
    record key), env, nodes array<struct<node, tool, args map<string,string>, expect>>, answer, answer_kind, faults
    array<struct<fault_type, target_node, params map<string,string>>>, max_decisions, max_calls, secret_tokens, control,
    control_meta map<string,string>, release_id.

    The hidden key is that of the last lookup, and a task without one can only be redacted if it is so already. ``fault`` is the
    one fault of a task that has one. A task of a held-out split without a release raises; rows carry the contract's digest.
    """
    tools = F.transform("nodes", lambda n: n["tool"])
    looked_up = F.filter("nodes", lambda n: n["tool"] == "kb_lookup")
    redacted = F.coalesce(F.col("control") == "redacted", F.lit(False))
    place = lambda f: F.array_position(F.transform("nodes", lambda n: n["node"]), f["target_node"]).cast("int") - 1
    faults = F.transform("faults", lambda f: F.struct(f["fault_type"].alias("class"), F.when(place(f) >= 0, place(f)).alias("node_index"), f["target_node"].alias("node"), f["params"].alias("params")))
    unreleased = F.col("split").isin(*heldout) & F.col("release_id").isNull()
    release = F.when(unreleased, F.raise_error(F.concat(F.lit("no release of held-out task "), F.col("task_id").cast("string")))).otherwise(F.col("release_id"))
    return specs.select(
        "task_id", "suite", "family", "split", "horizon", "template_id", F.sha2("template", 256).alias("template_hash"), "template_cluster_id", F.concat_ws("/", "suite", "split").alias("kb_namespace"), "pattern_id", tool_pattern(tools).alias("tool_pattern"),
        (F.size(F.array_except(F.array(*map(F.lit, ALL_TOOLS)), tools)) == 0).alias("all_tools_required"), "prompt", "kb", "env", F.transform("nodes", lambda n: F.struct(n["node"].alias("node"), n["tool"].alias("tool"), n["args"].alias("args"))).alias("oracle"), F.col("nodes").alias("oracle_nodes"), "answer", "answer_kind", F.lit("code").alias("answer_field"),
        F.try_element_at(F.try_element_at(looked_up, F.lit(-1))["args"], F.lit("key")).alias("hidden_key"), (redacted | (F.size(looked_up) > 0)).alias("redactable"), F.lit(True).alias("counterfactual_sensitive"), F.when(F.size("faults") == 1, F.get(faults, F.lit(0))).alias("fault"), F.when(F.size("faults") > 0, faults).alias("faults"),
        "max_decisions", "max_calls", "secret_tokens", release.cast("string").alias("heldout_release_id"), "control", F.when(redacted, F.col("control_meta")).alias("redaction"), F.when(F.col("control").isNotNull() & ~redacted, F.col("control_meta")).alias("permutation"),
        *(F.when(F.col("control") == "permuted", F.try_element_at("control_meta", F.lit(field))).alias(name) for name, field in (("original_answer", "original_answer"), ("permuted_from", "donor_task_id"))), F.lit(contract).alias("environment_contract_sha256"),
    )


def message_map(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(episode, call_id, assistant_index, result_index): the messages that a call was made in and answered by.

    messages: episode, index, role. calls: episode, call_id, decision_id. The n-th call is answered by the n-th tool message;
    decision d is the d-th assistant message.
    """
    own = Window.partitionBy("episode", "role").orderBy("index")
    placed = messages.where(F.col("role").isin("assistant", "tool")).withColumn("n", F.row_number().over(own))
    made = placed.where("role = 'assistant'").select("episode", F.col("n").alias("decision_id"), F.col("index").alias("assistant_index"))
    answered = placed.where("role = 'tool'").select("episode", "n", F.col("index").alias("result_index"))
    numbered = calls.withColumn("n", F.row_number().over(Window.partitionBy("episode").orderBy("call_id")))
    return numbered.join(made, ["episode", "decision_id"], "left").join(answered, ["episode", "n"], "left").select("episode", "call_id", "assistant_index", "result_index")


def terminal_rows(messages: DataFrame) -> DataFrame:
    """(episode, prompt, completion): one training row a trajectory, its last assistant message after everything before it.

    messages: episode, index, role, content.
    """
    last = F.max(F.when(F.col("role") == "assistant", F.col("index"))).over(Window.partitionBy("episode"))
    kept = messages.withColumn("last", last).where("index <= last")
    entry = F.struct("index", "role", "content")
    both = kept.groupBy("episode").agg(F.array_sort(F.collect_list(F.when(F.col("index") < F.col("last"), entry))).alias("before"), F.max(F.when(F.col("index") == F.col("last"), F.col("content"))).alias("completion"))
    return both.select("episode", F.transform("before", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("prompt"), "completion")
