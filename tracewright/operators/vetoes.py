"""The harness's vetoes: rows of violations, and one status each. Missing evidence is INCONCLUSIVE and never a pass.

Episodes as in ``registered``, with raw_success, receipts_ok, n_decisions, harness_failed, max_calls, answer, committed and
the provenance columns that a veto names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("arm", "condition", "control", "task_id")
#: Fields that both arms of a pair share, and what the ledger and the verdict both derive.
PAIRED = ("budgets", "decode", "spec_sha256", "prompt_sha256", "fault")
SHARED = ("raw_success", "receipts_ok", "runaway", "hallucinated", "answer_event_call_id")


def _rows(df: DataFrame, veto: str, detail: Column | str) -> DataFrame:
    """(veto, place, detail) of the rows of ``df`` whose detail isn't null."""
    place = F.concat_ws("/", *(F.col(c).cast("string") for c in KEY if c in df.columns))
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(veto).alias("veto"), place.alias("place"), detail.alias("detail")).where("detail is not null")


def _first(tests: list[tuple[str, Column]]) -> Column:
    return F.coalesce(*(F.when(test, F.lit(text)) for text, test in tests), F.lit(None).cast("string"))


def pairing(episodes: DataFrame, arms: tuple[str, str] = ("BP", "TP"), fields: tuple[str, ...] = PAIRED) -> DataFrame:
    """S8: tasks that only one arm has, and pairs that differ in a field."""
    own = episodes.where(F.col("condition").isin("clean", "faulted") & (F.col("control") == "none"))
    one = own.where(F.col("arm") == arms[0]).select("condition", "task_id", F.lit(True).alias("in_one"), *(F.col(f).alias(f"{f}_one") for f in fields))
    two = own.where(F.col("arm") == arms[1]).select("condition", "task_id", F.lit(True).alias("in_two"), *(F.col(f).alias(f"{f}_two") for f in fields))
    both = one.join(two, ["condition", "task_id"], "full_outer")
    return _rows(both, "S8", _first([("only one arm has the task", F.col("in_one").isNull() | F.col("in_two").isNull()), *((f"{f} differ", ~F.col(f"{f}_one").eqNullSafe(F.col(f"{f}_two"))) for f in fields)]))


def oracle(specs: DataFrame) -> DataFrame:
    """S9: specifications whose replayed plan doesn't reach its declared horizon or answer.

    specs: task_id, horizon, answer, reached (nodes), derived (the answer at the plan's end).
    """
    return _rows(specs, "S9", _first([("not all nodes are reached", ~F.col("reached").eqNullSafe(F.col("horizon"))), ("another answer", ~F.col("derived").eqNullSafe(F.col("answer")))]))


def absent_information(episodes: DataFrame, arms: tuple[str, ...] = ("BP", "TP")) -> DataFrame:
    """S11, what is a violation: a redacted task that succeeds, and one that never ran a decision. Leaks come first."""
    own = episodes.where((F.col("control") == "redacted") & F.col("arm").isin(*arms))
    leak = F.coalesce("raw_success", F.lit(False)) | F.coalesce("certified", F.lit(False))
    never = (F.col("termination") == "spec_error") | (F.coalesce("n_decisions", F.lit(0)) == 0)
    return _rows(own, "S11", _first([("succeeds without the information", leak), ("never ran a decision", F.coalesce(never, F.lit(False)))]))


def absent_coverage(episodes: DataFrame, need: int, arms: tuple[str, ...] = ("BP", "TP")) -> DataFrame:
    """S11, what is missing: (family, arm, n) of scored families with fewer redacted episodes than needed, 0 included."""
    scored = episodes.where((F.col("control") == "none") & F.col("arm").isin(*arms)).select("family").distinct()
    every = scored.withColumn("arm", F.explode(F.array(*map(F.lit, arms))))
    ran = episodes.where((F.col("control") == "redacted") & (F.coalesce("n_decisions", F.lit(0)) > 0) & ~F.coalesce(F.col("termination") == "spec_error", F.lit(False)))
    n = ran.groupBy("family", "arm").agg(F.count("*").alias("n"))
    return every.join(n, ["family", "arm"], "left").select("family", "arm", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < need)


def injection(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """S12: faults that fire more than once, at another node than planned, or with too few calls left.

    events: the key, call_id, args_digest, fault_triggered. episodes: planned_digest, fault_node (its place), horizon, max_calls.
    """
    fired = events.where("fault_triggered").groupBy(*KEY).agg(F.count("*").alias("fires"), F.min_by("args_digest", "call_id").alias("fired_digest"), F.min("call_id").alias("fired_call"))
    own = episodes.where((F.col("condition") == "faulted") & (F.col("control") == "none")).join(fired, list(KEY))
    left, needed = F.col("max_calls") - F.col("fired_call"), F.col("horizon") - F.coalesce("fault_node", F.lit(0))
    return _rows(own, "S12", _first([("fires more than once", F.col("fires") > 1), ("fires at another node", F.col("planned_digest").isNotNull() & (F.col("planned_digest") != F.col("fired_digest"))), ("can't be recovered from", left < needed)]))


def receipts(episodes: DataFrame) -> DataFrame:
    """S13: episodes with a receipt that doesn't hold."""
    return _rows(episodes, "S13", F.when(~F.coalesce("receipts_ok", F.lit(False)), "invalid receipts"))


def counterfactual(episodes: DataFrame, specs: DataFrame) -> DataFrame:
    """S14: specifications whose answer doesn't depend on the hidden value, and permuted episodes that succeed without the
    permuted answer.

    specs: task_id, answer, mutated_answer (after the hidden value is changed, null where that fails), hidden_key, sensitive.
    """
    insensitive = _rows(specs, "S14", _first([("no hidden key", F.col("hidden_key").isNull() & ~F.coalesce("sensitive", F.lit(False))), ("insensitive to the hidden value", F.col("mutated_answer") == F.col("answer"))]))
    own = episodes.where(F.col("control") == "permuted")
    other = F.col("committed").isNotNull() & F.coalesce("raw_success", F.lit(False)) & (F.lower(F.trim("committed")) != F.lower(F.trim(F.coalesce("answer", F.lit("")))))
    return insensitive.unionByName(_rows(own, "S14", F.when(other, "succeeds without the permuted answer")))


def attrition(episodes: DataFrame, specs: DataFrame, arms: tuple[str, ...] = ("BP", "TP")) -> DataFrame:
    """S15: (arm, condition, missing): assigned tasks without a trace."""
    cells = F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(c).alias("condition")) for a in arms for c in ("clean", "faulted")))
    planned = specs.select("task_id").distinct().select("task_id", F.explode(cells).alias("cell")).select("task_id", "cell.*")
    seen = episodes.where(F.col("control") == "none").select("arm", "condition", "task_id")
    return planned.join(seen, ["arm", "condition", "task_id"], "left_anti").groupBy("arm", "condition").agg(F.count("*").alias("missing"))


def control_integrity(episodes: DataFrame, base_id: str, prompts: tuple[str, ...], winner: str | None, checkpoint: str | None) -> DataFrame:
    """S16: the first episode of each file on another base, prompt or adapter than registered.

    Provenance is constant in a file (arm, condition, control), so one episode of it, the first by its task, is looked at.
    Columns: base_id, prompt_sha256, adapter.
    """
    first = episodes.groupBy("arm", "condition", "control").agg(F.min_by(F.struct("base_id", "prompt_sha256", "adapter"), "task_id").alias("p")).select("arm", "condition", "control", "p.*")
    trained, prompted = F.col("arm").isin("T0", "TP", "R0", "RP"), F.col("arm").isin("BP", "TP", "RP")
    tests = [("another base", ~F.col("base_id").eqNullSafe(F.lit(base_id))), ("prompt isn't registered", ~F.coalesce(F.col("prompt_sha256").isin(*prompts), F.lit(False)))]
    if winner is not None:
        tests.append(("prompt isn't the winner", prompted & ~F.col("prompt_sha256").eqNullSafe(F.lit(winner))))
    tests.append(("adapter in a prompt-only arm", F.col("arm").isin("B0", "BP") & (F.coalesce("adapter", F.lit("")) != "")))
    if checkpoint is not None:
        tests.append(("adapter isn't the locked one", trained & ~F.col("adapter").eqNullSafe(F.lit(checkpoint))))
    return reduce(DataFrame.unionByName, [_rows(first, "S16", F.when(test, text)) for text, test in tests])


def recomputation(recorded: DataFrame, recomputed: DataFrame, fields: tuple[str, ...] = SHARED) -> DataFrame:
    """S17: episodes whose recorded fields aren't what an independent computation gives (null-safe), certified without the
    ledger's support, or refused without a reason.

    Both have the key and ``fields``; recorded has certified and reasons array<string>, recomputed has ledger_ok.
    """
    b = recomputed.select(*KEY, "ledger_ok", *(F.col(f).alias(f"{f}_again") for f in fields))
    both = recorded.join(b, list(KEY))
    silent = ~F.coalesce("certified", F.lit(False)) & (F.coalesce(F.size("reasons"), F.lit(0)) <= 0)
    return _rows(both, "S17", _first([*((f"{f} differs", ~F.col(f).eqNullSafe(F.col(f"{f}_again"))) for f in fields), ("certified without support", F.coalesce("certified", F.lit(False)) & ~F.col("ledger_ok")), ("refused without a reason", silent)]))


def strict_refusals(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Episodes that the ledger supports and the strict verdict refuses: the verifier at work, counted and no defect."""
    return recorded.where(~F.coalesce("certified", F.lit(False))).join(recomputed.where("ledger_ok").select(*KEY), list(KEY), "left_semi")


def fingerprints(episodes: DataFrame, required: tuple[str, ...], expected: dict[str, str], pairs: tuple[tuple[str, str], ...] = (("BP", "TP"), ("B0", "T0")), paired: tuple[str, ...] = ("gpu_uuid", "engine_fingerprint")) -> DataFrame:
    """S19: wrong cards, runs on more than one card, more than one run or engine, and pairs that don't share a fingerprint.

    Traces without all required fields are left to ``unprinted``.
    """
    whole = episodes.where(F.forall(F.array(*(F.col(f).cast("string") for f in required)), lambda x: x.isNotNull() & (x != "")))
    wrong = _rows(whole, "S19", _first([(f"{f} isn't the registered one", F.col(f).cast("string") != v) for f, v in expected.items()]))
    runs = whole.groupBy("run_id").agg(F.count_distinct("gpu_uuid").alias("n")).where("n > 1")
    runs = runs.select(F.lit("S19").alias("veto"), F.col("run_id").cast("string").alias("place"), F.lit("one run on more than one card").alias("detail"))
    counts = whole.agg(F.count_distinct("run_id").alias("runs"), F.count_distinct("engine_fingerprint").alias("engines"))
    many = reduce(DataFrame.unionByName, [counts.where(f"{c} > 1").select(F.lit("S19").alias("veto"), F.lit("all").alias("place"), F.lit(text).alias("detail")) for c, text in (("runs", "more than one run"), ("engines", "more than one engine"))])
    out = wrong.unionByName(runs).unionByName(many)
    rest = ["condition", "control", "task_id"]
    for one, two in pairs:
        b = whole.where(F.col("arm") == two).select(*rest, *(F.col(f).alias(f"{f}_two") for f in paired))
        a = whole.where(F.col("arm") == one).select("arm", *rest, *paired).join(b, rest)
        out = out.unionByName(_rows(a, "S19", _first([(f"{f} differs from {two}", ~F.col(f).eqNullSafe(F.col(f"{f}_two"))) for f in paired])))
    return out


def unprinted(episodes: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """S19, what is missing: traces that lack a required field, with its name."""
    return _rows(episodes, "S19", _first([(f"{f} is missing", F.coalesce(F.col(f).cast("string"), F.lit("")) == "") for f in required]))


def table(violations: DataFrame, checked: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """(veto, status, n_checked, n_bad): BUG with a violation, INCONCLUSIVE where nothing was checked or evidence is missing.

    checked: veto, n_checked. missing: veto, one row for each that lacks evidence.
    """
    bad = violations.groupBy("veto").agg(F.count("*").alias("n_bad"))
    lacks = (missing if missing is not None else checked.where("false")).select("veto").distinct().withColumn("_lacks", F.lit(True))
    both = checked.join(bad, "veto", "left").join(lacks, "veto", "left").na.fill(0, ["n_bad"])
    status = F.when(F.col("n_bad") > 0, "BUG").when((F.col("n_checked") == 0) | F.coalesce("_lacks", F.lit(False)), "INCONCLUSIVE").otherwise("OK")
    return both.select("veto", status.alias("status"), "n_checked", "n_bad")
