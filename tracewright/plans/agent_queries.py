"""Queries of acceptance, gates, vetoes, rescoring and completeness over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structure, values
from ..operators import acceptance, audits, census, completeness, registered, vetoes
from ..registry import query
from .proxies import AGENTS, agent_episodes, lower_sql, table, upper_sql

_R = registered.REGISTERED


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def _gate_sql() -> str:
    agg = "SELECT '{g}' AS gate, count(*) AS n, {e} AS estimate, {k} AS k FROM {t}"
    diff = lambda f: f"avg({f}_two - {f}_one)"
    parts = {
        "ER1": ("cc", "CAST(count(*) AS DOUBLE)", "0"), "ER2": ("cc", diff("recovered"), "0"), "ER3": ("cc", "avg(recovered_two)", "sum(recovered_two)"), "ER4": ("(SELECT * FROM core WHERE condition = 'clean')", diff("certified"), "0"),
        "ER5": ("(SELECT * FROM core WHERE condition = 'faulted')", diff("recovered"), "0"), "ER6": ("tp", "avg(runaway::INT)", "sum(runaway::INT)"), "ER7": ("tp", "avg(hallucinated::INT)", "sum(hallucinated::INT)"), "MT1": ("mt", diff("orchestrated"), "0"),
        "MT2": ("mt", "avg(orchestrated_two)", "sum(orchestrated_two)"), "MT3": ("mt", "CAST(quantile_disc(n_calls, 0.5 ORDER BY n_calls DESC) AS DOUBLE)", "0"), "HR1": ("hr", diff("certified"), "0"), "HR2": ("hr", "avg(runaway_two)", "sum(runaway_two)"), "HR3": ("hr", "avg(hallucinated_two)", "sum(hallucinated_two)"),
    }
    parts["MT3"] = ("mt", "CAST(list_sort(list(n_calls))[count(*) // 2 + 1] AS DOUBLE)", "0")
    rows = " UNION ALL ".join(agg.format(g=g, t=t, e=e, k=k) for g, (t, e, k) in parts.items())
    own = {"ER2": "PASS", "ER4": "FAIL", "MT1": "INCONCLUSIVE", "HR1": "PASS"}
    power = {"ER2": f"n >= {_R['er1_pairs']}", "ER4": "n > 0", "MT1": f"n >= {_R['mt1_pairs']}", "HR1": f"n >= {_R['hr1_pairs']} AND (SELECT count(*) FROM hr WHERE certified_one <> certified_two) >= {_R['hr1_discordant']}"}
    bound = " ".join(f"WHEN gate = '{g}' THEN CASE WHEN {power[g]} THEN '{s}' ELSE 'INCONCLUSIVE' END" for g, s in own.items())
    status = f"CASE {bound} WHEN gate = 'ER1' THEN CASE WHEN n >= {_R['er1_pairs']} THEN 'PASS' ELSE 'INCONCLUSIVE' END WHEN gate = 'ER3' AND n < {_R['er1_pairs']} THEN 'INCONCLUSIVE' WHEN gate = 'ER3' THEN {lower_sql('k', 'n', 0.6)} WHEN gate = 'ER5' THEN CASE WHEN n < {_R['er5_pairs']} THEN 'INCONCLUSIVE' WHEN estimate >= 0 THEN 'PASS' ELSE 'FAIL' END WHEN gate IN ('ER6','HR2') THEN {upper_sql('k', 'n', 0.03)} WHEN gate IN ('ER7','HR3') THEN {upper_sql('k', 'n', 0.01)} WHEN gate = 'MT2' THEN {lower_sql('k', 'n', 0.6)} WHEN gate = 'MT3' THEN CASE WHEN n = 0 THEN 'INCONCLUSIVE' WHEN estimate <= {_R['mt3_calls']} THEN 'PASS' ELSE 'FAIL' END END"
    measured = "CASE " + " ".join(f"WHEN gate = '{g}' THEN '{s}'" for g, s in own.items()) + f" WHEN gate = 'ER3' THEN {lower_sql('k', 'n', 0.6)} ELSE status END"
    groups = "SELECT 'ER8' AS gate, coalesce(sum(c), 0)::BIGINT AS n, min(d) AS estimate, CASE WHEN count(*) FILTER (c >= 400) < 3 OR count(*) FILTER (c < 400) > 0 THEN 'INCONCLUSIVE' WHEN min(d) < -0.05 THEN 'FAIL' ELSE 'PASS' END AS status FROM (SELECT CASE WHEN fault_class IN ('transient','rate_limit') THEN 'tr' ELSE fault_class END AS g, count(*) AS c, avg(recovered_two - recovered_one) AS d FROM core WHERE condition = 'faulted' GROUP BY 1)"
    patterns = "SELECT 'MT5', coalesce(sum(c), 0)::BIGINT, min(d), CASE WHEN count(*) FILTER (c >= 80) < 6 OR count(*) FILTER (c < 80) > 0 THEN 'INCONCLUSIVE' WHEN min(d) < -0.05 THEN 'FAIL' ELSE 'PASS' END FROM (SELECT pattern_id, count(*) AS c, avg(orchestrated_two - orchestrated_one) AS d FROM mt GROUP BY 1)"
    legs = f"SELECT 'MT4', n, greatest(a, b) / n, CASE WHEN n = 0 THEN 'INCONCLUSIVE' WHEN ua = 'FAIL' OR ub = 'FAIL' THEN 'FAIL' WHEN ua = 'INCONCLUSIVE' OR ub = 'INCONCLUSIVE' THEN 'INCONCLUSIVE' ELSE 'PASS' END FROM (SELECT *, {upper_sql('a', 'n', 0.03)} AS ua, {upper_sql('b', 'n', 0.01)} AS ub FROM (SELECT count(*) AS n, coalesce(sum(runaway_two), 0) AS a, coalesce(sum(hallucinated_two), 0) AS b FROM mt))"
    return f"""WITH {AGENTS}, core AS (SELECT * FROM pr WHERE split = 'main'), cc AS (SELECT f.* FROM core f WHERE f.condition = 'faulted' AND EXISTS (SELECT 1 FROM core c WHERE c.condition = 'clean' AND c.task_id = f.task_id AND c.certified_one = 1 AND c.certified_two = 1)),
tp AS (SELECT * FROM ag WHERE arm = 'TP' AND split = 'main'), mt AS (SELECT * FROM pr WHERE split = 'mt' AND condition = 'clean' AND all_tools AND horizon = 4), hr AS (SELECT * FROM pr WHERE split = 'h8' AND condition = 'clean' AND horizon = 8 AND family IN ('lookup_chain','typed_relay')),
m AS ({rows}), s AS (SELECT *, {status} AS status FROM m), w AS (SELECT gate, n, estimate, status, {measured} AS measured FROM s UNION ALL SELECT *, status FROM ({groups}) UNION ALL SELECT *, status FROM (SELECT * FROM ({patterns}) t(gate, n, estimate, status)) UNION ALL SELECT *, status FROM (SELECT * FROM ({legs}) t(gate, n, estimate, status)))
SELECT gate, n, round(estimate, 6) AS estimate, status, measured FROM w"""


@query(_gate_sql())
def registered_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates as a table, with given clustered bounds: above, below, degenerate, and just above their margins."""
    bounds = spark.createDataFrame([("ER2", 0.06, False), ("ER4", -0.04, False), ("MT1", 0.5, True), ("HR1", 0.0501, False)], "gate string, bound double, degenerate boolean")
    return registered.gates(agent_episodes(spark, sf_dir), bounds).select("gate", "n", r6(F.col("estimate"), "estimate"), "status", "measured")


@query(f"""WITH {AGENTS}, f AS (SELECT arm, condition, family, count(*) AS c, sum(certified::INT) AS k, sum((runaway OR termination = 'wall_clock')::INT) AS x FROM ag WHERE split = 'main' GROUP BY ALL),
a AS (SELECT arm, sum(c) FILTER (condition = 'clean') AS nc, sum(k) FILTER (condition = 'clean') AS kc, sum(c) FILTER (condition = 'faulted') AS nf, sum(k) FILTER (condition = 'faulted') AS kf, min(k / c) FILTER (condition = 'clean') AS lc, min(k / c) FILTER (condition = 'faulted') AS lf, sum(c) AS n, sum(x) AS x FROM f GROUP BY arm),
r AS (SELECT arm, 'F1' AS floor, nc AS n, kc / nc AS rate, 0.65 AS level FROM a UNION ALL SELECT arm, 'F2', nc, lc, 0.5 FROM a UNION ALL SELECT arm, 'F3', nf, kf / nf, 0.4 FROM a UNION ALL SELECT arm, 'F4', nf, lf, 0.25 FROM a UNION ALL SELECT arm, 'F5', n, x / n, 0.02 FROM a)
SELECT arm, floor, n::BIGINT AS n, round(rate, 6) AS rate, CASE WHEN (floor = 'F5' AND rate < level) OR (floor <> 'F5' AND rate >= level) THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def launch_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 to F5 of both arms."""
    return registered.floors(agent_episodes(spark, sf_dir)).select("arm", "floor", "n", r6(F.col("rate"), "rate"), "status")


@query(f"""WITH {AGENTS}, p AS (SELECT coalesce(a.task_id, b.task_id) AS t FROM (SELECT * FROM ag WHERE arm = 'BP') a FULL JOIN (SELECT * FROM ag WHERE arm = 'TP') b ON a.task_id = b.task_id AND a.condition = b.condition WHERE a.task_id IS NULL OR b.task_id IS NULL OR a.budgets IS DISTINCT FROM b.budgets),
v AS (SELECT 'S8' AS veto, count(*) AS n_bad, (SELECT count(*) FROM ag) AS n_checked FROM p UNION ALL SELECT 'S13', count(*), (SELECT count(*) FROM ag) FROM ag WHERE NOT receipts_ok UNION ALL SELECT 'S17', count(*) FILTER (k % 1009 = 0), count(*) FROM ag)
SELECT veto, CASE WHEN n_bad > 0 THEN 'BUG' WHEN n_checked = 0 THEN 'INCONCLUSIVE' ELSE 'OK' END AS status, n_checked, n_bad FROM v""")
def veto_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairing, receipts and recomputation as one table of vetoes."""
    e = agent_episodes(spark, sf_dir)
    recorded = e.select(*vetoes.KEY, "runaway", "certified", F.array(F.lit("x")).alias("reasons"))
    again = e.select(*vetoes.KEY, (F.col("runaway") != (F.col("k") % 1009 == 0)).alias("runaway"), F.lit(True).alias("ledger_ok"))
    found = vetoes.pairing(e, fields=("budgets",)).unionByName(vetoes.receipts(e)).unionByName(vetoes.recomputation(recorded, again, ("runaway",)))
    checked = e.agg(F.count("*").alias("n_checked")).withColumn("veto", F.explode(F.array(*map(F.lit, ("S8", "S13", "S17")))))
    return vetoes.table(found, checked)


@query(f"WITH {AGENTS}, a AS (SELECT unnest(['BP','TP']) AS arm), c AS (SELECT arm, unnest(['clean','faulted']) AS condition FROM a) SELECT arm, condition, count(*) AS missing FROM (SELECT DISTINCT task_id FROM ag) t CROSS JOIN c WHERE NOT EXISTS (SELECT 1 FROM ag WHERE ag.arm = c.arm AND ag.condition = c.condition AND ag.task_id = t.task_id) GROUP BY 1, 2")
def trace_attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks without a trace, by arm and condition."""
    e = agent_episodes(spark, sf_dir)
    return vetoes.attrition(e, e)


@query(f"WITH {AGENTS} SELECT CASE WHEN fault_class IN ('transient','rate_limit') THEN 'transient_or_rate_limit' ELSE fault_class END AS fault_group, count(*) AS n, round(avg(recovered_two - recovered_one), 6) AS difference FROM pr WHERE condition = 'faulted' GROUP BY 1")
def recovery_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more often the trained arm recovers, by fault group."""
    p = registered.arm_pairs(agent_episodes(spark, sf_dir), "faulted", ("main", "mt", "h8")).withColumn("fault_group", structure.fault_group(F.col("fault_class")))
    return census.paired_difference(p, "fault_group", "recovered_two", "recovered_one").select("fault_group", "n", r6(F.col("difference"), "difference"))


_TRAJECTORIES = "t AS (SELECT CAST(o_orderkey AS BIGINT) AS k, o_orderkey % 31 = 0 AS exhausted, o_orderkey % 29 = 0 AS truncated, CASE WHEN o_orderkey % 23 = 0 THEN '' WHEN o_orderkey % 19 = 0 THEN 'x</think>' WHEN o_orderkey % 17 = 0 THEN 'no number' ELSE 'it is \\boxed{' || o_orderkey % 7 || '}' || repeat(' w', (o_orderkey % 200)::INT) END AS final, CAST(o_orderkey % 7 + (o_orderkey % 13 = 0)::INT AS VARCHAR) AS truth, o_orderkey % 9 AS n_calls, CASE WHEN o_orderkey % 11 = 0 THEN 'kb_lookup' ELSE 'calculator' END AS tool, o_orderkey % 37 = 0 AS tool_error FROM orders)"


@query(rf"""WITH {_TRAJECTORIES}, r AS (SELECT CASE WHEN exhausted THEN 'max_turns_exhausted' WHEN truncated THEN 'truncated_final' WHEN final = '' THEN 'no_final' WHEN contains(final, '</think>') THEN 'stray_think' WHEN NOT contains(final, 'boxed') THEN 'no_box' WHEN CAST(truth AS INT) <> k % 7 THEN 'wrong' WHEN n_calls = 0 THEN 'no_tool' WHEN n_calls > 6 THEN 'too_many_calls' WHEN 3 + k % 200 > 128 THEN 'final_too_long' WHEN tool <> 'calculator' THEN 'irrelevant_tool' WHEN tool_error THEN 'tool_error' ELSE 'accepted' END AS reason FROM t) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def trajectory_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why trajectories are rejected, by the first of eleven reasons."""
    k = F.col("k")
    final = F.when(k % 23 == 0, "").when(k % 19 == 0, "x</think>").when(k % 17 == 0, "no number").otherwise(F.concat(F.lit("it is \\boxed{"), (k % 7).cast("string"), F.lit("}"), F.repeat(F.lit(" w"), (k % 200).cast("int"))))
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")).select("k", (k % 31 == 0).alias("exhausted"), (k % 29 == 0).alias("truncated"), final.alias("final"), (k % 7 + (k % 13 == 0).cast("int")).cast("string").alias("truth"), (k % 9).alias("n_calls"), F.array(F.when(k % 11 == 0, "kb_lookup").otherwise("calculator")).alias("tools"), (k % 37 == 0).alias("tool_error"))
    return census.rejections(t.withColumn("reason", acceptance.trajectory_reason(6)))


@query("WITH g AS (SELECT o_custkey % 20 AS cell, o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) > 1 AS varies, count(DISTINCT o_orderstatus = 'F') > 1 AS disagree, count_if(o_orderstatus = 'F') AS successes, count_if(o_orderkey % 50 = 0) AS clipped, bool_or(o_orderkey % 4001 = 0) AS unsafe FROM orders GROUP BY 1, 2), c AS (SELECT cell, count(*) AS n_groups, avg(varies::INT) AS varying, avg(disagree::INT) AS disagreeing, sum(successes) / sum(n) AS success, sum(clipped) / sum(n) AS clipped, count_if(unsafe) AS leaks FROM g GROUP BY cell) SELECT cell, n_groups, round(varying, 6) AS varying, round(success, 6) AS success, leaks, varying >= 0.6 AND disagreeing >= 0.4 AND success BETWEEN 0.15 AND 0.85 AND clipped <= 0.05 AND leaks = 0 AS eligible FROM c")
def eligible_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cells' groups vary enough to train on."""
    o = table(spark, sf_dir, "orders")
    f = F.col("o_orderstatus") == "F"
    g = o.groupBy((F.col("o_custkey") % 20).alias("cell"), "o_custkey").agg(F.count("*").alias("n"), (F.count_distinct("o_orderstatus") > 1).alias("varies"), (F.bool_or(f) & ~F.bool_and(f)).alias("disagree"), F.count_if(f).alias("successes"), F.count_if(F.col("o_orderkey") % 50 == 0).alias("clipped"), F.bool_or(F.col("o_orderkey") % 4001 == 0).alias("unsafe"))
    g = g.withColumn("inconsistent", F.lit(False)).withColumn("replay_failed", F.lit(False))
    return registered.eligible_cells(g, "cell").select("cell", "n_groups", r6(F.col("varying"), "varying"), r6(F.col("success"), "success"), "leaks", "eligible")


@query(r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'the answer' ELSE 'so \boxed{' || CASE WHEN doc_id % 2 = 0 THEN '`' || upper(lang) || '\_x`' ELSE (doc_id % 9) || '\%' END || '}.' END AS final, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN lang || '_x' ELSE 'zz' END ELSE CAST(doc_id % 9 + (doc_id % 7 = 0)::INT AS VARCHAR) END AS truth, doc_id % 4 = 0 AS ok FROM documents),
b AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'token' ELSE 'integer' END AS kind, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN doc_id % 3 = 0 ELSE doc_id % 7 <> 0 END AS box FROM f)
SELECT doc_id, kind, box, coalesce(CASE WHEN kind = 'token' AND NOT box THEN NULL ELSE box END, ok) AS "right" FROM b""")
def rescored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded outcomes corrected by the box, by kind of answer: a token's box can't demote."""
    i = F.col("doc_id")
    boxed = F.when(i % 2 == 0, F.concat(F.lit("`"), F.upper("lang"), F.lit("\\_x`"))).otherwise(F.concat((i % 9).cast("string"), F.lit("\\%")))
    final = F.when(i % 5 == 0, "the answer").otherwise(F.concat(F.lit("so \\boxed{"), boxed, F.lit("}.")))
    truth = F.when(i % 2 == 0, F.when(i % 3 == 0, F.concat("lang", F.lit("_x"))).otherwise("zz")).otherwise((i % 9 + (i % 7 == 0).cast("int")).cast("string"))
    f = table(spark, sf_dir, "documents").select("doc_id", final.alias("final"), truth.alias("truth"), (i % 4 == 0).alias("ok")).withColumn("kind", values.answer_kind(F.lit(""), F.col("truth")))
    return f.select("doc_id", "kind", values.boxed_right(F.col("final"), F.col("truth"), F.col("kind")).alias("box"), values.rescored(F.col("ok"), F.col("final"), F.col("truth"), F.col("kind")).alias("right"))


@query("WITH l AS (SELECT l_orderkey AS e, l_linenumber AS n, CAST(l_partkey % 20 AS VARCHAR) AS gives, '(' || (l_suppkey % 20) || ' + 4) * 2' AS takes, l_suppkey % 20 AS s FROM lineitem) SELECT DISTINCT a.e AS episode, a.n AS a, b.n AS b FROM l a JOIN l b ON a.e = b.e AND a.n < b.n AND (a.gives = CAST(b.s AS VARCHAR) OR a.gives IN ('4', '2'))")
def text_dataflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls feed which later ones, by numbers in their arguments."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(F.col("l_orderkey").alias("episode"), F.col("l_linenumber").alias("call_id"), F.col("l_linenumber").alias("decision_id"), F.array((F.col("l_partkey") % 20).cast("string")).alias("gives"), F.array(F.concat(F.lit("("), (F.col("l_suppkey") % 20).cast("string"), F.lit(" + 4) * 2"))).alias("takes"))
    return audits.text_feeds(base, base)


@query("WITH one AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS ok FROM orders GROUP BY 1), two AS (SELECT o_custkey AS k, bool_and(o_orderstatus = 'F') AS ok FROM orders GROUP BY 1), d AS (SELECT count(*) AS n_pairs, count_if(one.ok AND NOT two.ok) AS b, count_if(NOT one.ok AND two.ok) AS c FROM one JOIN two ON one.k = two.k) SELECT n_pairs, b, c, round(CASE WHEN b + c > 0 THEN (c - b) / sqrt(b + c) ELSE 0 END, 6) AS z FROM d WHERE n_pairs >= 10")
def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """McNemar's test over the common indexes of two arms."""
    o = table(spark, sf_dir, "orders")
    f = F.col("o_orderstatus") == "F"
    one, two = (o.groupBy(F.col("o_custkey").alias("k")).agg(g(f).alias("ok")) for g in (F.bool_or, F.bool_and))
    return registered.paired_test(one, two, "k", "ok").select("n_pairs", "b", "c", r6(F.col("z"), "z"))


@query("WITH p AS (SELECT c_custkey AS shard, unnest(generate_series(1, 10)) AS r FROM customer), s AS (SELECT o_custkey AS shard, 1 + o_orderkey % 12 AS r, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT coalesce(p.shard, s.shard) AS shard, count_if(s.n IS NULL) AS missing, count_if(p.r IS NULL) AS extra, count_if(s.n > 1) AS twice FROM p FULL JOIN s ON p.shard = s.shard AND p.r = s.r GROUP BY 1) SELECT CAST(shard AS VARCHAR) AS key, unnest(list_filter([CASE WHEN missing > 0 THEN 'rollouts missing' END, CASE WHEN extra > 0 THEN 'rollouts that aren''t owed' END, CASE WHEN twice > 0 THEN 'rollouts twice' END, CASE WHEN shard % 3 > 0 THEN 'no receipt' END], lambda x: x IS NOT NULL)) AS gap FROM b")
def shard_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as shards that owe ten rollouts each."""
    c = table(spark, sf_dir, "customer")
    shards = c.select(F.col("c_custkey").alias("shard"), F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: i.cast("string")).alias("rollouts"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("shard"), (F.col("o_orderkey") % 12 + 1).cast("string").alias("rollout"))
    receipts = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("shard"), F.lit(None).cast("long").alias("rows"), F.lit("d").alias("digest"), F.lit("d").alias("rows_digest"), F.lit(True).alias("sealed"))
    return completeness.shard_gaps(shards, rows, receipts)


@query("WITH a AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1), f AS (SELECT conv_id, min(turn) AS result FROM conversations GROUP BY 1) SELECT c.conv_id AS episode, min(c.turn) AS first_turn FROM conversations c JOIN a ON a.conv_id = c.conv_id JOIN f ON f.conv_id = c.conv_id WHERE c.role = 'assistant' AND c.turn > f.result AND c.turn < a.last GROUP BY 1")
def first_after_fault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first assistant turn after each conversation's first message that isn't its last one."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("index"), "role")
    faults = m.groupBy("episode").agg(F.min("index").alias("result_index"), F.lit(None).cast("int").alias("recovery_index"))
    return completeness.first_after_fault(m, faults).select("episode", "first_turn")


@query("WITH l AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY 1) SELECT c.conv_id AS episode, count_if(turn < last) AS n_prompt, sha256(max(text) FILTER (turn = last)) AS completion FROM conversations c JOIN l ON l.conv_id = c.conv_id WHERE turn <= last GROUP BY 1")
def terminal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training row a conversation: everything before its last assistant message, and that."""
    m = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("index"), "role", F.col("text").alias("content"))
    return acceptance.terminal_rows(m).select("episode", F.size("prompt").cast("long").alias("n_prompt"), F.sha2("completion", 256).alias("completion"))


@query("WITH e AS (SELECT user_id AS rollout, event_type AS name, value, event_id FROM events WHERE event_type IN ('view','click','purchase')), l AS (SELECT rollout, name, arg_max(value, event_id) AS value FROM e GROUP BY 1, 2) SELECT rollout, round(max(value) FILTER (name = 'view'), 6) AS view, round(max(value) FILTER (name = 'click'), 6) AS click, round(max(value) FILTER (name = 'purchase'), 6) AS purchase FROM l GROUP BY 1 HAVING count(*) = 3")
def joined_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that have all three kinds of events, with the last value of each."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("rollout"), F.col("event_type").alias("name"), "value", F.col("event_id").alias("seq"))
    return completeness.joined_rewards(e, "rollout", ("view", "click", "purchase")).select("rollout", *(r6(F.col(c), c) for c in ("view", "click", "purchase")))


@query("WITH s AS (SELECT event_type AS stage, CAST(count(*) AS DOUBLE) AS nominal, CAST(avg(value) AS DOUBLE) AS declared, CASE WHEN event_type LIKE '%e%' THEN 5000.0 END AS committed FROM events GROUP BY 1), m AS (SELECT stage, greatest(nominal, declared, coalesce(committed, 0)) AS minutes, nominal, declared, committed FROM s) SELECT stage, round(minutes, 6) AS minutes, CASE WHEN minutes = nominal THEN 'nominal' WHEN minutes = declared THEN 'declared' ELSE 'committed' END AS source, round(10 + minutes / 60, 6) AS projected_hours, 10 + minutes / 60 <= 60 AS allowed FROM m")
def budget_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest projection of each stage against the ceiling."""
    s = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").cast("double").alias("nominal"), F.avg("value").alias("declared"))
    s = s.withColumn("committed", F.when(F.contains("stage", F.lit("e")), 5000.0))
    return registered.budget_guard(s, 10.0, 60.0).select("stage", r6(F.col("minutes"), "minutes"), "source", r6(F.col("projected_hours"), "projected_hours"), "allowed")
