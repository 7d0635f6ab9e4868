"""Queries of the ledger, leakage, statistics and text operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers as an
from ..functions import canon, stats
from ..operators import gates, leakage
from ..operators import ledger as le
from ..registry import query
from .proxies import CALLS, PAIRS, SPLITS, arms, calls, splits, table, wilson_sql


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"WITH {CALLS}, m AS (SELECT *, error AND coalesce(tool = lag(tool, 1) OVER w AND lag(error, 1) OVER w, false) AND coalesce(tool = lag(tool, 2) OVER w AND lag(error, 2) OVER w, false) AS run FROM calls WINDOW w AS (PARTITION BY episode ORDER BY call_id)) SELECT episode, min(call_id) AS first_at, count(*) AS runs FROM m WHERE run GROUP BY episode")
def runaway_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three identical failing calls in a row."""
    return le.repeated_errors(calls(spark, sf_dir), "episode", ["call_id"], "tool", F.col("error"))


@query(f"WITH {CALLS}, s AS (SELECT *, row_number() OVER (PARTITION BY episode, digest ORDER BY call_id) > 1 AS seen FROM calls), i AS (SELECT *, row_number() OVER w - sum(seen::INT) OVER w AS island FROM s WINDOW w AS (PARTITION BY episode ORDER BY call_id)), r AS (SELECT episode, island, count(*) AS len FROM i WHERE seen GROUP BY episode, island) SELECT episode, max(len) AS longest, count(*) AS runs FROM r WHERE len >= 2 GROUP BY episode")
def stalled_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of results that were all seen before (two or more, as the stand-in repeats little)."""
    return le.stalled(calls(spark, sf_dir), "episode", ["call_id"], "digest", 2)


@query(f"WITH {CALLS}, g AS (SELECT episode, digest, count(*) AS n FROM calls GROUP BY episode, digest) SELECT episode, sum(n - 1)::BIGINT AS duplicates, sum(n)::BIGINT AS calls FROM g GROUP BY episode")
def duplicate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return le.duplicate_calls(calls(spark, sf_dir), "episode", "digest")


@query(f"WITH {CALLS}, f AS (SELECT episode, min(call_id) AS fired_at FROM calls WHERE error GROUP BY episode) SELECT f.episode, f.fired_at, min(c.call_id) AS recovered_at FROM f LEFT JOIN calls c ON c.episode = f.episode AND c.call_id > f.fired_at AND c.tool = 'purchase' GROUP BY f.episode, f.fired_at")
def fault_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fire of each episode and the first qualifying call after it."""
    return le.recoveries(calls(spark, sf_dir), "episode", "call_id", F.col("error"), F.col("tool") == "purchase")


@query(f"WITH {CALLS} SELECT episode, (['error','signup','view','click','purchase'])[min(list_position(['error','signup','view','click','purchase'], tool))::INT] AS reason FROM calls WHERE value < 5 GROUP BY episode")
def worst_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reason of highest precedence."""
    return le.worst_reason(calls(spark, sf_dir).where("value < 5"), "episode", "tool", ["error", "signup", "view", "click", "purchase"])


@query(f"WITH {CALLS} SELECT episode, max(call_id) AS answered_at FROM calls WHERE tool = 'view' GROUP BY episode")
def answer_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last validated event of each episode."""
    return calls(spark, sf_dir).where("tool = 'view'").groupBy("episode").agg(F.max("call_id").alias("answered_at"))


@query("""WITH RECURSIVE """ + CALLS + """, s AS (SELECT episode, 0 AS done, 0 AS last FROM (SELECT DISTINCT episode FROM calls) UNION ALL SELECT s.episode, s.done + 1, (SELECT min(c.call_id) FROM calls c WHERE c.episode = s.episode AND c.call_id > s.last AND c.tool = (['view','click','purchase','signup'])[s.done + 1]) FROM s WHERE s.done < 4 AND s.last IS NOT NULL)
SELECT episode, max(CASE WHEN last IS NOT NULL THEN done END) AS completed, max(CASE WHEN last IS NOT NULL THEN done END) = 4 AS whole FROM s GROUP BY episode""")
def ordered_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an ordered plan that an episode completes, each on a later decision."""
    return le.completed(calls(spark, sf_dir).withColumn("decision", F.col("call_id")), "episode", "call_id", "decision", "tool", ["view", "click", "purchase", "signup"])


@query(f"WITH {CALLS} SELECT event_id, round(CASE WHEN count(value) OVER w = 8 THEN avg(value) OVER w END, 6) AS rolling, coalesce(CASE WHEN count(value) OVER w = 8 THEN avg(value) OVER w END >= 30, false) AS abort FROM calls WINDOW w AS (PARTITION BY episode ORDER BY call_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)")
def clip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the last eight values against a threshold; silent until the window is full."""
    # a power of two scales a double without rounding, so means and the threshold of 30 are those of the values themselves
    c = calls(spark, sf_dir).withColumn("value", F.col("value") / 128)
    return le.clip_guard(c, "episode", ["call_id"], "value", 8, 30 / 128).select("event_id", r6(F.col("rolling") * 128, "rolling"), "abort")


@query("WITH j AS (SELECT user_id AS journal_id, CASE event_type WHEN 'signup' THEN 'open' WHEN 'purchase' THEN 'close' ELSE 'heartbeat' END AS event, ts, event_id FROM events), m AS (SELECT *, sum((event = 'open')::INT) OVER (PARTITION BY journal_id ORDER BY ts, event_id) AS o FROM j), l AS (SELECT *, max(o) OVER (PARTITION BY journal_id) AS lo FROM m) SELECT journal_id, min(ts) FILTER (event = 'open') AS opened_at, max(ts) AS last_at, bool_or(event = 'close') AS closed FROM l WHERE o = lo AND lo > 0 GROUP BY journal_id")
def journal_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each journal since it was last opened."""
    j = table(spark, sf_dir, "events").select(F.col("user_id").alias("journal_id"), F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "purchase", "close").otherwise("heartbeat").alias("event"), "ts", "event_id")
    return le.journal_state(j, "journal_id", ["ts", "event_id"], "event", "ts")


@query(f"WITH {SPLITS}, h AS (SELECT DISTINCT kind, value, split FROM keys) SELECT a.kind, a.split AS split_a, b.split AS split_b, count(*) AS n FROM h a JOIN h b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY ALL")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that two splits share, by kind."""
    return leakage.crossings(splits(spark, sf_dir), "kind", "value", "split").select("kind", "split_a", "split_b", "n")


@query(f"WITH {SPLITS} SELECT split, value, count(*) AS n FROM keys WHERE kind = 'content' GROUP BY split, value HAVING count(*) > 1")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a split has more than once."""
    return leakage.within_duplicates(splits(spark, sf_dir).where("kind = 'content'"), "split", "value")


@query("SELECT o_custkey AS custkey, count(*) AS rows FROM orders GROUP BY 1 HAVING count(*) > 1")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of more than one row."""
    return leakage.not_unique(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey"), "custkey")


@query("WITH a AS (SELECT n_name AS name FROM nation WHERE n_regionkey < 3), b AS (SELECT n_name AS name FROM nation WHERE n_regionkey > 1) SELECT name, 'listed' AS side FROM (SELECT name FROM a EXCEPT SELECT name FROM b) UNION ALL SELECT name, 'permitted' FROM (SELECT name FROM b EXCEPT SELECT name FROM a)")
def permitted_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    return leakage.set_difference(n.where("n_regionkey < 3"), n.where("n_regionkey > 1"), "name")


@query(f"WITH {PAIRS}, d AS (SELECT cluster, count(*) AS n, sum(ok_one::INT)::BIGINT AS k1, sum(ok_two::INT)::BIGINT AS k2, sum((ok_one AND NOT ok_two)::INT)::BIGINT AS b, sum((NOT ok_one AND ok_two)::INT)::BIGINT AS c FROM pairs GROUP BY cluster), q AS (SELECT *, (k1 + k2) / (2.0 * n) AS pool FROM d) SELECT cluster, n, b, c, round(CASE WHEN b + c > 0 THEN (c - b) / sqrt(b + c) ELSE 0 END, 6) AS mcnemar_z, round(CASE WHEN pool * (1 - pool) = 0 THEN 0 ELSE (k1 - k2) / (n * 1.0) / sqrt(pool * (1 - pool) * 2.0 / n) END, 6) AS two_z, round((1.959964 + 0.841621) * sqrt(2 * (k1 * 1.0 / n) * (1 - k1 * 1.0 / n) * (2.0 / n) / 2), 6) AS detectable FROM q")
def cluster_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired and pooled z and the detectable difference of each cluster."""
    from ..operators import episodes as ep

    one, two = arms(spark, sf_dir)
    d = ep.discordant(ep.paired(one, two, "task", "ok", ("cluster",)), "cluster")
    n, k1, k2, b, c = (F.col(x) for x in ("n", "k_one", "k_two", "b", "c"))
    return d.select("cluster", "n", "b", "c", r6(stats.mcnemar_z(b, c), "mcnemar_z"), r6(stats.two_proportions(k1, n, k2, n), "two_z"), r6(stats.detectable(n, n, k1 / n), "detectable"))


@query()
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact paired tests at any size, with Holm's correction over the strata."""
    from ..operators import episodes as ep

    one, two = arms(spark, sf_dir)
    d = ep.discordant(ep.paired(one, two, "task", "ok", ("stratum",)), "stratum")
    tested = d.withColumn("t", stats.mcnemar_exact("b", "c")).select("stratum", "b", "c", "t.two_sided", "t.one_sided")
    return stats.holm(tested, "two_sided", order=("stratum",))


@query("WITH p AS (SELECT c_mktsegment AS family, c_nationkey AS gate, CASE WHEN c_nationkey % 7 = 0 THEN NULL ELSE round(avg(c_acctbal) / 100000.0, 8) END AS p FROM customer GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY family) AS m FROM p WINDOW w AS (PARTITION BY family ORDER BY coalesce(p, 1), gate)) SELECT family, gate, round(least(1.0, max((m - i + 1) * coalesce(p, 1)) OVER (PARTITION BY family ORDER BY i)), 6) AS p_holm FROM r")
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down p values of each family; a missing p enters as 1."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("family"), F.col("c_nationkey").alias("gate")).agg(F.round(F.avg("c_acctbal") / 100000.0, 8).alias("p"))
    c = c.withColumn("p", F.when(F.col("gate") % 7 != 0, F.col("p")))
    return stats.holm(c, "p", ("family",), ("gate",)).select("family", "gate", r6(F.col("p_holm"), "p_holm"))


_, _LOW, _HIGH = wilson_sql("k", "n")


@query(f"WITH g AS (SELECT l_shipdate::DATE AS day, count(*) AS n, count_if(l_returnflag = 'A') AS k FROM lineitem GROUP BY 1) SELECT day, n, k, CASE WHEN {_HIGH} <= 0.5 THEN 'PASS' WHEN 1.959964 * 1.959964 / (n + 1.959964 * 1.959964) > 0.5 THEN 'INCONCLUSIVE' ELSE 'FAIL' END AS upper_status, CASE WHEN {_LOW} >= 0.1 THEN 'PASS' WHEN n / (n + 1.959964 * 1.959964) < 0.1 THEN 'INCONCLUSIVE' ELSE 'FAIL' END AS lower_status FROM g")
def interval_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both interval gates of every day's rate, with the state of being unmeasurable at that n."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("k"))
    return g.select("day", "n", "k", stats.upper_gate(F.col("k"), F.col("n"), 0.5).alias("upper_status"), stats.lower_gate(F.col("k"), F.col("n"), 0.1).alias("lower_status"))


@query("WITH g AS (SELECT l_suppkey % 30 AS claim, l_partkey % 9 AS gate, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2), s AS (SELECT claim, CASE WHEN gate = 0 AND claim % 10 = 3 THEN 1 WHEN m < 0.045 THEN 2 WHEN m < 0.048 THEN 3 ELSE 4 END AS sev FROM g) SELECT claim, (['BUG','FAIL','INCONCLUSIVE','PASS'])[min(sev)::INT] AS claim_status FROM s GROUP BY claim")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates with the overlay of harness bugs, reduced to the worst status of each claim."""
    g = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 30).alias("claim"), (F.col("l_partkey") % 9).alias("gate")).agg(F.avg("l_discount").alias("m"))
    g = g.select("claim", F.concat_ws("/", F.col("claim").cast("string"), F.col("gate").cast("string")).alias("name"), F.when(F.col("m") < 0.045, "FAIL").when(F.col("m") < 0.048, "INCONCLUSIVE").otherwise("PASS").alias("status"), "gate")
    return stats.worst(gates.overlaid(g, g.where("gate = 0 and claim % 10 = 3"), "name"), "claim")


@query("WITH c AS (SELECT l_suppkey AS family, l_linenumber AS horizon, round(avg((l_returnflag <> 'A')::INT), 6) AS rate FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(horizon) FILTER (rate >= 0.66) OVER (PARTITION BY family) AS lo FROM c) SELECT family, min(lo) AS last_above, min(horizon) FILTER (lo IS NULL OR horizon > lo) AS first_below, CASE WHEN min(lo) IS NULL THEN 'left_censored' WHEN min(horizon) FILTER (horizon > lo) IS NULL THEN 'right_censored' ELSE 'crossing' END AS state FROM m GROUP BY family")
def horizon_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each family's observed curve falls below a rate."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("family"), F.col("l_linenumber").alias("horizon")).agg(F.round(F.avg((F.col("l_returnflag") != "A").cast("int")), 6).alias("rate"))
    return gates.crossing_horizon(c, ["family"], "horizon", "rate", 0.66)


@query()
def bootstrap_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered clustered bootstrap of the paired difference, 10,000 replicates, with its gate."""
    from ..operators import episodes as ep

    one, two = arms(spark, sf_dir)
    pairs = ep.paired(one, two, "task", "ok", ("cluster",))
    r = gates.bootstrap_bound(pairs, "cluster", F.col("ok_two").cast("int") - F.col("ok_one").cast("int"), "ER2", 10_000)
    return spark.createDataFrame([("ER2", r["point"], r["bound"], r["clusters"], gates.bootstrap_gate(r, 0.05))], "gate string, point double, bound double, clusters long, status string")


@query("WITH t AS (SELECT doc_id, 'x ANSWER: ' || CASE doc_id % 4 WHEN 0 THEN '\\boxed{' || n_chars || '}.' WHEN 1 THEN source || '.' WHEN 2 THEN '`q' ELSE 'v,' || lang || ';' END || CASE WHEN doc_id % 5 = 0 THEN ' then answer : z' || doc_id ELSE '' END AS s, n_chars, source, lang FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'z' || doc_id WHEN doc_id % 4 = 0 THEN n_chars::VARCHAR WHEN doc_id % 4 = 1 THEN source WHEN doc_id % 4 = 3 THEN 'v,' || lang END AS answer FROM t")
def committed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The committed answer of a made-up final message."""
    d = table(spark, sf_dir, "documents")
    case = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("\\boxed{"), F.col("n_chars").cast("string"), F.lit("}."))).when(F.col("doc_id") % 4 == 1, F.concat("source", F.lit("."))).when(F.col("doc_id") % 4 == 2, F.lit("`q")).otherwise(F.concat(F.lit("v,"), "lang", F.lit(";")))
    s = F.concat(F.lit("x ANSWER: "), case, F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" then answer : z"), F.col("doc_id").cast("string"))).otherwise(""))
    return d.select("doc_id", an.committed(s).alias("answer"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice) END AS value FROM orders")
def answer_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the notations that models write, and what isn't one."""
    o = table(spark, sf_dir, "orders")
    whole = F.floor("o_totalprice").cast("string")
    s = F.when(F.col("o_orderkey") % 3 == 0, "n/a").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("\\$"), F.format_number(F.floor("o_totalprice"), 0), F.lit("."))).otherwise(F.concat(F.lit(" "), whole, F.lit("\\%")))
    return o.select(F.col("o_orderkey").alias("id"), an.number(s).alias("value"))


@query("SELECT event_id, sha256('{\"k\":' || regexp_extract(props, '\\d+') || ',\"t\":\"' || event_type || '\"}') AS digest FROM events")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of canonical JSON, whatever the order and spacing of the source."""
    e = table(spark, sf_dir, "events")
    raw = F.concat(F.lit('{ "t": "'), "event_type", F.lit('", "k" : '), F.get_json_object("props", "$.k"), F.lit(".0 }"))
    return e.select("event_id", canon.digest(raw).alias("digest"))


@query("SELECT conv_id, turn, left(sha256(concat_ws('|', conv_id, turn, role)), 24) AS row_id FROM conversations")
def view_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", canon.row_id(F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("role")).alias("row_id"))


@query()
def call_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed receipts of every call, from built-in digests."""
    c = calls(spark, sf_dir)
    return c.select("episode", "call_id", canon.receipt(b"\xaa" * 32, F.col("episode").cast("string"), F.col("call_id"), F.col("tool")).alias("receipt"))


@query("WITH r AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_assistant FROM conversations) SELECT conv_id, turn, 'terminal' AS view FROM r WHERE role = 'assistant' AND turn = last_assistant UNION ALL SELECT conv_id, turn, 'terminal' FROM r WHERE role = 'assistant' AND turn = last_assistant UNION ALL SELECT conv_id, turn, 'pivot' FROM r WHERE role = 'assistant' AND turn < last_assistant")
def training_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of each conversation: the last assistant turn twice, every earlier one once."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    c = c.withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    copies = F.when(F.col("turn") == F.col("last"), F.array(F.lit("terminal"), F.lit("terminal"))).otherwise(F.array(F.lit("pivot")))
    return c.select("conv_id", "turn", F.explode(copies).alias("view"))


@query("SELECT o_orderkey AS id, round(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 0.8 * (o_orderstatus = 'F')::INT + 0.2 * least(o_custkey % 9, 6) / 6.0 END, 6) AS shaped, round(greatest(-0.5, least(1.3, (o_orderstatus = 'F')::INT + 0.2 * (o_custkey % 5) / 4.0 - 0.02 * greatest(o_custkey % 9 - 3, 0) - 0.2 * (o_orderstatus = 'P')::INT)), 6) AS lexicographic, o_custkey % 6 + CASE WHEN o_orderkey % 3 <= 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 5 ELSE 8 END AS decisions, 2 * (o_custkey % 6) + 4 AS calls FROM orders")
def rewards_and_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rewards and both budgets from one projection."""
    o = table(spark, sf_dir, "orders")
    ok, bad = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "P"
    h = F.col("o_custkey") % 6
    return o.select(F.col("o_orderkey").alias("id"), r6(an.shaped_reward(ok, F.col("o_custkey") % 9, F.lit(6), bad, F.lit(True)), "shaped"), r6(an.lexicographic_reward(success=ok, milestones=(F.col("o_custkey") % 5) / 4.0, excess=F.col("o_custkey") % 9 - 3, unsafe=bad), "lexicographic"), an.decision_budget(h, F.col("o_orderkey") % 3).alias("decisions"), an.call_budget(h).alias("calls"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'unsafe' WHEN quality = 0 THEN 'wrong' WHEN n_chars > 6000 THEN 'too_long' END AS reason FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of ordered reasons to reject a row; null is accepted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").withColumn("there", F.lit(True)), "doc_id", "left")
    return d.select("doc_id", an.first_rejection([("no_label", F.col("there").isNull()), ("unsafe", F.col("toxic") == 1), ("wrong", F.col("quality") == 0), ("too_long", F.col("n_chars") > 6000)]).alias("reason"))
