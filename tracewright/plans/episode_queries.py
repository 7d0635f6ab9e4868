"""Queries of the episode, pairing and sampling operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import census
from ..operators import episodes as ep
from ..operators import sampling as sa
from ..registry import query
from .proxies import EPISODES, PAIRS, arms, episodes, table, wilson_sql

_P1, _L1, _H1 = wilson_sql("k_one", "n")
_P2, _L2, _H2 = wilson_sql("k_two", "n")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"""WITH {PAIRS}, d AS (SELECT stratum, count(*) AS n, sum(ok_one::INT)::BIGINT AS k_one, sum(ok_two::INT)::BIGINT AS k_two, sum((ok_one AND NOT ok_two)::INT)::BIGINT AS b, sum((NOT ok_one AND ok_two)::INT)::BIGINT AS c FROM pairs GROUP BY stratum)
SELECT stratum, n, k_one, k_two, b, c, round({_P1}, 6) AS rate_one, round({_L1}, 6) AS low_one, round({_H1}, 6) AS high_one, round({_P2}, 6) AS rate_two, round({_L2}, 6) AS low_two, round({_H2}, 6) AS high_two,
CASE WHEN n <= 0 THEN 'INCONCLUSIVE' WHEN {_L2} >= 0.4 THEN 'PASS' WHEN n / (n + 1.959964 * 1.959964) < 0.4 THEN 'INCONCLUSIVE' ELSE 'FAIL' END AS status FROM d""")
def paired_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms paired by task: discordant counts, both intervals and the gate of the second arm, by stratum."""
    one, two = arms(spark, sf_dir)
    d = ep.discordant(ep.paired(one, two, "task", "ok", ("stratum",)), "stratum")
    (p1, l1, h1), (p2, l2, h2) = stats.wilson(F.col("k_one"), F.col("n")), stats.wilson(F.col("k_two"), F.col("n"))
    return d.select("stratum", "n", "k_one", "k_two", "b", "c", r6(p1, "rate_one"), r6(l1, "low_one"), r6(h1, "high_one"), r6(p2, "rate_two"), r6(l2, "low_two"), r6(h2, "high_two"), stats.lower_gate(F.col("k_two"), F.col("n"), 0.4).alias("status"))


@query("WITH e AS (SELECT event_id, nullif(user_id % 40, 0) AS idx, ts FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY idx) AS n FROM e WHERE idx IS NOT NULL) SELECT event_id, idx, n - 1 AS dropped FROM r WHERE rn = 1 UNION ALL SELECT event_id, idx, 0 FROM e WHERE idx IS NULL")
def last_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.nullif(F.col("user_id") % 40, F.lit(0)).alias("idx"), "ts")
    return ep.last_wins(e, "idx", "ts", "event_id").select("event_id", "idx", "dropped")


@query(f"WITH {EPISODES} SELECT task, count(*) AS n, round(sum(reward), 2) AS total_reward, round(coalesce(stddev_samp(reward), 0), 2) AS sd_reward, max(reward) <> min(reward) AS varies, bool_or(ok) AND NOT bool_and(ok) AS disagree, sum(ok::INT)::BIGINT AS successes FROM ep GROUP BY task")
def group_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ep.group_stats(episodes(spark, sf_dir), "task", "reward", "ok")
    return g.select("task", "n", F.round(F.col("mean_reward") * F.col("n"), 2).alias("total_reward"), F.round("sd_reward", 2).alias("sd_reward"), "varies", "disagree", "successes")


@query(f"""WITH {EPISODES}, g AS (SELECT task, family, count(*) AS n, max(reward) <> min(reward) AS varies, bool_or(ok) AND NOT bool_and(ok) AS disagree, sum(ok::INT) AS successes, task % 3 AS horizon FROM ep GROUP BY task, family)
SELECT family, horizon, count(*) AS n_groups, round(avg(varies::INT), 6) AS varying, round(avg(disagree::INT), 6) AS disagreeing, round(sum(successes) / sum(n), 6) AS mean_success FROM g GROUP BY GROUPING SETS ((family, horizon), (family), ())""")
def variance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by family and horizon, by family, and over all, in one grouping-sets aggregate."""
    e = episodes(spark, sf_dir).withColumn("horizon", F.col("task") % 3)
    g = ep.group_stats(e, "task", "reward", "ok", ("family", "horizon"))
    return ep.group_report(g, "family", "horizon").select("family", "horizon", "n_groups", r6(F.col("varying"), "varying"), r6(F.col("disagreeing"), "disagreeing"), r6(F.col("mean_success"), "mean_success"))


@query("SELECT event_type AS tag, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value, count_if(value > 50) AS runaway, round(avg((value > 20)::INT), 6) AS tool_ok, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One conditional aggregate a tag: means, extremes, runaways and rates."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean_value"), F.max(v).alias("max_value"), F.count_if(v > 50).alias("runaway"), F.round(F.avg((v > 20).cast("int")), 6).alias("tool_ok"), F.round(F.sum(v), 4).alias("total"))


_AXIS = "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'recovery' WHEN o_orderpriority = '3-MEDIUM' THEN 'orchestration' ELSE 'h8' END"


def _axis_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 12).alias("candidate"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "recovery").when(F.col("o_orderpriority") == "3-MEDIUM", "orchestration").otherwise("h8").alias("axis"), (F.col("o_orderstatus") == "F").cast("int").alias("ok"))
    return census.axis_rates(o, digits=12)


_AXES = f"a AS (SELECT o_custkey % 12 AS candidate, {_AXIS} AS axis, (o_orderstatus = 'F')::INT AS ok FROM orders), r AS (SELECT candidate, avg(ok) FILTER (axis = 'recovery') AS recovery, avg(ok) FILTER (axis = 'orchestration') AS orchestration, avg(ok) FILTER (axis = 'h8') AS h8 FROM a GROUP BY candidate), c AS (SELECT *, (coalesce(recovery, 0) + coalesce(orchestration, 0) + coalesce(h8, 0)) / ((recovery IS NOT NULL)::INT + (orchestration IS NOT NULL)::INT + (h8 IS NOT NULL)::INT) AS combined FROM r)"


@query(f"WITH {_AXES} SELECT candidate, round(recovery, 6) AS recovery, round(orchestration, 6) AS orchestration, round(h8, 6) AS h8, round(combined, 6) AS combined FROM c")
def axis_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success rates of a candidate on each axis, and their mean over the axes that it has."""
    return _axis_rates(spark, sf_dir).select("candidate", *(r6(F.col(c), c) for c in ("recovery", "orchestration", "h8", "combined")))


@query(f"WITH {_AXES} SELECT candidate, round(combined, 6) AS combined FROM c ORDER BY c.combined DESC, candidate LIMIT 2")
def candidate_finalists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best candidates: a top-k report."""
    return _axis_rates(spark, sf_dir).orderBy(F.desc("combined"), "candidate").limit(2).select("candidate", r6(F.col("combined"), "combined"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def attrition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned documents without a label."""
    return ep.unassigned(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.lang AS stratum, count(*) AS expected, count(l.doc_id) AS written, count(*) - count(l.doc_id) AS missing, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY d.lang")
def unit_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected against written rows of each unit."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum"))
    return census.unit_census(d, table(spark, sf_dir, "labels"), "stratum", "doc_id").withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {EPISODES}, plan AS (SELECT c_custkey AS task, unnest(generate_series(1, 8))::INT AS sample FROM customer WHERE c_custkey % 4 < 3), seen AS (SELECT task, sample, count(*) AS n FROM ep GROUP BY task, sample) SELECT coalesce(plan.task, seen.task) AS task, coalesce(plan.sample, seen.sample) AS sample, CASE WHEN seen.task IS NULL THEN 'missing' WHEN plan.task IS NULL THEN 'extra' ELSE 'duplicate' END AS kind FROM plan FULL JOIN seen ON plan.task = seen.task AND plan.sample = seen.sample WHERE seen.task IS NULL OR plan.task IS NULL OR seen.n > 1")
def rollout_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned (task, 1..8) of three in four customers against the orders that are there."""
    tasks = table(spark, sf_dir, "customer").where("c_custkey % 4 < 3").select(F.col("c_custkey").alias("task"))
    return ep.rollout_gaps(episodes(spark, sf_dir).select("task", "sample"), tasks, "task", "sample", 8)


@query("SELECT coalesce(a.k, b.k) AS custkey, CASE WHEN b.k IS NULL THEN 'one' ELSE 'two' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def arm_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that only one arm has."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return ep.one_sided(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "custkey")


@query(f"WITH {EPISODES} SELECT a.task, array_to_string(list_filter([CASE WHEN a.family IS DISTINCT FROM b.family THEN 'family' END, CASE WHEN a.ok IS DISTINCT FROM b.ok THEN 'ok' END], lambda x: x IS NOT NULL), ',') AS fields FROM ep a JOIN ep b ON a.task = b.task AND a.sample = 1 AND b.sample = 2 WHERE a.family IS DISTINCT FROM b.family OR a.ok IS DISTINCT FROM b.ok")
def pairing_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose fields differ, null-safe, with the names of the fields."""
    e = episodes(spark, sf_dir)
    return ep.differing(e.where("sample = 1"), e.where("sample = 2"), "task", ("family", "ok")).select("task", F.array_join("fields", ",").alias("fields"))


@query(f"WITH {EPISODES}, r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY reward, sample) AS rn, count(*) OVER (PARTITION BY task) AS n FROM ep WHERE ok) SELECT task, sample, reward, n - 1 AS others FROM r WHERE rn = 1")
def best_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted sample of least cost of each task."""
    return ep.best_of(episodes(spark, sf_dir).where("ok"), "task", F.col("reward"), F.col("sample")).select("task", "sample", "reward", "others")


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN CASE WHEN coalesce(l.quality, 0) = 1 THEN 'good' ELSE NULL END ELSE d.lang END AS cluster FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def back_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty cluster names are taken from the manifest."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).when(F.col("doc_id") % 6 == 0, "").alias("cluster"))
    m = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("cluster"))
    return ep.filled(d, m, "doc_id", ("cluster",))


@query("WITH r AS (SELECT o_orderpriority AS family, o_orderstatus AS status, o_orderkey AS task, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) SELECT family, status, task FROM r WHERE rn BETWEEN 6 AND 15")
def balanced_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rows of each cell from the sixth on: a sampling operator."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("task"))
    return sa.cell_slice(o, ["family", "status"], ["task"], 10, 5)


@query("WITH r AS (SELECT o_orderpriority AS cell, o_orderkey AS task, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) SELECT cell, task, turn::INT AS turn FROM r ORDER BY r.turn, cell LIMIT 137")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """137 rows dealt over the cells in turn: a sampling operator."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_orderkey").alias("task"))
    return sa.round_robin(o, ["cell"], ["task"], 137)


@query("WITH w AS (SELECT c_mktsegment AS family, count(*) AS weight FROM customer GROUP BY 1), e AS (SELECT *, weight * 997.0 / sum(weight) OVER () AS exact FROM w), f AS (SELECT *, floor(exact) AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, family) AS rk, 997 - sum(floor(exact)) OVER () AS leftover FROM e) SELECT family, weight, (fl + (rk <= leftover)::INT)::BIGINT AS share FROM f")
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """997 units over the families by largest remainder."""
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("family")).agg(F.count("*").alias("weight"))
    return sa.apportioned(w, "weight", 997, ["family"])


@query("""WITH t AS (SELECT o_orderpriority AS stratum, o_orderkey AS task, 1 + o_orderkey % 5 AS rows FROM orders), k AS (SELECT *, sha256('view-cap-v1|' || stratum || '|' || CAST(task AS VARCHAR)) AS key FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key) AS rn FROM k), s AS (SELECT stratum, sum(rows) AS total, sum(rows) FILTER (rn = 1) AS reserved FROM o GROUP BY stratum),
p AS (SELECT stratum, sum(total) OVER () AS all_rows, 2000 - sum(reserved) OVER () AS rest, total FROM s), x AS (SELECT *, rest * CAST(total AS DOUBLE) / all_rows AS exact FROM p), y AS (SELECT *, floor(exact) + (row_number() OVER (ORDER BY exact - floor(exact) DESC, stratum) <= rest - sum(floor(exact)) OVER ())::INT AS share FROM x),
u AS (SELECT o.*, sum(CASE WHEN rn > 1 THEN rows ELSE 0 END) OVER (PARTITION BY stratum ORDER BY key ROWS UNBOUNDED PRECEDING) AS used FROM o) SELECT u.stratum, u.task, u.rows FROM u JOIN y ON y.stratum = u.stratum WHERE all_rows <= 2000 OR rn = 1 OR used <= share""")
def view_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories under a budget of 2,000 rows by the keyed stratified cap: a sampling operator."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("task"), (1 + F.col("o_orderkey") % 5).alias("rows"))
    return sa.capped(t, "stratum", "task", "rows", 2000)


@query("WITH r AS (SELECT c_nationkey AS family, c_custkey AS task, c_name AS value, sha256('derange|' || CAST(c_custkey AS VARCHAR)) AS k FROM customer) SELECT family, task, value, coalesce(lead(value) OVER (PARTITION BY family ORDER BY k), first_value(value) OVER (PARTITION BY family ORDER BY k)) AS other FROM r")
def derangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer goes to the next task of a keyed cycle."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("family"), F.col("c_custkey").alias("task"), F.col("c_name").alias("value"))
    return sa.deranged(c, sa.keyed("derange", F.col("task").cast("string")), "value", ("family",))


@query("WITH r AS (SELECT o_orderpriority AS family, o_orderkey AS task, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 48 AS shard FROM orders) SELECT family, shard::INT AS shard, min(task) AS first_task, max(task) AS last_task, count(*) AS tasks, count(*) * 8 AS expected FROM r GROUP BY family, shard")
def shard_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 48 tasks in each cell with the rollouts they will give."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("family"), F.col("o_orderkey").alias("task"))
    return sa.sharded(o, ["family"], ["task"], 48, 8)


@query("WITH r AS (SELECT o_orderpriority AS family, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT family, v AS statistic FROM r WHERE rn = least(floor(n * 0.025), n - 1) + 1")
def lower_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order statistic at floor(alpha n), counted from 0."""
    return sa.order_statistic(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "family"), "o_totalprice", 0.025, ("family",))


@query("WITH t AS (SELECT o_orderkey AS seq, o_custkey AS pid, o_orderstatus = 'P' AS err FROM orders), s AS (SELECT *, sum(err::INT) OVER (ORDER BY seq) AS spent FROM t), o AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq) AS rn FROM s WHERE NOT err OR spent <= 300) SELECT seq, pid, err FROM o WHERE rn <= 2")
def error_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two rows a problem, and error rows while 300 of them last."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("pid"), (F.col("o_orderstatus") == "P").alias("err"))
    return sa.error_budget(t, "pid", ["seq"], F.col("err"), 2, 300)
