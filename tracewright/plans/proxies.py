"""Stand-ins for agent traces, made from the driver's relational tables.

They have the shape that an operator needs (an ordered ledger, two arms of one task set, splits with shared keys), not its
meaning; the operators' own tests use real episodes. Each has its SQL beside it, for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task, sample, ok, family, reward, episode_id: orders of a customer as samples of a task."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("task"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("sample"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_orderpriority").alias("family"), F.col("o_totalprice").alias("reward"), F.col("o_orderkey").alias("episode_id"), F.col("o_orderdate").alias("at"))


EPISODES = "ep AS (SELECT o_custkey AS task, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS sample, o_orderstatus = 'F' AS ok, o_orderpriority AS family, o_totalprice AS reward, o_orderkey AS episode_id, o_orderdate AS at FROM orders)"


def arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first and the second sample of each task; the first with its segment and cluster."""
    e = episodes(spark, sf_dir)
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task"), F.col("c_mktsegment").alias("stratum"), F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("cluster"))
    return e.where("sample = 1").join(c, "task"), e.where("sample = 2")


PAIRS = EPISODES + ", pairs AS (SELECT a.task, a.ok AS ok_one, b.ok AS ok_two, c_mktsegment AS stratum, concat_ws('/', CAST(c_nationkey AS VARCHAR), c_mktsegment) AS cluster FROM ep a JOIN ep b ON a.task = b.task AND a.sample = 1 AND b.sample = 2 JOIN customer ON c_custkey = a.task)"


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """episode, call_id, tool, digest, error, at: a user's events as an ordered ledger."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("episode"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("call_id"), F.col("event_type").alias("tool"), F.sha2(F.concat("event_type", "props"), 256).alias("digest"), (F.col("event_type") == "error").alias("error"), "value", F.col("ts").alias("at"), "event_id")


CALLS = "calls AS (SELECT user_id AS episode, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS call_id, event_type AS tool, sha256(event_type || props) AS digest, event_type = 'error' AS error, value, ts AS at, event_id FROM events)"


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, split, kind, value: documents as members of three splits, with the keys that may not cross."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("eval")), (F.col("doc_id") % 3 + 1).cast("int")).alias("split"), F.sha2("text", 256).alias("hash"), "source")
    return d.select("doc_id", "split", F.explode(F.create_map(F.lit("content"), "hash", F.lit("namespace"), F.concat_ws(":", "source", (F.col("doc_id") % 50).cast("string")))).alias("kind", "value"))


SPLITS = "sp AS (SELECT doc_id, (['train','dev','eval'])[CAST(doc_id % 3 + 1 AS INTEGER)] AS split, sha256(text) AS hash, source FROM documents), keys AS (SELECT doc_id, split, 'content' AS kind, hash AS value FROM sp UNION ALL SELECT doc_id, split, 'namespace', source || ':' || CAST(doc_id % 50 AS VARCHAR) FROM sp)"

#: The Wilson interval in SQL, from columns or expressions k and n.
def wilson_sql(k: str, n: str) -> tuple[str, str, str]:
    z = "1.959964"
    p = f"(CASE WHEN {n} > 0 THEN CAST({k} AS DOUBLE) / {n} ELSE 0.0 END)"
    scale = f"(1 + {z} * {z} / {n})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4.0 * {n} * {n})) / {scale})"
    centre = f"(({p} + {z} * {z} / (2.0 * {n})) / {scale})"
    low = f"(CASE WHEN {n} <= 0 THEN 0.0 WHEN {k} <= 0 THEN 0.0 ELSE least({p}, greatest(0.0, {centre} - {half})) END)"
    high = f"(CASE WHEN {n} <= 0 THEN 1.0 WHEN {k} >= {n} THEN 1.0 ELSE greatest({p}, least(1.0, {centre} + {half})) END)"
    return p, low, high


#: Stand-in values of agent episodes, by numbers of an order and its customer.
_FAMILIES, _SPLITS, _FAULTS = ("lookup_chain", "typed_relay", "fulfillment"), ("main", "mt", "h8"), ("transient", "rate_limit", "malformed", "wrong_unit")


def agent_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The episode table of the gates: a customer's orders in turn as both arms of a clean and a faulted task."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    o = o.withColumn("i", F.row_number().over(Window.partitionBy("c").orderBy("k")) - 1)
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    k, c, trained = F.col("k"), F.col("c"), F.col("i") % 2
    return o.select(
        pick(("BP", "TP"), trained).alias("arm"), F.when(F.col("i") % 4 < 2, "clean").otherwise("faulted").alias("condition"), F.lit("none").alias("control"), (c * 1000 + div(F.col("i"), 4)).alias("task_id"),
        pick(_FAMILIES, c % 3).alias("family"), F.when(div(c, 3) % 2 == 0, 4).otherwise(8).alias("horizon"), pick(_SPLITS, div(c, 6) % 3).alias("split"), (c % 40).cast("string").alias("cluster"), (c % 6).alias("pattern_id"), (c % 2 == 0).alias("all_tools"),
        F.when(F.col("i") % 4 >= 2, pick(_FAULTS, c % 4)).alias("fault_class"), (k * 7 % 10 < 7 + trained).alias("certified"), ((F.col("i") % 4 >= 2) & (k * 3 % 10 < 5 + trained)).alias("recovered"), (k * 11 % 10 < 6 + trained).alias("orchestrated"),
        (k % 97 == 0).alias("runaway"), (k % 211 == 0).alias("hallucinated"), (k % 5 + 3).alias("n_calls"), F.when(k % 53 == 0, "wall_clock").otherwise("answered").alias("termination"), (k % 301 != 0).alias("receipts_ok"), (k % 4).alias("budgets"), k.alias("k"),
    )


AGENTS = """ag AS (SELECT (['BP','TP'])[(i % 2 + 1)::INT] AS arm, CASE WHEN i % 4 < 2 THEN 'clean' ELSE 'faulted' END AS condition, 'none' AS control, c * 1000 + i // 4 AS task_id, (['lookup_chain','typed_relay','fulfillment'])[(c % 3 + 1)::INT] AS family, CASE WHEN c // 3 % 2 = 0 THEN 4 ELSE 8 END AS horizon, (['main','mt','h8'])[(c // 6 % 3 + 1)::INT] AS split, CAST(c % 40 AS VARCHAR) AS cluster, c % 6 AS pattern_id, c % 2 = 0 AS all_tools,
CASE WHEN i % 4 >= 2 THEN (['transient','rate_limit','malformed','wrong_unit'])[(c % 4 + 1)::INT] END AS fault_class, k * 7 % 10 < 7 + i % 2 AS certified, i % 4 >= 2 AND k * 3 % 10 < 5 + i % 2 AS recovered, k * 11 % 10 < 6 + i % 2 AS orchestrated, k % 97 = 0 AS runaway, k % 211 = 0 AS hallucinated, k % 5 + 3 AS n_calls, CASE WHEN k % 53 = 0 THEN 'wall_clock' ELSE 'answered' END AS termination, k % 301 <> 0 AS receipts_ok, k % 4 AS budgets, k
FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_custkey AS BIGINT) AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)),
pr AS (SELECT a.condition, a.task_id, a.family, a.horizon, a.split, a.cluster, a.pattern_id, a.all_tools, a.fault_class, b.n_calls, a.certified::INT AS certified_one, b.certified::INT AS certified_two, a.recovered::INT AS recovered_one, b.recovered::INT AS recovered_two, a.orchestrated::INT AS orchestrated_one, b.orchestrated::INT AS orchestrated_two, b.runaway::INT AS runaway_two, b.hallucinated::INT AS hallucinated_two FROM ag a JOIN ag b ON a.task_id = b.task_id AND a.condition = b.condition AND a.arm = 'BP' AND b.arm = 'TP')"""


def upper_sql(k: str, n: str, bound: float) -> str:
    _, _, high = wilson_sql(k, n)
    return f"CASE WHEN {n} <= 0 THEN 'INCONCLUSIVE' WHEN {high} <= {bound} THEN 'PASS' WHEN 1.959964 * 1.959964 / ({n} + 1.959964 * 1.959964) > {bound} THEN 'INCONCLUSIVE' ELSE 'FAIL' END"


def lower_sql(k: str, n: str, bound: float) -> str:
    _, low, _ = wilson_sql(k, n)
    return f"CASE WHEN {n} <= 0 THEN 'INCONCLUSIVE' WHEN {low} >= {bound} THEN 'PASS' WHEN {n} / ({n} + 1.959964 * 1.959964) < {bound} THEN 'INCONCLUSIVE' ELSE 'FAIL' END"
