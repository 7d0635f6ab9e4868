"""Queries of the censuses, quotas and small joins over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import census
from ..registry import query
from .proxies import CALLS, calls, table


@query("WITH g(grp) AS (VALUES ('transient_or_rate_limit'), ('malformed'), ('wrong_unit'), ('unused')), f AS (SELECT CASE l_shipmode WHEN 0 THEN 'malformed' WHEN 1 THEN 'wrong_unit' ELSE 'transient_or_rate_limit' END AS grp FROM (SELECT l_partkey % 4 AS l_shipmode FROM lineitem)) SELECT g.grp AS fault_group, count(f.grp) AS n FROM g LEFT JOIN f ON f.grp = g.grp GROUP BY g.grp")
def fault_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults by group, transient ones and rate limits pooled, groups without one included."""
    kind = F.element_at(F.array(*map(F.lit, ("malformed", "wrong_unit", "transient", "rate_limit"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return census.fault_census(table(spark, sf_dir, "lineitem").select(kind.alias("kind")), groups=("transient_or_rate_limit", "malformed", "wrong_unit", "unused"))


@query("SELECT c_mktsegment AS family, count(DISTINCT c_nationkey) AS clusters, max(n) AS largest FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2) GROUP BY 1")
def cluster_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each family and the largest one."""
    return census.cluster_census(table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "family"), "family", "c_nationkey")


@query("WITH a AS (SELECT o_orderpriority AS cell, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) AS seen FROM orders GROUP BY 1), q(cell, quota) AS (VALUES ('1-URGENT', 900), ('2-HIGH', 2000), ('3-MEDIUM', 1100), ('missing', 5)) SELECT q.cell, quota, coalesce(accepted, 0) AS accepted, coalesce(seen, 0) AS seen, greatest(quota - coalesce(accepted, 0), 0) AS short FROM q LEFT JOIN a ON a.cell = q.cell WHERE coalesce(accepted, 0) < quota")
def quota_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose accepted rows don't reach their quota; cells without a quota are only measured."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("cell"), F.when(F.col("o_orderstatus") != "F", "rejected").alias("reason"), F.lit(False).alias("faulted"))
    quotas = spark.createDataFrame([("1-URGENT", 900), ("2-HIGH", 2000), ("3-MEDIUM", 1100), ("missing", 5)], "cell string, quota long")
    return census.quota_misses(census.acceptance(o, "cell"), quotas, "cell")


@query("SELECT lang AS family, count(l.doc_id) AS assigned, count(*) FILTER (toxic = 1) AS triggered, count(*) FILTER (toxic = 1 AND quality = 1) AS recovered, round(CASE WHEN count(l.doc_id) > 0 THEN count(*) FILTER (toxic = 1 AND quality = 1) / count(l.doc_id) END, 6) AS of_assigned, round(CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN count(*) FILTER (toxic = 1 AND quality = 1) / count(*) FILTER (toxic = 1) END, 6) AS of_triggered FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang")
def recovery_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recoveries by both denominators, null where one is empty."""
    lab = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("family")).join(lab, F.col("doc_id") == F.col("labelled"), "left")
    e = d.select("family", F.col("labelled").isNotNull().alias("assigned"), (F.col("toxic") == 1).alias("triggered"), (F.col("quality") == 1).alias("recovered"))
    return census.recovery_rates(e, "family").withColumn("of_assigned", F.round("of_assigned", 6)).withColumn("of_triggered", F.round("of_triggered", 6))


@query("WITH f AS (SELECT lang, left(text, 200) AS head, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY 1, 2) SELECT lang, sum(n)::BIGINT AS finals, max(n) AS same, round(max(n) / sum(n), 6) AS share, sum(n) >= 10 AND max(n) / sum(n) > 0.5 AS collapsed FROM f GROUP BY lang")
def duplicate_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many final texts begin alike, by the first 200 characters: the operator's own definition."""
    return census.repeated_finals(table(spark, sf_dir, "documents"), "lang", "text").withColumn("share", F.round("share", 6))


@query("SELECT event_type AS stage, round(sum(coalesce(CASE WHEN event_id % 3 > 0 THEN value END, event_id % 7 * 60.0)), 4) AS seconds FROM events GROUP BY 1")
def ledger_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of a ledger; rows without them count their minutes."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.when(F.col("event_id") % 3 > 0, F.col("value")).alias("elapsed_s"), (F.col("event_id") % 7).alias("minutes"))
    return census.ledger_seconds(e, "stage").withColumn("seconds", F.round("seconds", 4))


@query("WITH r AS (SELECT source, lang, min(doc_id) AS first_seen FROM documents GROUP BY 1, 2) SELECT source, lang, row_number() OVER (ORDER BY first_seen) AS place FROM r")
def producers_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct producers in the order in which they are first seen."""
    return census.producers(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id").drop("first_seen")


@query(f"WITH {CALLS}, t AS (SELECT episode, list_distinct(list(tool)) AS used FROM calls WHERE value < 20 GROUP BY episode) SELECT episode, len(list_filter(['view','click','error'], lambda x: NOT list_contains(used, x))) AS missing, len(list_filter(['view','click','error'], lambda x: NOT list_contains(used, x))) = 0 AS covered FROM t")
def required_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required tools that an episode didn't use."""
    return census.tool_gaps(calls(spark, sf_dir).where("value < 20"), "episode", "tool", ("view", "click", "error"))


@query("WITH r AS (SELECT conv_id, turn, role, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM conversations) SELECT conv_id, turn, 'c-' || left(sha256(conv_id || '|' || ordinal), 12) AS call_id FROM r WHERE role = 'assistant'")
def wire_call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call ids from a running ordinal, the same at every run."""
    c = census.call_ids(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.concat(F.lit("c-"), F.left(F.sha2(F.concat_ws("|", F.col("conv_id").cast("string"), F.col("ordinal").cast("string")), 256), F.lit(12))).alias("call_id"))
