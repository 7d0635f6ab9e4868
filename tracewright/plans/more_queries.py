"""Queries of units, draws, replay, views, validators and streams over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws, numbers
from ..operators import audits, census, episodes, faults, leakage, replay, sampling, tasks, views
from ..operators.shared import new_path
from ..registry import query
from ..streaming import journals
from .proxies import SPLITS, calls, splits, table


def r6(c, name: str):
    return F.round(c, 6).alias(name)


_UNITS = ", ".join(f"('{u}', '{k}', {s!r})" for u, k, s in numbers.UNITS)


@query(f"WITH u(unit, kind, size) AS (VALUES {_UNITS}), q AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_quantity AS value, (['mm','KM','ft','kg','oz','hour','parsec'])[l_partkey % 7 + 1] AS src, (['m','inch','mile','lb','g','day','s'])[l_suppkey % 7 + 1] AS dst FROM lineitem) SELECT id, line, part, value, CASE WHEN a.unit IS NULL OR b.unit IS NULL THEN 'unknown unit' WHEN a.kind <> b.kind THEN 'different kinds' END AS problem, round(CASE WHEN a.kind = b.kind THEN value * a.size / b.size END, 6) AS converted FROM q LEFT JOIN u a ON a.unit = lower(src) LEFT JOIN u b ON b.unit = lower(dst)")
def unit_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities in other units; unknown units and other kinds are named."""
    pick = lambda names, c: F.element_at(F.array(*map(F.lit, names)), (F.col(c) % 7 + 1).cast("int"))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("value"), pick(["mm", "KM", "ft", "kg", "oz", "hour", "parsec"], "l_partkey").alias("src"), pick(["m", "inch", "mile", "lb", "g", "day", "s"], "l_suppkey").alias("dst"))
    return numbers.converted(q, "value", "src", "dst").select("id", "line", "part", "value", "problem", r6(F.col("converted"), "converted"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 10 = 0 THEN 'error: division by zero' ELSE CAST((p_partkey + 3) * p_size - 7 AS VARCHAR) END AS result FROM part")
def calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic expressions made from a table, evaluated safely."""
    p = table(spark, sf_dir, "part")
    text = F.when(F.col("p_size") % 10 == 0, "1 / (2 - 2)").otherwise(F.format_string("(%d + 3) * %d - 7", F.col("p_partkey").cast("long"), F.col("p_size").cast("long")))
    return p.select(F.col("p_partkey").alias("id"), numbers.calculated(text).alias("result"))


@query()
def stream_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six choices of 0..39 in the stream of each label."""
    return table(spark, sf_dir, "nation").select("n_name", draws.choices(2786983947, 6, 40)(F.concat(F.lit("ER2:"), "n_name")).alias("drawn"))


@query("WITH r AS (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 16 AS block FROM orders), k AS (SELECT o_orderkey AS id, block, CASE WHEN (block % 2 = 0) = (o_orderstatus = 'F') THEN 0 ELSE 1 END AS arm_rank, o_orderpriority AS family FROM r) SELECT id, family, block, row_number() OVER (PARTITION BY family, block ORDER BY arm_rank, id) AS place FROM k")
def interleaved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired blocks of sixteen in which the arm that goes first alternates."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("family"), "o_orderstatus")
    return census.interleaved(o, "family", "id", F.col("o_orderstatus") == "F", 16).drop("o_orderstatus")


@query()
def episode_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's calls against a plan of four tools with a rate limit on the second and a transient fault on the third."""
    c = calls(spark, sf_dir).select("episode", "call_id", (F.col("call_id") * 1).cast("long").alias("decision_id"), F.col("tool").alias("identity"))
    fault = lambda node, kind, turns: F.struct(F.lit(node).alias("node"), F.lit(kind).alias("kind"), F.lit(turns).alias("turns"))
    specs = c.select("episode").distinct().select("episode", F.array(*map(F.lit, ("view", "click", "purchase", "signup"))).alias("plan"), F.array(fault(1, "rate_limit", 3), fault(2, "transient", 0)).alias("faults"))
    return replay.replayed(c.select(F.col("episode").cast("string").alias("episode"), F.col("call_id").cast("long").alias("call_id"), "decision_id", "identity"), specs.withColumn("episode", F.col("episode").cast("string")))


@query("WITH m AS (SELECT conv_id, turn, role, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS n, count(*) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS before, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn, CASE WHEN turn = last THEN 'terminal' ELSE 'pivot' END AS view, n::BIGINT AS n_tokens, n <= 3000 AS kept FROM m, (VALUES (1), (2)) c(copy) WHERE role = 'assistant' AND (copy = 1 OR turn = last)")
def built_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with prompt and completion under a length budget, by characters."""
    m = table(spark, sf_dir, "conversations")
    v = views.built(m, views.selected(m, "conv_id", "turn", "role"), "conv_id", "turn", "role", "text", 3000, F.char_length("text"))
    return v.select("conv_id", "turn", "view", "n_tokens", "kept")


@query("WITH v AS (SELECT c.conv_id % 4 AS stratum, sum(length(text)) AS n FROM conversations c GROUP BY c.conv_id) SELECT stratum, count(*) AS planned, count_if(n <= 3000) AS kept, count_if(n > 3000) AS dropped, max(n)::BIGINT AS longest FROM v GROUP BY stratum")
def stratum_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows planned, kept and dropped by stratum, with the longest."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n_tokens"))
    v = c.select((F.col("conv_id") % 4).alias("stratum"), "n_tokens", (F.col("n_tokens") <= 3000).alias("kept"), F.col("conv_id").cast("string").alias("row_id"))
    return views.stratum_report(v, "stratum").drop("longest_row")


@query("SELECT o_orderpriority AS stratum, 3000 AS expected, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <> 3000")
def cardinality_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata that don't have the expected number of rows."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stratum")).agg(F.count("*").alias("n"))
    return views.cardinality_gaps(n, n.select("stratum", F.lit(3000).alias("expected")), "stratum")


@query("SELECT lang, source, count(*) AS rows FROM documents GROUP BY lang, source")
def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct producers of the corpus."""
    return views.mixed_producers(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("WITH w AS (SELECT o_custkey % 50 AS task, o_orderpriority AS family, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY n DESC, task) AS rn FROM w) SELECT family, task AS argmax_task, n AS longest FROM r WHERE rn = 1")
def size_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest task of each stratum; of equals the first."""
    w = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("task"), F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("n"))
    return w.groupBy("family").agg(F.max_by("task", F.struct("n", -F.col("task"))).alias("argmax_task"), F.max("n").alias("longest"))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind by five minutes, run as a stream over the table's file to its end."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    return journals.run_to_end(journals.rates(stream, "event_type", "ts"), new_path(spark, "rates"), ("start", "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH e AS (SELECT user_id AS journal_id, ts, ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 40 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS opens, event_id FROM events), s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY journal_id ORDER BY ts, event_id) AS s FROM e) SELECT journal_id, count(*) AS beats, min(ts) AS opened_at, max(ts) AS last_at FROM s GROUP BY journal_id, s")
def journal_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a journal's signs of life, as a batch."""
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "journal_id")
    return journals.sessions(e, "journal_id", "ts", "40 minutes")


@query("SELECT n_name, sha256('heldout-split' || chr(1) || n_name) AS seed FROM nation")
def derived_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds derived from a label and a name by built-in digests."""
    return table(spark, sf_dir, "nation").select("n_name", F.sha2(F.concat(F.lit("heldout-split"), F.lit("\x01"), "n_name"), 256).alias("seed"))


_TASKS = "t AS (SELECT c_custkey AS task, (['distill','dev','eval','eval_stress','eval_mt'])[(c_custkey % 5 + 1)::INT] AS split, (['lookup_chain','typed_relay','fulfillment'])[(c_custkey // 5 % 3 + 1)::INT] AS family, CASE WHEN c_custkey // 15 % 2 = 0 THEN 4 ELSE 8 END AS horizon FROM customer)"


def planned_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks of five splits, three families and two horizons, with ``converts``."""
    c = F.col("c_custkey")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    div = lambda n: F.call_function("div", c, F.lit(n))
    t = table(spark, sf_dir, "customer").select(c.alias("task"), pick(("distill", "dev", "eval", "eval_stress", "eval_mt"), c % 5).alias("split"), pick(("lookup_chain", "typed_relay", "fulfillment"), div(5) % 3).alias("family"), F.when(div(15) % 2 == 0, 4).otherwise(8).alias("horizon"))
    return t.withColumn("converts", (F.col("family") == "typed_relay") | ((F.col("family") == "fulfillment") & (F.col("horizon") > 4)))


@query(f"""WITH {_TASKS}, r AS (SELECT *, row_number() OVER (PARTITION BY split, family, horizon ORDER BY task) - 1 AS i, count(*) OVER (PARTITION BY split, family, horizon) AS n FROM t),
w AS (SELECT DISTINCT split, family, horizon, n, CASE split WHEN 'eval_mt' THEN 0 WHEN 'distill' THEN n - n // 2 ELSE n END AS m, CASE WHEN split = 'eval' THEN CASE WHEN family = 'typed_relay' THEN [8,15,70,7] WHEN family = 'lookup_chain' OR horizon = 4 THEN [25,50,0,25] ELSE [15,30,40,15] END WHEN family = 'typed_relay' OR (family = 'fulfillment' AND horizon = 8) THEN [1,1,1,1] ELSE [34,33,0,33] END AS ws FROM r),
k AS (SELECT * EXCLUDE ws, unnest(['transient','malformed','wrong_unit','rate_limit']) AS kind, unnest([1,2,3,4]) AS p, unnest(ws) AS weight FROM w),
u AS (SELECT split, family, horizon, m, [kind] AS unit, p * 10 AS s, weight FROM k WHERE weight > 0 AND split <> 'eval_stress' UNION ALL SELECT a.split, a.family, a.horizon, a.m, [a.kind, b.kind], a.p * 10 + b.p, 1 FROM k a JOIN k b ON a.split = b.split AND a.family = b.family AND a.horizon = b.horizon AND a.p < b.p WHERE a.split = 'eval_stress' AND a.weight > 0 AND b.weight > 0),
e AS (SELECT *, CAST(m AS DOUBLE) * weight / sum(weight) OVER (PARTITION BY split, family, horizon) AS x FROM u),
f AS (SELECT *, floor(x) + (row_number() OVER (PARTITION BY split, family, horizon ORDER BY x - floor(x) DESC, s) <= m - sum(floor(x)) OVER (PARTITION BY split, family, horizon))::INT AS c FROM e),
b AS (SELECT *, sum(c) OVER o - c AS first, sum(CASE WHEN list_contains(unit, 'malformed') THEN c ELSE 0 END) OVER o - CASE WHEN list_contains(unit, 'malformed') THEN c ELSE 0 END AS bad FROM f WINDOW o AS (PARTITION BY split, family, horizon ORDER BY s))
SELECT r.task, r.split, r.family, r.horizon, coalesce(array_to_string(list_transform(b.unit, lambda q: q || CASE WHEN q = 'malformed' AND r.family = 'fulfillment' AND (r.i - (r.n - b.m) - b.first + b.bad) % 4 = 0 THEN '*' ELSE '' END), '+'), '') AS faults FROM r LEFT JOIN b ON b.split = r.split AND b.family = r.family AND b.horizon = r.horizon AND r.i - (r.n - b.m) >= b.first AND r.i - (r.n - b.m) < b.first + b.c""")
def fault_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which faults each task of a cell carries, in proportion to the cell's weights; ambiguous ones have a star."""
    plan = faults.planned(planned_tasks(spark, sf_dir), ["task"])
    return plan.select("task", "split", "family", "horizon", F.array_join(F.transform("faults", lambda f: F.concat(f["kind"], F.when(f["ambiguous"], "*").otherwise(""))), "+").alias("faults"))


@query()
def fault_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On which of six nodes each planned fault is, and the unit that a wrong-unit fault shows."""
    node = lambda name, tool, mutating, action, unit: F.struct(F.lit(name).alias("node"), F.lit(tool).alias("tool"), F.lit(mutating).alias("mutating"), F.lit(action).cast("string").alias("action"), F.lit(unit).cast("string").alias("unit"))
    nodes = F.array(node("n0", "kb_lookup", False, None, None), node("n1", "unit_convert", False, None, "kg"), node("n2", "calculator", False, None, None), node("n3", "warehouse_query", False, None, None), node("n4", "warehouse_update", True, "reserve", None), node("n5", "warehouse_update", True, "finalize", None))
    plan = faults.planned(planned_tasks(spark, sf_dir), ["task"]).select("task", "faults", nodes.alias("nodes"), draws.derived("fault-plan", F.encode(F.col("task").cast("string"), "UTF-8")).alias("seed"))
    return faults.targeted(plan).select("task", F.posexplode("targets").alias("place", "target")).select("task", "place", "target.*")


@query(f"WITH {SPLITS}, h AS (SELECT DISTINCT kind, value, split FROM keys), v AS (SELECT a.kind, a.split AS sa, b.split AS sb FROM h a JOIN h b ON a.kind = b.kind AND a.value = b.value AND a.split < b.split GROUP BY ALL) SELECT 'S10' AS veto, CASE WHEN (SELECT count(*) FROM keys) = 0 THEN 'INCONCLUSIVE' WHEN (SELECT count(*) FROM v) > 0 THEN 'BUG' ELSE 'OK' END AS status, (SELECT count(*) FROM keys) AS n_checked, (SELECT count(*) FROM v) AS n_bad")
def leakage_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The veto of split leakage: BUG when two splits share a key."""
    keys = splits(spark, sf_dir)
    return audits.veto(leakage.crossings(keys, "kind", "value", "split"), keys, "S10")


@query("SELECT 'S15' AS veto, CASE WHEN count(*) = 0 THEN 'INCONCLUSIVE' WHEN count(*) FILTER (l.doc_id IS NULL) > 0 THEN 'BUG' ELSE 'OK' END AS status, count(*) AS n_checked, count(*) FILTER (l.doc_id IS NULL) AS n_bad FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def attrition_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The veto of attrition: BUG when an assigned task has no trace."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return audits.veto(episodes.unassigned(docs, table(spark, sf_dir, "labels"), "doc_id"), docs, "S15")


@query()
def generated_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of lookups for each customer, followed from its first key to its answer."""
    labels = table(spark, sf_dir, "customer").select(F.col("c_name").alias("task_id"), (F.col("c_custkey") % 13 + 2).alias("horizon"))
    return tasks.walked(tasks.lookup_chains(labels, b"stand-in"))


@query("WITH RECURSIVE l AS (SELECT l_orderkey AS episode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS call_id, l_partkey % 5 AS gives, l_suppkey % 5 AS takes FROM lineitem), e AS (SELECT DISTINCT b.episode, b.call_id AS node, a.call_id AS next FROM l a JOIN l b ON a.episode = b.episode AND a.call_id < b.call_id AND a.gives = b.takes), r AS (SELECT episode, max(call_id) AS node FROM l GROUP BY 1 UNION SELECT r.episode, e.next FROM r JOIN e ON e.episode = r.episode AND e.node = r.node) SELECT episode, count(*) AS contributing FROM r GROUP BY 1")
def causal_dataflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on the dataflow into each order's last line: a line feeds a later one that shares its part's residue or supplier."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("episode"), place.alias("call_id"), F.array((F.col("l_partkey") % 5).cast("string")).alias("gives"), F.array((F.col("l_suppkey") % 5).cast("string")).alias("takes"))
    edges = audits.feeds(li, "episode", "call_id", "gives", "takes")
    last = li.groupBy("episode").agg(F.max("call_id").alias("call_id"))
    return audits.contributing(edges, last).groupBy("episode").agg(F.count("*").alias("contributing"))
