"""Violation rows of suites, shards, corpora, views and traces; none means complete."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import accumulated, numbered
from .shared import settle


def _gaps(df: DataFrame, key: str, tests: list[tuple[str, Column]]) -> DataFrame:
    """(key, gap): every test that a row fails, by name."""
    named = F.filter(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests)), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(named).alias("gap"))


def _blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""


def suite_sizes(specs: DataFrame, expected: DataFrame, by: tuple[str, ...] = ("split", "family", "horizon")) -> DataFrame:
    """(key, gap): cells of a suite with another number of tasks than registered, and cells that nobody registered.

    expected: by, n.
    """
    got = specs.groupBy(*by).agg(F.count("*").alias("_got"))
    both = expected.join(got, list(by), "full_outer").withColumn("cell", F.concat_ws("/", *(F.col(c).cast("string") for c in by)))
    return _gaps(both, "cell", [("not registered", F.col("n").isNull()), ("another size", F.col("n").isNotNull() & (F.coalesce("_got", F.lit(0)) != F.col("n")))])


def suite_checks(specs: DataFrame) -> DataFrame:
    """(key, gap): tasks that fail a content check.

    specs: task_id, horizon, nodes array<struct<node, tool, depends array<string>>>, cluster, recomputed_cluster, digest,
    regenerated_digest, oracle_ok, missing_node_rejected, same_decision_rejected, miss_leaks, prompt, answer, answer_kind. A
    boolean that is null wasn't checked, which is a gap too.
    """
    ids = F.transform("nodes", lambda n: n["node"])
    unknown = F.exists("nodes", lambda n: F.size(F.array_except(F.coalesce(n["depends"], F.array().cast("array<string>")), ids)) > 0)
    return _gaps(
        specs,
        "task_id",
        [
            ("regeneration differs", ~F.col("digest").eqNullSafe(F.col("regenerated_digest"))),
            ("horizon differs", F.size("nodes") != F.col("horizon")),
            ("node ids repeat", F.size(F.array_distinct(ids)) != F.size(ids)),
            ("depends on an unknown node", unknown),
            ("cluster differs", ~F.col("cluster").eqNullSafe(F.col("recomputed_cluster"))),
            ("oracle fails", ~F.coalesce("oracle_ok", F.lit(False))),
            ("a missing node is accepted", ~F.coalesce("missing_node_rejected", F.lit(False))),
            ("one decision for two hops is accepted", ~F.coalesce("same_decision_rejected", F.lit(False))),
            ("a missed lookup leaks", F.coalesce("miss_leaks", F.lit(True))),
            ("the prompt has the answer", (F.col("answer_kind") == "token") & F.contains(F.lower("prompt"), F.lower("answer"))),
            ("no answer", _blank("answer")),
        ],
    )


def permutation_gaps(specs: DataFrame, permuted: DataFrame) -> DataFrame:
    """(key, gap): tasks whose hidden values weren't permuted within their family: values may change places, none may come or go.

    Both: task_id, family, value.
    """
    one = specs.groupBy("family", "value").agg(F.count("*").alias("a"))
    two = permuted.groupBy("family", "value").agg(F.count("*").alias("b"))
    both = one.join(two, ["family", "value"], "full_outer").withColumn("cell", F.concat_ws("/", "family", "value"))
    lost = specs.select("task_id").join(permuted.select("task_id"), "task_id", "left_anti")
    return _gaps(both, "cell", [("values differ", ~F.col("a").eqNullSafe(F.col("b")))]).unionByName(lost.select(F.col("task_id").cast("string").alias("key"), F.lit("no permuted task").alias("gap")))


def template_isolation(specs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, gap): wordings out of their split's range, ids used twice, and token answers that two splits share.

    specs: task_id, split, template_id, answer, answer_kind. ranges: split, low, high. Integers may be shared.
    """
    out = specs.join(ranges, "split", "left")
    wording = _gaps(out, "task_id", [("wording out of range", F.col("low").isNull() | ~F.col("template_id").between(F.col("low"), F.col("high")))])
    twice = specs.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("task_id").cast("string").alias("key"), F.lit("id used twice").alias("gap"))
    shared = specs.where("answer_kind = 'token'").groupBy("answer").agg(F.count_distinct("split").alias("n")).where("n > 1").select(F.col("answer").alias("key"), F.lit("answer in two splits").alias("gap"))
    return wording.unionByName(twice).unionByName(shared)


def shard_gaps(shards: DataFrame, rows: DataFrame, receipts: DataFrame) -> DataFrame:
    """(key, gap): shards that don't have exactly the rollouts they owe, or whose receipt doesn't fit.

    shards: shard, rollouts array<string>. rows: shard, rollout. receipts: shard, rows, digest, rows_digest (of the file as it
    is), sealed.
    """
    owed = shards.select("shard", F.explode("rollouts").alias("rollout"), F.lit(True).alias("planned"))
    # a row without a name is nobody's: what is owed and what is there don't meet in it
    nameless = F.when(F.col("shard").isNull() | F.col("rollout").isNull(), F.col("planned"))
    dealt = owed.union(rows.select("shard", "rollout", F.lit(False))).withColumn("side", nameless).repartition("shard")
    each = dealt.groupBy("shard", "rollout", "side").agg(F.bool_or("planned").alias("planned"), F.count_if(~F.col("planned")).alias("seen"))
    both = each.groupBy("shard").agg(F.count_if(F.col("seen") == 0).alias("missing"), F.count_if(~F.col("planned")).alias("extra"), F.count_if(F.col("seen") > 1).alias("twice"), F.sum("seen").alias("n"))
    x = both.join(receipts.withColumnRenamed("rows", "receipt_rows").withColumn("_r", F.lit(True)), "shard", "left")
    return _gaps(x, "shard", [("rollouts missing", F.col("missing") > 0), ("rollouts that aren't owed", F.col("extra") > 0), ("rollouts twice", F.col("twice") > 0), ("no receipt", F.col("_r").isNull()), ("another number of rows", F.col("receipt_rows") != F.col("n")), ("bytes differ", F.col("digest") != F.col("rows_digest")), ("seal doesn't hold", ~F.col("sealed"))])


def corpus_gaps(rows: DataFrame, receipt: DataFrame, shards: DataFrame) -> DataFrame:
    """(key, gap): an accepted corpus that isn't what its receipt says: rows, ids used twice, shards that changed.

    rows: row_id, source_shard. receipt: corpus, rows, shards map<string,string>. shards: shard, digest as they are now.
    """
    n = rows.agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("row_id")).alias("twice")).withColumn("_one", F.lit(1))
    x = receipt.withColumn("_one", F.lit(1)).join(n, "_one", "left")
    own = _gaps(x, "corpus", [("another number of rows", F.col("rows") != F.col("n")), ("row ids twice", F.col("twice") > 0)])
    named = receipt.select(F.explode("shards").alias("shard", "was")).join(shards, "shard", "left")
    return own.unionByName(_gaps(named, "shard", [("shard is gone", F.col("digest").isNull()), ("shard changed", F.col("digest") != F.col("was"))]))


def view_gaps(views: DataFrame, metadata: DataFrame, low: int, high: int, terminal_least: float) -> DataFrame:
    """(key, gap): views without metadata or of another source, a corpus outside of its registered range, too few terminal rows.

    views: row_id, view, source. metadata: row_id, source.
    """
    m = metadata.select("row_id", F.col("source").alias("_source"), F.lit(True).alias("_m"))
    chain = _gaps(views.join(m, "row_id", "left"), "row_id", [("no metadata", F.col("_m").isNull()), ("another source", F.col("_m") & ~F.col("source").eqNullSafe(F.col("_source")))])
    total = views.agg(F.count("*").alias("n"), F.count_if(F.col("view") == "terminal").alias("t")).withColumn("all", F.lit("corpus"))
    return chain.unionByName(_gaps(total, "all", [("too few rows", F.col("n") < low), ("too many rows", F.col("n") > high), ("too few terminal rows", F.try_divide("t", "n") < terminal_least)]))


def census_gaps(census: DataFrame) -> DataFrame:
    """(key, gap): mandatory units that aren't whole; ``census`` as ``census.unit_census`` with a column unit."""
    return _gaps(census, "unit", [("rows missing", F.col("missing") > 0)])


def trace_gaps(rows: DataFrame, contract: str, required: tuple[str, ...]) -> DataFrame:
    """(key, gap): trace files with rows of another contract, without hardware, or of more than one fingerprint.

    rows: file, contract, fingerprint and the required columns.
    """
    lacks = F.exists(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in required)), lambda x: x == "")
    per = rows.groupBy("file").agg(F.count_if(~F.col("contract").eqNullSafe(F.lit(contract))).alias("stale"), F.count_if(lacks).alias("bare"), F.count_distinct("fingerprint").alias("prints"))
    return _gaps(per, "file", [("stale rows", F.col("stale") > 0), ("rows without hardware", F.col("bare") > 0), ("more than one fingerprint", F.col("prints") > 1)])


def resolved_receipts(artifacts: DataFrame) -> DataFrame:
    """(artifact, receipt, origin): the receipt beside an artifact, else its own, else one embedded in it; only one that names
    the artifact's own digest counts.

    artifacts: artifact, digest, and sidecar, own, embedded: struct<digest, receipt>.
    """
    fits = lambda name: F.when(F.col(f"{name}.digest") == F.col("digest"), F.struct(F.col(f"{name}.receipt").alias("receipt"), F.lit(name).alias("origin")))
    best = F.coalesce(*map(fits, ("sidecar", "own", "embedded")))
    return artifacts.select("artifact", best["receipt"].alias("receipt"), best["origin"].alias("origin"))


def fingerprint_conflicts(rows: DataFrame, by: str, identity: tuple[str, ...]) -> DataFrame:
    """(by, identities): groups whose rows don't share one identity, null-safe; session and clock aren't part of it."""
    return rows.groupBy(by).agg(F.count_distinct(F.to_json(F.struct(*identity))).alias("identities")).where("identities > 1")


def frozen_gaps(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(key, gap): files that were added, removed or changed since they were frozen. Both: path, sha256."""
    both = frozen.join(now.withColumnRenamed("sha256", "sha256_now"), "path", "full_outer")
    return _gaps(both, "path", [("added", F.col("sha256").isNull()), ("removed", F.col("sha256_now").isNull()), ("changed", F.col("sha256") != F.col("sha256_now"))])


def stale_paths(paths: DataFrame, release: str) -> DataFrame:
    """Files of held-out releases other than the one in force: path, release."""
    return paths.where(F.col("release").isNotNull() & (F.col("release") != release))


def reveal_problems(reveals: DataFrame, label: str, schema: str) -> DataFrame:
    """(key, gap): reveals of another form, without a full commit, or whose seed or release doesn't follow from the commit.

    reveals: id, schema, locks_commit, master_seed, release_id. The seed is the digest of the label and the commit, the release
    the first 16 digits of the digest of the seed.
    """
    seed = F.sha2(F.concat(F.lit(label), F.lit("|"), "locks_commit"), 256)
    return _gaps(reveals, "id", [("another schema", ~F.col("schema").eqNullSafe(F.lit(schema))), ("no full commit", ~F.coalesce(F.col("locks_commit").rlike("^[0-9a-f]{40}$"), F.lit(False))), ("seed doesn't follow", ~F.col("master_seed").eqNullSafe(seed)), ("release doesn't follow", ~F.col("release_id").eqNullSafe(F.left(F.sha2("master_seed", 256), F.lit(16))))])


def joined_rewards(components: DataFrame, key: str, wanted: tuple[str, ...]) -> DataFrame:
    """One row a rollout that has all of its reward components, with the last of each; the others wait.

    components: key, name, value, seq. Over a stream the same rows come out of an aggregate with a watermark.
    """
    last = components.where(F.col("name").isin(*wanted)).groupBy(key, "name").agg(F.max_by("value", "seq").alias("value"))
    rows = last.groupBy(key).pivot("name", list(wanted)).agg(F.first("value"))
    return rows.where(reduce(lambda a, b: a & b, (F.col(n).isNotNull() for n in wanted)))


def variants(specs: DataFrame, faults: tuple[str, ...]) -> DataFrame:
    """Each task clean and with each fault, as ``variant``: the work of a census."""
    return specs.withColumn("variant", F.explode(F.array(F.lit("clean"), *map(F.lit, faults))))


def open_sessions(journal: DataFrame, ledger: DataFrame) -> DataFrame:
    """(session, opened_at, last_at, charge_s): sessions that were opened and never closed, with what the ledger still owes:
    the time until the last sign of life, less what is charged.

    journal: session, at, event (open, beat, close). ledger: session, elapsed_s.
    """
    per = journal.groupBy("session").agg(F.min(F.when(F.col("event") == "open", F.col("at"))).alias("opened_at"), F.max("at").alias("last_at"), F.bool_or(F.col("event") == "close").alias("closed")).where("not closed and opened_at is not null")
    charged = ledger.groupBy("session").agg(F.sum("elapsed_s").alias("charged"))
    passed = F.col("last_at").cast("double") - F.col("opened_at").cast("double")
    return per.join(charged, "session", "left").select("session", "opened_at", "last_at", F.greatest(passed - F.coalesce("charged", F.lit(0.0)), F.lit(0.0)).alias("charge_s"))


def batches(files: DataFrame, order: str, most: int, most_bytes: int) -> DataFrame:
    """``files`` with ``batch``: consecutive files of up to ``most`` files and ``most_bytes`` bytes each, in their order.

    A batch ends before the file that would pass a bound; a file that is larger than the bound is a batch of its own. Each file
    knows the first file of the batch after its own, if it began one; which files do begin one follows from the first by
    doubling these jumps, in as many rounds as the number of batches has bits. Any number of files; paths are unique.
    """
    placed = accumulated(numbered(files, [order, "path"], "_i"), [order, "path"], "_end", F.col("size").cast("long"))
    placed = settle(placed.withColumn("_start", F.col("_end") - F.col("size")), "files")
    # the last file that ends within a batch begun here: ends and limits meet in the same stretch of most_bytes, or one before
    stretch = lambda c: F.floor(F.col(c) / F.lit(max(most_bytes, 1))).cast("long")
    ends = placed.select(F.col("_end").alias("_at"), F.lit(0).alias("_kind"), "_i", F.col("_i").alias("_last"))
    limits = placed.select((F.col("_start") + most_bytes).alias("_at"), F.lit(1).alias("_kind"), "_i", F.lit(None).cast("long").alias("_last"))
    both = ends.union(limits).withColumn("_stretch", stretch("_at"))
    upto = Window.partitionBy("_stretch").orderBy("_at", "_kind", "_i").rowsBetween(Window.unboundedPreceding, 0)
    fits = both.withColumn("_last", F.max("_last").over(upto)).where("_kind = 1")
    before = ends.groupBy((stretch("_at") + 1).alias("_stretch")).agg(F.max("_last").alias("_whole"))
    jumps = fits.join(before, "_stretch", "left").select("_i", F.least(F.col("_i") + most, F.greatest(F.coalesce("_last", "_whole", F.lit(0)), F.col("_i")) + 1).alias("_next"))
    jumps, begun, n, last = settle(jumps, "jumps"), settle(placed.where("_i = 1").select("_i"), "begun"), 0, 1
    while n < last:
        n, begun = last, settle(begun.union(begun.join(jumps, "_i").select(F.col("_next").alias("_i"))).distinct().join(placed.select("_i"), "_i", "left_semi"), "begun")
        ahead = jumps.select(F.col("_i").alias("_next"), F.col("_next").alias("_far"))
        jumps, last = settle(jumps.join(ahead, "_next").select("_i", F.col("_far").alias("_next")), "jumps"), begun.count()
    marked = placed.join(begun.withColumn("_begins", F.lit(1).cast("long")), "_i", "left")
    return accumulated(marked, ["_i"], "batch", F.coalesce("_begins", F.lit(0).cast("long"))).select(*files.columns, (F.col("batch") - 1).cast("int").alias("batch"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose digest isn't what it was when the publication was planned: a veto on publishing. Both: path, sha256."""
    return before.join(after.withColumnRenamed("sha256", "sha256_now"), "path", "left").where("sha256_now is null or sha256 != sha256_now").select("path")


def require(gaps: DataFrame, what: str, shown: int = 5) -> None:
    """Raises with a few of the gaps if there are any."""
    bad = gaps.limit(shown).collect()
    if bad:
        raise ValueError(f"{what}: " + "; ".join(f"{r[0]}: {r[1]}" for r in bad))


def published(df: DataFrame, path: str, gaps: Callable[[DataFrame], DataFrame], receipt: Callable[[DataFrame], DataFrame]) -> None:
    """Validated, written, and then sealed: the receipt is written last, so a corpus without one isn't whole."""
    require(gaps(df), path)
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    receipt(df.sparkSession.read.parquet(f"{path}/rows")).write.mode("errorifexists").json(f"{path}/receipt")


def first_after_fault(messages: DataFrame, faults: DataFrame) -> DataFrame:
    """(episode, first_turn, certified_turn): the first assistant turn after a fault's result, and the one whose recovery is
    certified where that is another one; the last turn of all is the answer and neither.

    messages: episode, index, role. faults: episode, result_index, recovery_index (null without one).
    """
    turns = messages.where("role = 'assistant'").withColumn("_last", F.max("index").over(Window.partitionBy("episode")))
    after = turns.join(faults, "episode").where("index > result_index and index < _last")
    out = after.groupBy("episode").agg(F.min("index").alias("first_turn"), F.max(F.when(F.col("index") == F.col("recovery_index"), F.col("index"))).alias("certified_turn"))
    return out.withColumn("certified_turn", F.when(F.col("certified_turn") != F.col("first_turn"), F.col("certified_turn")))
