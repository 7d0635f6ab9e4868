"""Harness audits: sanity of scored runs, causal dataflow into the answer, and vetoes as status rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import feeds_match
from .closure import reached


def sanity(episodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """(tag, code, level) of the checks S0 to S7 that a tag's run fails; a healthy run has no row.

    episodes: tag, ok, final, boxed_right (the independent rescore, may be null), n_calls, predicted, expected, dropped (earlier
    records of the same index). summaries: tag, n, accuracy, tool_use_rate. Weak results aren't faults: an accuracy of 0 that the
    rescore confirms is a warning only.
    """
    blank = F.coalesce(F.trim("final"), F.lit("")) == ""
    agree = F.abs(F.col("predicted") - F.col("expected")) < 1e-4
    wrong_flag = (F.col("ok") & blank) | (agree.isNotNull() & ((F.col("ok") & ~agree) | (~F.col("ok") & agree)))
    own = episodes.groupBy("tag").agg(
        F.count("*").alias("rows"),
        F.sum("dropped").alias("dropped"),
        F.avg(F.coalesce("ok", F.lit(False)).cast("int")).alias("rate"),
        F.count_if(~F.col("ok") & F.col("boxed_right")).alias("blind"),
        F.count_if(F.coalesce("final", F.lit("")).contains("<tool_call")).alias("syntactic"),
        F.count_if(F.coalesce(wrong_flag, F.lit(False))).alias("misflagged"),
        F.count_if(~blank).alias("finals"),
        F.avg((F.col("n_calls") > 0).cast("int")).alias("used"),
    )
    top = episodes.where(~blank).groupBy("tag", F.left("final", F.lit(200)).alias("_f")).agg(F.count("*").alias("same")).groupBy("tag").agg(F.max("same").alias("same"))
    both = summaries.join(own, "tag").join(top, "tag", "left")
    few = F.col("rows") >= 10
    blind = F.col("blind") >= F.greatest(F.lit(2.0), 0.05 * F.col("rows"))
    idle = (F.col("tool_use_rate") == 0) & few
    rules = [
        ("S0", "WARN", F.col("dropped") > 0),
        ("S1", "BUG", F.col("rows") != F.col("n")),
        ("S2", "BUG", F.abs(F.col("rate") - F.col("accuracy")) > 0.02),
        ("S3", "BUG", blind),
        ("S3", "WARN", ~blind & (F.col("accuracy") == 0) & few),
        ("S4", "BUG", idle & (F.col("syntactic") > 0)),
        ("S4", "WARN", idle & (F.col("syntactic") == 0)),
        ("S5", "BUG", F.col("misflagged") > 0),
        ("S6", "WARN", (F.col("finals") >= 10) & (F.col("same") / F.col("finals") > 0.5)),
        ("S7", "BUG", F.abs(F.col("used") - F.col("tool_use_rate")) > 0.05),
    ]
    fired = F.filter(F.array(*(F.when(test, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"))) for code, level, test in rules)), lambda x: x.isNotNull())
    return both.select("tag", F.explode(fired).alias("x")).select("tag", "x.code", "x.level")


def feeds(events: DataFrame, episode: str, decision: str, gives: str, takes: str) -> DataFrame:
    """(episode, a, b): calls a whose exposed value is an argument of a call b of a later decision."""
    a = events.select(F.col(episode).alias("episode"), F.col("call_id").alias("a"), F.col(decision).alias("da"), F.explode(gives).alias("value"))
    b = events.select(F.col(episode).alias("episode"), F.col("call_id").alias("b"), F.col(decision).alias("db"), F.explode(takes).alias("value"))
    return a.join(b, ["episode", "value"]).where("da < db").select("episode", "a", "b").distinct()


#: Characters from which on a value that stands within another counts, and steps a unit of the number line is cut into.
WITHIN, STEPS = 8, 1e8


def _grams(text: Column) -> Column:
    """The different stretches of WITHIN characters of a text."""
    last = F.char_length(text) - WITHIN + 1
    return F.array_distinct(F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(text, i, F.lit(WITHIN)))).otherwise(F.array().cast("array<string>")))


def _number_keys(text: Column, beside: tuple[int, ...]) -> Column:
    x = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    at = F.floor(x * STEPS).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.array(*(F.concat(F.lit("n"), (at + i).cast("string")) for i in beside))).otherwise(F.array().cast("array<string>"))


def _given_keys(value: Column) -> Column:
    """Names under which a produced value is looked for: its step of the number line, itself, its last whole word, its beginning,
    and, where an argument may stand in it, its stretches."""
    low = F.lower(F.trim(value))
    word = F.regexp_extract(F.trim(value), r"([\w.]+)[^\w.]*$", 1)
    begin = F.when(F.char_length(low) >= WITHIN, F.array(F.concat(F.lit("g"), F.left(low, F.lit(WITHIN))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_number_keys(value, (0,)), F.array(F.concat(F.lit("e"), low), F.concat(F.lit("t"), word)), begin, F.transform(_grams(low), lambda g: F.concat(F.lit("h"), g))))


def _taken_keys(value: Column) -> Column:
    low = F.lower(F.trim(value))
    words = F.transform(F.regexp_extract_all(value, F.lit(r"[\w.]+"), F.lit(0)), lambda w: F.concat(F.lit("t"), w))
    begin = F.when(F.char_length(low) >= WITHIN, F.array(F.concat(F.lit("h"), F.left(low, F.lit(WITHIN))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(_number_keys(value, (-1, 0, 1)), F.array(F.concat(F.lit("e"), low)), words, begin, F.transform(_grams(F.lower(value)), lambda g: F.concat(F.lit("g"), g))))


def text_feeds(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(episode, a, b): calls a of whose values one is an argument of a call b of a later decision, or stands in one.

    events: episode, call_id, decision_id, gives array<string> (exposed values). calls: episode, call_id, decision_id, takes
    array<string> (arguments without the recovery token). Values are matched as ``values.feeds_match`` does, within an episode.
    Only pairs that share a name are tested: of every kind of match both sides have one name at least in common (equal
    numbers are in the same or the next step, a number within an argument ends in a whole word of it, and a longer value
    within another begins with a stretch of it).
    """
    a = events.select("episode", F.col("call_id").alias("a"), F.col("decision_id").alias("da"), F.explode(F.array_distinct("gives")).alias("value"))
    b = calls.select("episode", F.col("call_id").alias("b"), F.col("decision_id").alias("db"), F.explode(F.array_distinct("takes")).alias("taken"))
    a, b = a.withColumn("name", F.explode(_given_keys(F.col("value")))), b.withColumn("name", F.explode(_taken_keys(F.col("taken"))))
    met = a.join(b, ["episode", "name"]).where(F.col("da") < F.col("db"))
    # a pair that shares several names is tested for each; that costs less than to move the texts once more
    return met.where(feeds_match(F.col("value"), F.col("taken"))).select("episode", "a", "b").distinct()


def contributing(edges: DataFrame, answers: DataFrame) -> DataFrame:
    """(episode, call_id): calls on the dataflow into each episode's answer call, itself included, however long the way is."""
    back = edges.selectExpr("episode as grp", "b as node", "a as next")
    return reached(answers.selectExpr("episode as grp", "call_id as node"), back).toDF("episode", "call_id")


def veto(violations: DataFrame, checked: DataFrame, name: str, empty: str = "INCONCLUSIVE") -> DataFrame:
    """(veto, status, n_checked, n_bad): BUG with a violation, OK without, ``empty`` when there was nothing to check."""
    n, bad = checked.agg(F.count("*").alias("n_checked")), violations.agg(F.count("*").alias("n_bad"))
    both = n.withColumn("_one", F.lit(1)).join(bad.withColumn("_one", F.lit(1)), "_one")
    status: Column = F.when(F.col("n_checked") == 0, empty).when(F.col("n_bad") > 0, "BUG").otherwise("OK")
    return both.select(F.lit(name).alias("veto"), status.alias("status"), "n_checked", "n_bad")
