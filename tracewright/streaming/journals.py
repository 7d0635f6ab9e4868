"""Streams over append-only journals. Watermarks and windows are this library's addition to logs that are read as batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.shared import new_path


def sessions(events: DataFrame, journal: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each journal's heartbeats: a new one after ``gap`` without a sign of life."""
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(journal, w).agg(F.count("*").alias("beats"), F.min(at).alias("opened_at"), F.max(at).alias("last_at")).drop("session_window")


def appended_once(events: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each record once, however often it is appended within the time that late rows are waited for."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def rates(events: DataFrame, kind: str, at: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows of each kind in each window of event time."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def interrupted(events: DataFrame, quiet: str = "30 minutes", now: str = "processing") -> DataFrame:
    """(session, opened_at, last_at, charge_s): the charge of each session that gives no sign of life for ``quiet``.

    events: session, at (timestamp), event (open, beat, close, charge), elapsed_s (of a charge). One state a session: when it was
    opened, its last sign of life, and what is charged already. A sign of life sets the session's timer anew; when the timer
    ends, the time until the last sign, less what was charged, is given once and the state goes. A session that is closed has no
    charge; what comes in after the end, or of a session that never opened, changes nothing. The timer is of processing time, or
    with ``now="event"`` of the watermark, which ``events`` needs then.
    """
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(key, frames, state):
        opened, last, charged = state.get if state.exists else (None, None, 0.0)
        over = opened is not None and now == "event" and last // 1000 + wait <= state.getCurrentWatermarkMs()
        if state.hasTimedOut or over:
            state.remove()
            yield pd.DataFrame({"session": [key[0]], "opened_at": [pd.Timestamp(opened, unit="us")], "last_at": [pd.Timestamp(last, unit="us")], "charge_s": [max((last - opened) / 1e6 - charged, 0.0)]})
            if state.hasTimedOut:
                return
            opened, last, charged = None, None, 0.0
        rows = pd.concat(list(frames)).sort_values("at")
        for event, at, elapsed in zip(rows["event"], rows["at"].astype("datetime64[us]").astype("int64"), rows["elapsed_s"].fillna(0.0), strict=True):
            if event == "close":
                opened = None
                break
            opened = at if event == "open" and opened is None else opened
            if opened is not None:
                last = max(last or at, at)
                charged += elapsed if event == "charge" else 0.0
        if opened is None:
            if state.exists and not over:
                state.remove()
            return
        state.update((int(opened), int(last), float(charged)))
        if now == "event":
            state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        else:
            state.setTimeoutDuration(wait)

    timer = GroupStateTimeout.EventTimeTimeout if now == "event" else GroupStateTimeout.ProcessingTimeTimeout
    own = events.select(F.col("session").cast("string").alias("session"), "at", "event", F.col("elapsed_s").cast("double").alias("elapsed_s"))
    return own.groupBy("session").applyInPandasWithState(step, "session string, opened_at timestamp, last_at timestamp, charge_s double", "opened long, last long, charged double", "append", timer)


def completed_rewards(parts: DataFrame, names: tuple[str, ...], weights: tuple[float, ...], late: str = "1 hour") -> DataFrame:
    """(rollout, rewards map<string,double>, total): each rollout once, when all of its parts are there.

    parts: rollout, name, score, at (timestamp). One state a rollout holds the parts so far; of one part the first score counts.
    The row is given in the batch that brings the last part, with the weighted sum of all. The state stays until the watermark
    has passed its last part by ``late``, so what is repeated within that time is ignored; a rollout whose other parts don't
    come by then is dropped.
    """
    wait = int(pd.Timedelta(late).total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        scores, given, latest = (dict(zip(state.get[0], state.get[1], strict=True)), state.get[2], state.get[3]) if state.exists else ({}, False, 0)
        if latest and latest + wait <= state.getCurrentWatermarkMs():  # it has expired, and its timer comes after this batch
            scores, given, latest = {}, False, 0
        for frame in frames:
            for name, score, at in zip(frame["name"], frame["score"], frame["at"].astype("datetime64[ms]").astype("int64"), strict=True):
                latest = max(latest, int(at))
                if name in names:
                    scores.setdefault(name, float(score))
        if not given and len(scores) == len(names):
            given = True
            yield pd.DataFrame({"rollout": [key[0]], "rewards": [scores], "total": [round(sum(w * scores[n] for n, w in zip(names, weights, strict=True)), 4)]})
        state.update((list(scores), list(scores.values()), given, latest))
        state.setTimeoutTimestamp(max(latest + wait, state.getCurrentWatermarkMs() + 1))

    own = parts.withWatermark("at", late).select(F.col("rollout").cast("string").alias("rollout"), "name", F.col("score").cast("double").alias("score"), "at")
    return own.groupBy("rollout").applyInPandasWithState(step, "rollout string, rewards map<string,double>, total double", "names array<string>, scores array<double>, given boolean, latest long", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, checkpoint: str, key: tuple[str, ...] = (), out: str | None = None) -> DataFrame:
    """All of a stream's input, once, as a table that is written batch by batch: for files that don't grow, and tests.

    Without ``key`` rows are appended. With it they are updates, and the last batch's row of each key stays. A batch that is run
    again writes the same folder, and ``out`` and ``checkpoint`` go on where an earlier run ended. Nothing is held on the driver.
    """
    spark = stream.sparkSession
    out = out or new_path(spark, "stream")
    write = lambda df, number: df.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch-{number:09d}")
    q = stream.writeStream.outputMode("update" if key else "append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/batch-*")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    rows = spark.read.schema(schema).parquet(f"{out}/batch-*") if found else spark.createDataFrame([], schema)
    if not key:
        return rows.drop("_batch")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "_batch").alias("_row")).select("_row.*")
