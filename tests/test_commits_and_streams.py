"""Commits of concurrent writers, line numbers over splits, and stateful streams over several batches."""

import json
import os
import subprocess
import sys
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewright.sources import jsonl, tables
from tracewright.streaming import journals


def test_appends_of_several_writers_keep_each_key_once(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, w int"
    assert tables.table(spark, path, schema).count() == 0
    errors = []

    def write(w):
        try:
            for i in range(3):
                tables.append(spark.range(i * 10, i * 10 + 20).select(F.col("id").alias("k"), F.lit(w).alias("w")), path, "k")
        except Exception as e:
            errors.append(e)

    writers = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert not errors and sorted(r["k"] for r in tables.table(spark, path, schema).collect()) == list(range(40))
    names = sorted(p.name for p in (tmp_path / "t" / "log").glob("*.json"))
    assert names == [f"{i + 1:012d}.json" for i in range(len(names))]
    assert tables.append(spark.range(5).select(F.col("id").alias("k"), F.lit(9).alias("w")), path, "k") == 0


def test_a_name_is_created_once(spark, tmp_path):
    path = str(tmp_path / "one")
    assert tables._created(spark, path, "a") and not tables._created(spark, path, "b")
    assert Path(path).read_text() == "a" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["one"]


def test_readers_during_a_replace_see_old_or_new(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v int"
    rows = lambda v: spark.range(50).withColumn("v", F.lit(v))
    tables.replace(rows(0), path)
    before, seen, stop = tables.table(spark, path, schema), [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(sorted({(r["v"], r["n"]) for r in tables.table(spark, path, schema).groupBy("v").agg(F.count("*").alias("n")).collect()}))

    reader = threading.Thread(target=read)
    reader.start()
    for v in range(1, 6):
        tables.replace(rows(v), path)
    stop.set()
    reader.join()
    assert seen and all(len(s) == 1 and s[0][1] == 50 for s in seen)
    assert before.agg(F.max("v")).first()[0] == 0  # what a reader has taken stays
    assert tables.swept(spark, path) == 5 and tables.table(spark, path, schema).agg(F.min("v")).first()[0] == 5


def test_two_processes_append(spark, tmp_path):
    root, path = Path(__file__).parents[1], str(tmp_path / "t")
    code = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from tracewright.sources import tables
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for i in range(4):
    tables.append(spark.range(i * 5, i * 5 + 12).withColumnRenamed("id", "k"), {path!r}, "k")
""".format(root=str(root), path=path)
    both = [subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) for _ in range(2)]
    assert [p.wait(timeout=240) for p in both] == [0, 0]
    assert sorted(r["k"] for r in tables.table(spark, path, "k long").collect()) == list(range(27))


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = {name: [json.dumps({"i": i, "v": "é" * (i % 50)}) if i % 7 else "" for i in range(n)] for name, n in (("a", 3000), ("b", 10))}
    for name, own in lines.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(own) + ("\n" if name == "a" else ""))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        numbered = jsonl.numbered_lines(spark, str(tmp_path))
        assert numbered.rdd.getNumPartitions() >= 1
        got = {(Path(r["src_file"]).stem, r["line_no"]): r["line"] for r in numbered.collect()}
        rows = jsonl.in_file_order(spark, str(tmp_path), "i int, v string")
        assert {(Path(r["src_file"]).stem, r["line_no"], r["i"]) for r in rows.collect()} == {(n, i, i) for n, own in lines.items() for i in range(len(own)) if i % 7}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(n, i): t for n, own in lines.items() for i, t in enumerate(own)}


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def put(folder, name, rows):
    """A file of rows; files named by a number are taken in that order, as files of one moment have none."""
    folder.mkdir(exist_ok=True)
    file = folder / f"{name}.json"
    file.write_text("\n".join(json.dumps(r) for r in rows))
    if name.isdigit():
        os.utime(file, (1_600_000_000 + int(name),) * 2)


@pytest.fixture
def few(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rewards_over_three_batches(spark, tmp_path, few):
    """Parts arrive over three batches and a restart; one row comes out, repeats are ignored, a lone part expires."""
    folder, names, weights = tmp_path / "in", ("a", "b", "c"), (1.0, 0.5, 0.1)
    part = lambda rollout, name, score, minute: {"rollout": rollout, "name": name, "score": score, "at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"}
    run = lambda: journals.run_to_end(journals.completed_rewards(stream_of(spark, folder, "rollout string, name string, score double, at timestamp"), names, weights, "30 minutes"), str(tmp_path / "check"), out=str(tmp_path / "out"))
    put(folder, "1", [part("r", "a", 1, 0), part("s", "a", 1, 0)])
    assert run().count() == 0
    put(folder, "2", [part("r", "b", 2, 5), part("r", "b", 7, 6), part("r", "other", 9, 6)])
    assert run().count() == 0
    put(folder, "3", [part("r", "c", 3, 9)])
    put(folder, "4", [part("r", "a", 5, 10), part("r", "c", 5, 10)])
    put(folder, "5", [part("z", "a", 1, 200)])
    put(folder, "6", [part("s", "b", 1, 201), part("s", "c", 1, 201)])
    rows = run().collect()
    assert [(r["rollout"], r["rewards"], r["total"]) for r in rows] == [("r", {"a": 1.0, "b": 2.0, "c": 3.0}, 2.3)]


def test_interrupted_sessions(spark, tmp_path, few):
    """A session that falls silent is charged from its last sign of life, once; closed and unopened ones aren't."""
    folder = tmp_path / "in"
    e = lambda session, event, minute, elapsed=None: {"session": session, "event": event, "at": f"2026-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "elapsed_s": elapsed}
    schema = "session string, event string, at timestamp, elapsed_s double"
    run = lambda: journals.run_to_end(journals.interrupted(stream_of(spark, folder, schema).withWatermark("at", "1 minute"), "30 minutes", "event"), str(tmp_path / "check"), out=str(tmp_path / "out"))
    put(folder, "1", [e("dead", "open", 0), e("dead", "beat", 20), e("fine", "open", 0), e("never", "beat", 3)])
    put(folder, "2", [e("dead", "charge", 29, 300.0), e("fine", "beat", 25), e("late", "open", 25)])
    assert run().count() == 0
    put(folder, "3", [e("fine", "close", 40), e("late", "beat", 50)])
    put(folder, "4", [e("other", "open", 70)])
    put(folder, "5", [e("dead", "beat", 71), e("other", "beat", 72)])
    rows = run().collect()
    assert [(r["session"], r["charge_s"], r["last_at"].minute) for r in rows] == [("dead", 29 * 60 - 300.0, 29)]
    put(folder, "6", [e("other", "beat", 90)])
    put(folder, "7", [e("other", "beat", 95)])
    assert {r["session"]: r["charge_s"] for r in run().collect()} == {"dead": 1440.0, "late": 1500.0}


def test_a_processing_time_timer(spark, tmp_path, few):
    import time

    folder = tmp_path / "in"
    put(folder, "1", [{"session": "s", "event": "open", "at": "2026-01-01T00:00:00Z"}, {"session": "s", "event": "beat", "at": "2026-01-01T00:01:00Z"}])
    stream = stream_of(spark, folder, "session string, event string, at timestamp, elapsed_s double")
    out, q_schema = str(tmp_path / "out"), "session string, opened_at timestamp, last_at timestamp, charge_s double"
    q = journals.interrupted(stream, "1 second").writeStream.outputMode("append").foreachBatch(lambda df, i: df.write.mode("append").parquet(out)).option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        for i in range(60):
            time.sleep(0.5)
            put(folder, f"tick{i}", [{"session": f"x{i}", "event": "beat", "at": "2026-01-01T00:01:00Z"}])
            if spark.read.schema(q_schema).parquet(str(tmp_path / "ou[t]")).count() if Path(out).exists() else 0:
                break
    finally:
        q.stop()
    assert [(r["session"], r["charge_s"]) for r in spark.read.parquet(out).collect()] == [("s", 60.0)]
