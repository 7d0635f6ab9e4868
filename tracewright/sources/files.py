"""Bundles, kinds, documents, corpora and folders of files; appends, staged writes and sealed publications."""

from __future__ import annotations

import json
import tomllib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canonical_json
from . import tables


def of_kind(df: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    """The rows of one kind of a mixed journal; the filter reaches a Parquet scan, and drops lines early in a JSON one."""
    return df.where(F.col(column) == kind)


def document(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One row a file that is one JSON document over many lines."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def bundles(specs: DataFrame, kb: DataFrame, oracles: DataFrame, ids: DataFrame | None = None, key: str = "task_id") -> DataFrame:
    """Specifications with their knowledge base and oracle; ``ids`` (key, ordinal) takes a part of them, in its order.

    Reading a task that lacks one of the three, or an id that no specification has, raises.
    """
    wanted = specs if ids is None else ids.join(specs, key, "left")
    if ids is not None:
        probe = next(c for c in specs.columns if c != key)
        wanted = wanted.join(specs.select(key).withColumn("_known", F.lit(True)), key, "left").withColumn(probe, F.when(F.col("_known"), F.col(probe)).otherwise(F.raise_error(F.concat(F.lit("no specification of "), F.col(key).cast("string"))).cast(specs.schema[probe].dataType))).drop("_known")
    both = wanted.join(kb.select(key, F.struct(*(c for c in kb.columns if c != key)).alias("kb")), key, "left").join(oracles.select(key, F.struct(*(c for c in oracles.columns if c != key)).alias("oracle")), key, "left")
    check = lambda name: F.coalesce(F.col(name), F.raise_error(F.concat(F.lit(f"no {name} of "), F.col(key).cast("string"))).cast(both.schema[name].dataType))
    return both.withColumn("kb", check("kb")).withColumn("oracle", check("oracle"))


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """``path``, if its bytes have this digest, and an error if they don't. The digest is taken by a task, one row comes back."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256")).collect()
    if [r["sha256"] for r in got] != [sha256]:
        raise ValueError(f"{path} isn't the file that was pinned")
    return path


def settings(spark: SparkSession, path: str) -> dict:
    """A TOML or JSON configuration, a small file; it is read by Spark, so any path that Spark can open will do."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    return tomllib.loads(text) if PurePosixPath(path).suffix == ".toml" else json.loads(text)


def questions(df: DataFrame, seed: str, offset: int = 0, limit: int | None = None, key: str = "id", answer: str = "answer") -> DataFrame:
    """A window of a question set in the order of a keyed digest, with ``truth``: what stands after the last ``####``.

    A sampling operator. The order is the same at every run and isn't that of another library's shuffle.
    """
    ordered = df.withColumn("_key", F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)).orderBy("_key", key).offset(offset)
    ordered = ordered if limit is None else ordered.limit(limit)
    truth = F.when(F.contains(answer, F.lit("####")), F.replace(F.trim(F.substring_index(answer, "####", -1)), F.lit(","), F.lit("")))
    return ordered.drop("_key").withColumn("truth", truth)


def corpus(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A training corpus of JSON lines; one that isn't there or has no row is an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def listing(spark: SparkSession, folders: list[str], glob: str = "*") -> DataFrame:
    """(path, length, modified) of the files of folders that match, once each, sorted by path; symbolic links are left out.

    Folders may overlap. A link is a file whose real path, as the file system gives it, is another one.
    """
    files = None
    for folder in folders:
        own = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
        files = own if files is None else files.union(own)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    links = []
    for folder in folders:  # names of a publication's folders, no data
        top = hadoop.Path(folder)
        system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.getScheme() == "file":
            local = spark.sparkContext._jvm.java.io.File(top.toUri().getPath())
            links += _links(spark, local)
    out = files.dropDuplicates(["path"])
    if links:
        out = out.where(~F.regexp_replace("path", "^file:/*", "/").isin(*links))
    return out.orderBy("path")


def _links(spark: SparkSession, folder) -> list[str]:
    nio = spark.sparkContext._jvm.java.nio.file.Files
    out = []
    for f in folder.listFiles() or []:
        if nio.isSymbolicLink(f.toPath()):
            out.append(f.getPath())
        elif f.isDirectory():
            out += _links(spark, f)
    return out


def write_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical JSON, one line a row, in one file in a total order; for manifests and other small tables."""
    lines = df.orderBy(*order).select(canonical_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_staged(df: DataFrame, path: str) -> int:
    """The rows as the whole of a table of ``tables``: a reader sees the old rows or the new ones, and a failed write leaves the
    old ones. ``tables.table`` reads them."""
    return tables.replace(df, path)


def append(df: DataFrame, path: str, key: str) -> int:
    """Appends rows whose key isn't there yet to a table of ``tables``, and says how many; several writers may append at once."""
    return tables.append(df, path, key)


def pending(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Planned work without a result, each key once."""
    return planned.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def write_split(df: DataFrame, path: str, split: str = "split", group: str | None = None) -> None:
    """One folder a split, and a group of it where there is one."""
    df.write.mode("overwrite").partitionBy(*([split] if group is None else [split, group])).parquet(path)


def publish(rows: DataFrame, metadata: DataFrame, report: DataFrame, path: str) -> None:
    """Rows, then their metadata, then the report, each whole before the next begins: the report says that all is there."""
    for name, df in (("rows", rows), ("metadata", metadata)):
        df.write.mode("errorifexists").parquet(f"{path}/{name}")
    report.write.mode("errorifexists").json(f"{path}/report")
