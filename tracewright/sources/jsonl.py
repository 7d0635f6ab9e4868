"""JSON-lines scans and sinks: strict and tolerant, in file order, sealed and attested."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import canonical_json
from ..operators.shared import settle


def strict(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Every line has to be JSON of the schema; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that are no JSON): what is malformed is counted by whoever asks, and not lost. A missing path is empty.

    Rows are written once, as a query on the malformed column alone isn't answered from the files.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    whole = f"{schema}, _corrupt_record string"
    rows = settle(spark.read.schema(whole).option("mode", "PERMISSIVE").json(path), "tolerant") if found else spark.createDataFrame([], whole)
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select("_corrupt_record")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, src_file, line_no): the lines of text files, numbered from 0 within each, however many splits a file has.

    Lines are kept once with the split that they are from and their order in it; lines are counted by split, the counts of a
    file's earlier splits are added, and no line moves. Lines end at a line feed.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    raw = settle(raw, "lines")
    splits = raw.groupBy("src_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("src_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return raw.join(splits, ["src_file", "_block"]).select("line", "src_file", (F.col("_id") - F.col("_first") + F.col("_before")).alias("line_no"))


def in_file_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with ``src_file`` and ``line_no``, for rules that depend on which record came later; blank lines only count."""
    lines = numbered_lines(spark, path).where("trim(line) != ''")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("row"), "src_file", "line_no").select("row.*", "src_file", "line_no")


def first_directory(tables: list[DataFrame], key: str) -> DataFrame:
    """Of several tables with the same columns, each key's rows from the first table that has it."""
    ranked = None
    for i, df in enumerate(tables):
        df = df.withColumn("_dir", F.lit(i))
        ranked = df if ranked is None else ranked.unionByName(df)
    return ranked.withColumn("_first", F.min("_dir").over(Window.partitionBy(key))).where("_dir = _first").drop("_dir", "_first")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of a checksum list; a line of another form, or a path that leaves the folder, raises an error."""
    lines = spark.read.text(path).where("trim(value) != ''")
    name = F.regexp_extract("value", r"^([0-9a-f]{64})[ ][ *](.+)$", 2)
    hostile = (name == "") | name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)") | name.contains("\\")
    checked = F.when(hostile, F.raise_error(F.concat(F.lit("bad line: "), F.col("value")))).otherwise(name)
    return lines.select(F.left("value", F.lit(64)).alias("sha256"), checked.cast("string").alias("path"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, sha256) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def canonical_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON text a row."""
    return df.select(canonical_json(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value"))


def write_canonical(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical JSON lines in a total order, as a range of files whose names follow the order."""
    ordered = df.orderBy(*order)
    canonical_lines(ordered).write.mode("overwrite").text(path)


def write_attested(df: DataFrame, path: str, required: list[str]) -> None:
    """Written only if no row lacks a required field (null and empty both count as lacking)."""
    lacking = F.filter(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(c)) for c in required)), lambda x: x.isNotNull())
    bad = df.select(lacking.alias("fields")).where(F.size("fields") > 0).groupBy("fields").count().limit(5).collect()
    if bad:
        raise ValueError(f"rows lack {', '.join(sorted({f for r in bad for f in r['fields']}))}")
    df.write.mode("errorifexists").parquet(path)


#: Parts of a path that are never published.
REFUSED = ("secret", ".env", "id_rsa", "credential", ".ssh")


def refusal(path: Column) -> Column:
    """Why a path may not be published; null if it may."""
    low = F.lower(path)
    return F.coalesce(*(F.when(low.contains(part), F.lit(part)) for part in REFUSED))


def is_hash(text: str) -> bool:
    return re.fullmatch(r"[0-9a-f]{64}", text) is not None


#: Marks of a held-out release in a path.
HELD_OUT = ("heldout", "held_out", "held-out")


def publication_refusal(path: Column, receipts: tuple[str, ...], secrets: tuple[str, ...]) -> Column:
    """Why a bulk publication may not carry a path, below its folder; null if it may.

    Anything of a held-out release, by the shape of its path; receipts that have a publication of their own; plaintext secrets.
    Separators of either kind and leading dots and slashes don't matter.
    """
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^[./]+", "")
    held = F.rlike(F.lower(plain), F.lit("|".join(map(re.escape, HELD_OUT))))
    return F.when(held, "held-out release").when(plain.isin(*receipts), "receipt of its own").when(plain.isin(*secrets), "plaintext secret")
