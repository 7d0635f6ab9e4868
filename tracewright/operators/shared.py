"""Tables written in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of its own only where it is unset and all runs on one host."""
    path = spark.conf.get(SETTING, None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{SETTING} has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: what follows restarts from these files, and its plan begins with them."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_union(df: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """``df`` written as one more part of a table: (these rows, all rows of the table, its path)."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    part = f"{path}/part={uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(part)
    read = spark.read.schema(df.schema)
    return read.parquet(part), read.option("recursiveFileLookup", True).parquet(path), path
