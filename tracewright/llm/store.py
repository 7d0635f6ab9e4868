"""The folder that driver and executors share, and tables that cut lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset and all runs on one host."""
    path = spark.conf.get(SETTING, None)
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{SETTING} has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Executors may be lost at any time: what follows restarts from the files and not from the sources.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of what is settled: its cleaner does so for plans that the driver's memory no longer
    has, and a driver that is seldom full keeps them long."""
    spark.sparkContext._jvm.System.gc()
