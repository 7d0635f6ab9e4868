"""Decision tables: claims, winners, horizons and the clustered bootstrap."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the registered bootstrap.
SEED, REPLICATES, BLOCK, ALPHA, LEAST_CLUSTERS = 2786983947, 100_000, 2_000, 0.025, 30


def overlaid(gates: DataFrame, bugs: DataFrame, key: str) -> DataFrame:
    """``gates`` whose status is BUG where the harness has one; what was observed stays in ``observed``."""
    bad = bugs.select(key).distinct().withColumn("_bug", F.lit(True))
    return gates.join(bad, key, "left").withColumn("observed", F.col("status")).withColumn("status", F.when(F.col("_bug"), "BUG").otherwise(F.col("status"))).drop("_bug")


def winner(bug: Column, unmet: Column, trained_floors: Column, base_floors: Column, non_inferior: Column, recovery: Column, incomplete: Column) -> Column:
    """Rank of the first rule that holds: 1 a mandatory check is BUG, 2 one is INCONCLUSIVE, 4 the trained arm ships, 5 the base
    arm ships, 6 floor evidence is incomplete, 7 none. Floors are booleans; the two gates are statuses and have to PASS."""
    trained = trained_floors & (non_inferior == "PASS") & (recovery == "PASS")
    return F.when(bug, 1).when(unmet, 2).when(trained, 4).when(base_floors, 5).when(incomplete, 6).otherwise(7)


def crossing_horizon(curves: DataFrame, by: list[str], horizon: str, rate: str, level: float) -> DataFrame:
    """Where a success curve falls below ``level``: the last horizon at or above it and the next one below, or a censored end."""
    low = F.max(F.when(F.col(rate) >= level, F.col(horizon))).over(Window.partitionBy(*by))
    marked = curves.withColumn("_lo", low)
    out = marked.groupBy(*by).agg(F.first("_lo").alias("last_above"), F.min(F.when(F.col("_lo").isNull() | (F.col(horizon) > F.col("_lo")), F.col(horizon))).alias("first_below"))
    state = F.when(F.col("last_above").isNull(), "left_censored").when(F.col("first_below").isNull(), "right_censored").otherwise("crossing")
    return out.withColumn("state", state)


def cluster_sums(df: DataFrame, cluster: str, value: Column) -> DataFrame:
    return df.groupBy(cluster).agg(F.sum(value).cast("double").alias("total"), F.count("*").cast("double").alias("n"))


#: Choices that are looked up at once.
AT_ONCE = 1 << 20


def stream(seed: int, label: str, chunk: int, n: int) -> np.ndarray:
    """n little-endian 64-bit words of the stream of a chunk, SHAKE-256."""
    return np.frombuffer(hashlib.shake_256(f"{seed:#x}:{label}:chunk{chunk}".encode("ascii")).digest(8 * n), "<u8")


def draws(seed: int, label: str, chunk: int, n: int, k: int) -> np.ndarray:
    """n choices of 0..k-1: words of the stream of a chunk, modulo k."""
    return (stream(seed, label, chunk, n) % np.uint64(k)).astype(np.int64)


def bootstrap_bound(df: DataFrame, cluster: str, value: Column, label: str, replicates: int = REPLICATES, seed: int = SEED, block: int = BLOCK, alpha: float = ALPHA) -> dict:
    """The lower bound of the mean over rows, resampling whole clusters: point, bound, clusters, whether it is degenerate.

    Sums by cluster come to the driver (one row a cluster, sorted by its name); each chunk of ``block`` replicates has its own
    stream, so chunks are tasks and partitioning has no part in the result. A task holds the stream of its chunk, 8 bytes times
    ``block`` times clusters, as the stream can't be entered in its middle, and little beside it.
    """
    rows = sorted(((str(r[cluster]), r["total"], r["n"]) for r in cluster_sums(df, cluster, value).collect()))
    k = len(rows)
    if k == 0:
        return {"point": None, "bound": None, "clusters": 0, "degenerate": True}
    total, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    point = float(total.sum() / n.sum())
    if k == 1:
        return {"point": point, "bound": point, "clusters": 1, "degenerate": True}

    def chunks(frames):
        for frame in frames:
            for c in frame["id"]:
                b = min(block, replicates - int(c) * block)
                words = stream(seed, label, int(c), b * k).reshape(b, k)
                step = max(1, AT_ONCE // k)
                for low in range(0, b, step):  # the stream is one piece, what is made of it isn't
                    at = (words[low : low + step] % np.uint64(k)).astype(np.int64)
                    yield pd.DataFrame({"ratio": total[at].sum(1) / n[at].sum(1)})

    count = -(-replicates // block)
    ratios = df.sparkSession.range(0, count, 1, min(count, 64)).mapInPandas(chunks, "ratio double")
    place = int(np.floor(alpha * replicates))
    bound = ratios.orderBy("ratio").offset(place).limit(1).first()["ratio"]
    return {"point": point, "bound": float(bound), "clusters": k, "degenerate": False}


def bootstrap_gate(result: dict, margin: float, least: int = LEAST_CLUSTERS, largest: int | None = None, most: int | None = None, missing: int = 0) -> str:
    """PASS only if the bound is above the margin; too few or too large clusters, or missing names, decide nothing."""
    if missing or result["degenerate"] or result["clusters"] < least or (most is not None and (largest or 0) > most):
        return "INCONCLUSIVE"
    return "PASS" if result["bound"] > margin else "FAIL"
