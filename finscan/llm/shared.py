"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder is made and kept in the session if all runs on
    this machine (master local); a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="finscan-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for one table or one archive in the shared folder."""
    return f"{shared_folder(spark)}/finscan/{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def placed(parts: int) -> np.ndarray:
    """For each of parts partitions the smallest number that Spark's hash (Murmur3, seed 42) deals to it."""
    out = np.full(parts, -1, np.int64)
    low, step = 0, 16 * parts
    u = np.uint32
    turn = lambda x, r: (x << u(r)) | (x >> u(32 - r))
    while (out < 0).any():
        n = np.arange(low, low + step, dtype=np.int64)
        h = u(42) ^ turn(n.astype(np.uint32) * u(0xCC9E2D51), 15) * u(0x1B873593)
        h = (turn(h, 13) * u(5) + u(0xE6546B64)) ^ u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        h ^= h >> u(16)
        at, first = np.unique(h.view(np.int32).astype(np.int64) % parts, return_index=True)
        new = out[at] < 0
        out[at[new]] = n[first[new]]
        low += step
    return out


def interval_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above value: a binary search over a literal array (null: 0)."""
    if not cuts:
        return F.lit(0)
    known = F.array(*(F.lit(c).cast("long") for c in cuts))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))))
    beyond = lambda at, step: (at + step <= len(cuts)) & (F.get(known, at + step - 1) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(beyond(at, step), at + step).otherwise(at))
