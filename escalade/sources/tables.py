"""Reading the parquet tables a job runs on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``<base_dir>/<name>.parquet`` (a file or a directory of parts)."""
    return spark.read.parquet(os.path.join(base_dir, f"{name}.parquet"))


def stream_source(spark: SparkSession, base_dir: str, name: str) -> tuple[str, str]:
    """(folder, pattern of file names) of a table for a file stream, which reads folders only:
    the parts of a directory, or the one file among those of ``base_dir``."""
    path = os.path.join(base_dir, f"{name}.parquet")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return path, "*"
    return base_dir, f"{name}.parquet"


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an under-split scan over the cluster's cores.

    A large table arrives in many splits and is returned as is (no shuffle).
    A table stored as a few big row groups scans in a few tasks, so heavy
    per-row work (tokenising text) would run on a few cores: then rows are
    hash-partitioned on ``keys`` (or round-robin) into ``defaultParallelism``
    partitions. Checking the split count plans the scan but runs no job.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)
