"""Table scans with an input-parallelism guard.

A large input already arrives in many scan partitions (one per file split),
and then ``spread`` does nothing. A small input stored as one big row group
would otherwise run its CPU-heavy text work in a single task; ``spread``
hash-partitions it by its row key to the session's default parallelism.
The decision only inspects the planned partition count (no job runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, *keys: str) -> DataFrame:
    target = df.sparkSession.sparkContext.defaultParallelism
    planned = df.rdd.getNumPartitions()
    if planned >= target:
        return df
    return df.repartition(target, *keys) if keys else df.repartition(target)


def read_table(spark: SparkSession, path: str, *spread_keys: str) -> DataFrame:
    df = spark.read.parquet(path)
    return spread(df, *spread_keys) if spread_keys else df
