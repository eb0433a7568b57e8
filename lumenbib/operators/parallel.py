"""Enough tasks for work that costs much more CPU than its bytes suggest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tasks(df: DataFrame) -> int:
    """Tasks that keep all cores busy: the context's parallelism, or the shuffle's partitions if there are more."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is a plain scan of fewer partitions than there are cores; else as it is.

    A small table in one file would be one task. A large one has many partitions and isn't shuffled; a plan that has
    a shuffle already isn't looked at, since asking for its partitions would run it.
    """
    if df._jdf.queryExecution().executedPlan().toString().startswith("AdaptiveSparkPlan"):
        return df
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.rdd().getNumPartitions() < n else df


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """df partitioned by keys into as many tasks as `tasks` says, which adaptive execution doesn't put together again."""
    return df.repartition(tasks(df), *keys)


def broadcast_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df marked for broadcast if it is counted to have at most `rows` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
