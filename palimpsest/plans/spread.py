"""Dealing out inputs that arrive in too few partitions for work that is heavy by the row."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores if it has fewer; large inputs are left as they were read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
