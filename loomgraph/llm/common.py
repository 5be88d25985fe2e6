"""What the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over two partitions per core, by key, if its files give fewer than one per core. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df
