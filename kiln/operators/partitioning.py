"""Parallelism guard for CPU-heavy row work (regex, tokenisation).

A scan gets one task per file split; a small or row-group-poor file can give
fewer tasks than the cluster has cores. ``spread`` then redistributes rows
round-robin to the default parallelism. On large inputs, where splits far
outnumber cores, it returns the frame unchanged (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    if df.isStreaming:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
