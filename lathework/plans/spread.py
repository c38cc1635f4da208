"""Enough tasks for work that is heavy per byte."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """``scan`` in at least as many partitions as the cluster has cores.

    A scan of a few small files gives fewer partitions than cores, and work done
    in Python would leave most cores idle.  A scan that already has enough
    partitions, as any large one, is left alone and not shuffled.  For plain
    scans only: counting the partitions of a plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores * tasks_per_core)
