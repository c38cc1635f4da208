"""Per-key results when a handful of keys hold most rows.

The rows are range partitioned on the composite of key and secondary order, into
a stated number of partitions whose bounds are sampled quantiles: a heavy key is
cut where its order crosses a bound and spreads over as many partitions as its
share of the rows asks for.  Each partition reduces its run of every key to a
partial state; a key that reaches over a bound leaves one on either side, and
the last aggregation stitches these, at most one per key and partition.

Before the range partitioning, rows that agree in key and order are combined on
the map side.  The composite is unique from there on, so no tie, such as a heavy
key whose order is null in most rows, keeps a partition from being cut.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.plans.lineage import cut

#: Range partitions at least; a key with a twentieth of the rows then lies in three or more.
PARTITIONS = 64


def balanced_totals(
    rows: DataFrame,
    key: Column,
    order: Column,
    measures: Mapping[str, Column],
    *,
    key_name: str = "key",
    partitions: int | None = None,
) -> DataFrame:
    """``key_name``, ``row_count``, the sum of each measure, and ``pieces``.

    ``pieces`` is the number of range partitions the key was spread over, of
    ``partitions`` in all (by default the session's shuffle partitions, at least
    ``PARTITIONS``).  A null key is a key like any other; a null in ``order``
    comes first; a null measure adds nothing and a key with null measures only
    has a null sum; rows that occur twice count twice; an empty input gives an
    empty result.
    """
    if partitions is None:
        partitions = max(PARTITIONS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    taken = rows.select(key.alias("key"), order.alias("at"), *[m.alias(f"m_{n}") for n, m in measures.items()])
    states = taken.groupBy("key", "at").agg(F.count(F.lit(1)).alias("row_count"), *[F.sum(f"m_{n}").alias(f"s_{n}") for n in measures])
    ranged = states.repartitionByRange(partitions, F.col("key").asc_nulls_first(), F.col("at").asc_nulls_first())
    stitched = (
        ranged.withColumn("part", F.spark_partition_id())
        .groupBy("key")
        .agg(
            F.sum("row_count").alias("row_count"),
            *[F.sum(f"s_{n}").alias(n) for n in measures],
            (F.max("part") - F.min("part") + 1).alias("pieces"),
        )
    )
    return stitched.select(F.col("key").alias(key_name), "row_count", *measures, "pieces")


def repository_totals(reviews: DataFrame, chunks: DataFrame, partitions: int | None = None) -> DataFrame:
    """``table_name, repository_id, row_count, total_cost, total_length, pieces`` over both tables.

    The secondary order is the time of creation (reviews) or indexing (chunks).
    """
    of_reviews = balanced_totals(
        reviews,
        F.col("repository_id"),
        F.col("created_at"),
        {"total_cost": F.col("total_cost_usd")},
        key_name="repository_id",
        partitions=partitions,
    ).select(F.lit("reviews").alias("table_name"), "repository_id", "row_count", "total_cost", F.lit(None).cast("bigint").alias("total_length"), "pieces")
    of_chunks = balanced_totals(
        chunks,
        F.col("repository_id"),
        F.col("indexed_at"),
        {"total_length": F.length("content").cast("bigint")},
        key_name="repository_id",
        partitions=partitions,
    ).select(F.lit("chunks").alias("table_name"), "repository_id", "row_count", F.lit(None).cast("decimal(20,6)").alias("total_cost"), "total_length", "pieces")
    return of_reviews.unionByName(of_chunks)


def heavy_keys(totals: DataFrame, share: float = 0.05) -> DataFrame:
    """Keys that hold at least ``share`` of their table's rows; the null key counts in the total only.

    The totals, one row per key, are computed once and written down; their sums,
    one row per table, are what gets broadcast.
    """
    totals = cut(totals)
    whole = totals.groupBy(F.col("table_name").alias("of")).agg(F.sum("row_count").alias("whole"))
    parts = round(1 / share)
    return (
        totals.join(F.broadcast(whole), F.col("table_name") == F.col("of"))
        .filter(F.col("repository_id").isNotNull() & (F.col("row_count") * parts >= F.col("whole")))
        .select("table_name", "repository_id")
    )
