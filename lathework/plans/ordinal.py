"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.plans.lineage import cut


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "nth") -> DataFrame:
    """``rows`` with their number from 1 in a total order.

    Rows are range partitioned by sampled quantiles and sorted inside each
    partition; the position inside the partition is shifted by the sizes of the
    partitions before it, one row per partition.
    """
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    # one row per partition of the table
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + at + 1).drop("__part", "__id", "__before")
