"""Aggregations over reviews, events and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """One row per review id: the state furthest on, by completion and then by content.

    The row is carried through a map-side combined ``max_by``, so repeated ids are
    never gathered.
    """
    rank = F.struct(F.col("completed_at").isNotNull(), F.col("status") != "queued", F.coalesce("completed_at", "created_at"), "status", "total_cost_usd", "total_input_tokens")
    columns = reviews.columns
    return reviews.groupBy("id").agg(F.max_by(F.struct(*columns), rank).alias("r")).select("r.*")


def repository_stats(reviews: DataFrame, since: Column) -> DataFrame:
    """Per repository and reviews posted since then: count, mean cost in millionths, median and 95th percentile of the duration."""
    posted = reviews.filter((F.col("status") == "posted") & (F.col("created_at") >= since) & F.col("repository_id").isNotNull())
    return posted.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("posted"),
        F.expr("cast(sum(total_cost_usd) * 1000000 AS bigint) div count(*)").alias("avg_cost_micros"),
        F.round(F.percentile("duration_ms", F.lit(0.5)), 3).alias("p50_ms"),
        F.round(F.percentile("duration_ms", F.lit(0.95)), 3).alias("p95_ms"),
    )


def log_totals(log: DataFrame) -> DataFrame:
    """Totals and means over a log; means are 0 for an empty one."""
    return log.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0)).cast("decimal(20,6)").alias("cost"),
        F.coalesce(F.round(F.avg("duration_ms"), 6), F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.sum(F.col("total_input_tokens").cast("bigint") + F.col("total_output_tokens")), F.lit(0)).alias("tokens"),
    )


def per_day(rows: DataFrame, at: str) -> DataFrame:
    return rows.groupBy(F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("total_cost_usd").cast("decimal(20,6)").alias("cost"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def map_totals(rows: DataFrame, column: str) -> DataFrame:
    """Sums of a map of counters by key."""
    return rows.select(F.explode(column).alias("key", "count")).groupBy("key").agg(F.sum("count").alias("total"))


def top_counts(rows: DataFrame, column: str, first: Column, most: int) -> DataFrame:
    """The most frequent values, ties by first appearance; nulls are no value."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    return counted.orderBy(F.desc("n"), "first", column).limit(most).select(column, "n")


def newest(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The newest ``most`` rows of each key; rows with a null key are a key of their own.

    The filter on the row number is also applied before the shuffle, so a frequent
    key sends at most ``most`` rows per task.  Rows that ``order`` leaves equal are
    taken in any order.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).drop("nth")


def benchmark(samples: DataFrame, findings: DataFrame) -> DataFrame:
    """Scanner against expectations: ``true_positives, false_negatives, false_positives, true_negatives, recall, precision``.

    ``samples``: ``sample_id, expected`` (patterns); ``findings``: ``sample_id,
    words``.  A sample with expectations counts as found when one of its patterns
    occurs in the words of its findings; one without when it has no finding.
    """
    texts = findings.groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_list("words")), " ").alias("found"))
    joined = samples.join(texts, "sample_id", "left")
    expects = F.size("expected") > 0
    met = F.expr("exists(expected, p -> p <> '' AND coalesce(found, '') rlike concat('(?i)', p))")
    count = lambda c: F.count_if(c)
    totals = joined.agg(
        count(expects & met).alias("true_positives"),
        count(expects & ~met).alias("false_negatives"),
        count(~expects & F.col("found").isNotNull()).alias("false_positives"),
        count(~expects & F.col("found").isNull()).alias("true_negatives"),
    )
    share = lambda other: F.round(F.col("true_positives") / F.greatest(F.col("true_positives") + F.col(other), F.lit(1)), 6)
    return totals.withColumn("recall", share("false_negatives")).withColumn("precision", share("false_positives"))
