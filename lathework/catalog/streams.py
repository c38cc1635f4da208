"""Queries of the streaming operators, each drained over what is there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog.general import sql_folded
from lathework.catalog.registry import query
from lathework.operators.delivery import folded
from lathework.plans.tables import table
from lathework.streaming import events as E


@query("l1_routed_messages", "SELECT delivery_id, CASE WHEN action IN ('opened', 'synchronize', 'reopened') THEN 'review' WHEN action = 'edited' THEN 'describe' END AS route FROM pr_opened")
def l1_routed_messages(spark: SparkSession, directory: str) -> DataFrame:
    return E.drained(E.routed(E.stream_table(spark, directory, "pr_opened")).select("delivery_id", "route"), "routed")


@query(
    "l2_intake_once",
    f"SELECT DISTINCT sha, number, full_name FROM (SELECT {sql_folded('pull_request.head.sha')} AS sha, number, {sql_folded('repository.full_name')} AS full_name FROM pr_opened) WHERE sha IS NOT NULL AND number IS NOT NULL AND full_name IS NOT NULL",
)
def l2_intake_once(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of deliveries lets each message through once (L2, L11); the watermark spans the table's year."""
    messages = E.stream_table(spark, directory, "pr_opened").select(folded("pull_request.head.sha").alias("sha"), "number", folded("repository.full_name").alias("full_name"), "received_at")
    known = messages.filter("sha IS NOT NULL AND number IS NOT NULL AND full_name IS NOT NULL").withColumn("received_at", F.col("received_at").cast("timestamp"))
    return E.drained(E.once_per_key(known, ["sha", "number", "full_name"], "received_at", "3650 days").select("sha", "number", "full_name"), "intake")


@query("l3_known_repositories", f"SELECT delivery_id, r.id AS repository_id FROM pr_opened p JOIN repositories r ON {sql_folded('p.repository.full_name')} = {sql_folded('r.github_full_name')}")
def l3_known_repositories(spark: SparkSession, directory: str) -> DataFrame:
    """Messages joined to stored rows: a stream against a table."""
    stored = table(spark, directory, "repositories").select(F.col("id").alias("repository_id"), folded("github_full_name").alias("name"))
    stream = E.stream_table(spark, directory, "pr_opened").select("delivery_id", folded("repository.full_name").alias("name"))
    return E.drained(stream.join(stored, "name").select("delivery_id", "repository_id"), "known")


def _windows_sql(size: str, start: str) -> str:
    return f"""SELECT starts, event_type, n, total FROM (SELECT {start} AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
      WHERE starts + INTERVAL '{size}' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)"""


@query("l16_tumbling_windows", _windows_sql("1 hour", "time_bucket(INTERVAL '1 hour', ts)"))
def l16_tumbling_windows(spark: SparkSession, directory: str) -> DataFrame:
    stream = E.stream_table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.windowed(stream, "ts", ["event_type"], "1 hour"), "tumbling")


@query(
    "l17_sliding_windows",
    """SELECT starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS starts, event_type, value FROM events)
       GROUP BY 1, 2 HAVING starts + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
)
def l17_sliding_windows(spark: SparkSession, directory: str) -> DataFrame:
    stream = E.stream_table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.windowed(stream, "ts", ["event_type"], "1 hour", "30 minutes"), "sliding")


@query(
    "l18_sessions",
    """WITH gaps AS (SELECT user_id, ts, (ts >= lag(ts) OVER w + INTERVAL '20 minutes' OR lag(ts) OVER w IS NULL)::INT AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
            numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
       SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL '20 minutes' AS ends, count(*) AS n FROM numbered GROUP BY user_id, s HAVING ends <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
)
def l18_sessions(spark: SparkSession, directory: str) -> DataFrame:
    stream = E.stream_table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.sessions(stream, "ts", "user_id", "20 minutes"), "sessions")


@query(
    "l12_cooldown",
    """WITH RECURSIVE k AS (SELECT user_id, min_by(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM events GROUP BY 1
         UNION ALL SELECT k.user_id, min_by(e.event_id, (e.ts, e.event_id)), min(e.ts) FROM k JOIN events e ON e.user_id = k.user_id AND e.ts >= k.ts + INTERVAL '1 hour' GROUP BY k.user_id)
       SELECT user_id, event_id FROM k""",
)
def l12_cooldown(spark: SparkSession, directory: str) -> DataFrame:
    """Keyed state: an event passes if the last one that passed is an hour ago."""
    stream = E.stream_table(spark, directory, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.drained(E.cooled_down(stream, 3600), "cooldown")


@query(
    "l8_token_bucket",
    """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts)::DOUBLE / 1e6 AS sec, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events),
         b AS (SELECT event_type, event_id, sec, nth, 3.0::DOUBLE AS tokens FROM e WHERE nth = 1
           UNION ALL SELECT e.event_type, e.event_id, e.sec, e.nth, least(3.0, b.tokens - (b.tokens >= 1)::INT + (e.sec - b.sec) * 0.03::DOUBLE / 60) FROM b JOIN e ON e.event_type = b.event_type AND e.nth = b.nth + 1)
       SELECT event_type, event_id, tokens >= 1 AS allowed, round(CASE WHEN tokens >= 1 THEN 0 ELSE (1 - tokens) * 60 / 0.03::DOUBLE END, 2) AS wait FROM b""",
)
def l8_token_bucket(spark: SparkSession, directory: str) -> DataFrame:
    """One event in about half an hour for each type, three in a burst."""
    return E.drained(E.rate_limited(E.stream_table(spark, directory, "events"), 0.03, 3.0), "bucket").withColumn("wait", F.round("wait", 2))


@query("l9_busiest_user", "SELECT event_type, max_by(user_id, (n, -user_id)) AS user_id FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def l9_busiest_user(spark: SparkSession, directory: str) -> DataFrame:
    """The key with the most of something, ties to the least key."""
    counted = table(spark, directory, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("event_type").agg(F.max_by("user_id", F.struct("n", -F.col("user_id"))).alias("user_id"))


@query("l10_retry_times", "SELECT id, round(least(1.0 * pow(2.0, attempt - 1), 300.0), 3) AS wait, regexp_matches(error_message, '(?i)(?:rate.?limit|timeout|timed out|overloaded|temporar|unavailable|connection|429|500|502|503|504|529)') AS retryable FROM (SELECT DISTINCT id, error_message, pr_number % 12 + 1 AS attempt FROM reviews WHERE error_message IS NOT NULL)")
def l10_retry_times(spark: SparkSession, directory: str) -> DataFrame:
    """Waiting times and which errors are worth another attempt."""
    failed = table(spark, directory, "reviews").filter("error_message IS NOT NULL").select("id", "error_message", (F.col("pr_number") % 12 + 1).alias("attempt")).distinct()
    return failed.select("id", F.round(E.retry_after(F.col("attempt")), 3).alias("wait"), F.col("error_message").rlike(E.RETRYABLE).alias("retryable"))


@query("l7_status_per_batch", "SELECT status, count(*) AS n FROM reviews GROUP BY 1")
def l7_status_per_batch(spark: SparkSession, directory: str) -> DataFrame:
    """A function per micro-batch writes states; its result is read back and counted."""
    stream = E.stream_table(spark, directory, "reviews").select("id", "status")
    written = E.drained_batches(stream, "states", lambda rows, path: rows.write.mode("overwrite").parquet(path), "id string, status string")
    return written.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
