"""Streams of messages and events: routing, deduplication, windows and keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lathework.sources.logs import shared_path


def stream_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table's files as a stream; the last letter is a pattern because a stream reads folders or patterns."""
    base = directory.rstrip("/")
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{base}/{name[:-1]}[{name[-1]}].parquet")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and reads its result back; checkpoint and result lie in the shared folder."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    run = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def drained_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, str], None], schema: str) -> DataFrame:
    """Like ``drained`` with a function per micro-batch, which may run twice for a batch and must then write the same."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    run = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda rows, batch: write(rows, f"{path}/rows/batch={batch}")).start()
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/rows")


def routed(messages: DataFrame) -> DataFrame:
    """Messages with the handler their action goes to; others have none."""
    action = F.col("action")
    return messages.withColumn("route", F.when(action.isin("opened", "synchronize", "reopened"), "review").when(action == "edited", "describe"))


#: Commands in the order they are tried.
COMMANDS = ["fix", "review", "ask", "generate-tests", "describe", "changelog", "split", "approve"]


def commands(text: Column, names: list[str], prefix: str = "/") -> Column:
    """The first command, in the order given, that a text starts with after white space; letter case counts."""
    clean = F.regexp_replace(text, r"^\s+", "")
    chain = F.lit(None).cast("string")
    for name in reversed(names):
        chain = F.when(clean.startswith(prefix + name), name).otherwise(chain)
    return chain


def once_per_key(messages: DataFrame, keys: list[str], at: str, late: str = "60 days") -> DataFrame:
    """The first message of each key that arrives; keys are forgotten once they are older than the watermark."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, at: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in tumbling or sliding windows, each once, after the watermark has passed it."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    grouped = events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("starts"), *keys, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")


def _cooldown(seconds: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        kept = []
        for row in rows.itertuples():
            now = row.ts.timestamp()
            if last is None or now - last >= seconds:
                last = now
                kept.append((int(key[0]), int(row.event_id)))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["user_id", "event_id"])

    return step


def cooled_down(events: DataFrame, seconds: float) -> DataFrame:
    """Events of each user at least ``seconds`` after the last one let through: ``user_id, event_id``."""
    return events.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandasWithState(_cooldown(seconds), "user_id bigint, event_id bigint", "last double", "append", GroupStateTimeout.NoTimeout)


def _bucket(per_minute: float, burst: float):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for event, now in zip(rows["event_id"].tolist(), (rows["ts"] - pd.Timestamp(0)).dt.total_seconds().tolist()):
            if last is not None:
                tokens = min(burst, tokens + (now - last) * per_minute / 60)
            last = now
            allowed = tokens >= 1
            out.append((key[0], event, allowed, 0.0 if allowed else (1 - tokens) * 60 / per_minute))
            tokens -= allowed
        state.update((float(tokens), last))
        yield pd.DataFrame(out, columns=["event_type", "event_id", "allowed", "wait"])

    return step


def rate_limited(events: DataFrame, per_minute: float, burst: float) -> DataFrame:
    """A token bucket per event type: whether each event finds a token, and the seconds until there is one.

    Buckets hold up to ``burst`` tokens and refill steadily.  A bucket is a
    sequence: one task works through a type's events of a micro-batch in order of
    time, and what it holds is bounded by the size of the micro-batch, which the
    source's options set.
    """
    rows = events.select("event_type", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    return rows.groupBy("event_type").applyInPandasWithState(_bucket(per_minute, burst), "event_type string, event_id bigint, allowed boolean, wait double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def retry_after(attempt: Column, base: float = 1.0, most: float = 300.0) -> Column:
    """Seconds until the next attempt: doubling from ``base``, at most ``most``."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(most))


def deliveries(messages: DataFrame, fails: Column, most_attempts: int = 5, base: float = 1.0, longest: float = 300.0) -> DataFrame:
    """``messages`` with ``attempts, status, waited``: delivered after ``fails`` failures, or a dead letter once the attempts are used up.

    Between attempts a message waits twice as long each time, at most ``longest``.
    """
    tried = F.least(fails, F.lit(most_attempts - 1))
    waits = F.when(tried > 0, F.transform(F.sequence(F.lit(1), F.greatest(tried, F.lit(1))), lambda n: retry_after(n, base, longest)))
    return messages.withColumns(
        {
            "attempts": F.least(fails + 1, F.lit(most_attempts)).cast("int"),
            "status": F.when(fails < most_attempts, "delivered").otherwise("dead_letter"),
            "waited": F.aggregate(waits, F.lit(0.0), lambda a, w: a + w),
        }
    )


#: Errors that are worth another attempt.
RETRYABLE = r"(?i)(?:rate.?limit|timeout|timed out|overloaded|temporar|unavailable|connection|429|500|502|503|504|529)"
