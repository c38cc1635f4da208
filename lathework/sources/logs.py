"""Event logs in files by day, and feedback and review logs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.plans.lineage import ensure_checkpoint_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_by_day(events: DataFrame, at: str, path: str) -> None:
    """Appends events as JSON lines, a folder per day."""
    events.withColumn("day", F.date_format(at, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def read_last_days(spark: SparkSession, path: str, schema: T.StructType | str, most: int) -> DataFrame:
    """The events of the last ``most`` days that have a folder (not the last days of the calendar)."""
    rows = spark.read.schema(schema).json(path)
    days = rows.select("day").distinct().orderBy(F.desc("day")).limit(most)
    return rows.join(F.broadcast(days), "day", "left_semi")


def read_until_broken(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines up to the first broken one of each file; what follows it is left out.

    Lines are numbered inside their file by offset, so a file is read whole by
    one task, as log files of a day are.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = whole.select("file", F.posexplode(F.split("value", "\n")).alias("nth", "line")).filter("trim(line) <> ''")
    parsed = lines.withColumn("broken", F.try_parse_json("line").isNull())
    first = parsed.groupBy("file").agg(F.min(F.when(F.col("broken"), F.col("nth"))).alias("first_broken"))
    good = parsed.join(first, "file").filter("first_broken IS NULL OR nth < first_broken")
    return good.select("file", "nth", F.from_json("line", schema).alias("r")).select("file", "nth", "r.*")


def read_log(spark: SparkSession, path: str, schema: str, defaults: dict) -> DataFrame:
    """A log with defaults for missing fields; broken records are nulls and get the defaults too."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).na.fill(defaults)


def load_config(text: str, key: str, fields: dict[str, type]) -> list[dict]:
    """Items of a YAML or JSON configuration: malformed text gives none, malformed items are skipped, a single string becomes a list.

    ``fields``: the fields an item must have, with their type; a list field may be given as one string.
    """
    try:
        import yaml

        loaded = yaml.safe_load(text)
    except ImportError:
        try:
            loaded = json.loads(text)
        except ValueError:
            return []
    except Exception:
        return []
    items = loaded.get(key) if isinstance(loaded, dict) else None
    out = []
    for item in items if isinstance(items, list) else []:
        if not isinstance(item, dict):
            continue
        fixed = {k: [v] if isinstance(v, str) and fields.get(k) is list else v for k, v in item.items()}
        if all(isinstance(fixed.get(k), t) for k, t in fields.items()):
            out.append(fixed)
    return out
