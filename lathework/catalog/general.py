"""Queries of the general problems: deliveries and uneven keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog.registry import query
from lathework.operators.balance import heavy_keys, repository_totals
from lathework.operators.delivery import pull_request_deliveries
from lathework.plans.lineage import cut
from lathework.plans.tables import table

#: White space that RE2 does not count as \s.
_WIDE = r"\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"


def sql_folded(column: str) -> str:
    return rf"nullif(lower(regexp_replace({column}, '^[\s\x0B{_WIDE}]+|[\s\x0B{_WIDE}]+$', '', 'g')), '')"


_RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY k1, k2, k3 ORDER BY received_at NULLS LAST, delivery_id) AS rank
    FROM (SELECT *, {sql_folded("pull_request.head.sha")} AS k1, number AS k2, {sql_folded("repository.full_name")} AS k3 FROM pr_opened)
"""


@query("p1_found", f"SELECT delivery_id FROM ({_RANKED}) WHERE k1 IS NOT NULL AND k2 IS NOT NULL AND k3 IS NOT NULL AND rank > 1")
def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """Deliveries that are not the copy kept."""
    taken = table(spark, directory, "pr_opened").select("delivery_id", "received_at", "number", "pull_request", "repository")
    return pull_request_deliveries(taken).superseded.select("delivery_id").distinct()


@query(
    "p1_kept",
    f"""SELECT delivery_id, batch_id, received_at, action, number, pull_request.head.sha AS head_sha, repository.full_name AS full_name
        FROM ({_RANKED}) WHERE k1 IS NULL OR k2 IS NULL OR k3 IS NULL OR rank = 1""",
)
def p1_kept(spark: SparkSession, directory: str) -> DataFrame:
    """pr_opened with exactly one delivery of each message."""
    kept = pull_request_deliveries(table(spark, directory, "pr_opened")).kept
    return kept.select(
        "delivery_id",
        "batch_id",
        "received_at",
        "action",
        "number",
        F.col("pull_request.head.sha").alias("head_sha"),
        F.col("repository.full_name").alias("full_name"),
    )


_HEAVY = """
    FROM (
         SELECT 'reviews' AS table_name, repository_id, count(*) AS n, (SELECT count(*) FROM reviews) AS whole FROM reviews GROUP BY ALL
         UNION ALL
         SELECT 'chunks', repository_id, count(*), (SELECT count(*) FROM chunks) FROM chunks GROUP BY ALL)
    WHERE repository_id IS NOT NULL AND n * 20 >= whole
"""


@query("p4_found", f"SELECT table_name, repository_id {_HEAVY}")
def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Repositories that hold at least a twentieth of a table's rows."""
    totals = repository_totals(table(spark, directory, "reviews"), table(spark, directory, "chunks"))
    return heavy_keys(totals)


@query(
    "p4_totals",
    """SELECT 'reviews' AS table_name, repository_id, count(*) AS row_count, sum(total_cost_usd)::DECIMAL(20,6) AS total_cost, NULL::BIGINT AS total_length
       FROM reviews GROUP BY repository_id
       UNION ALL
       SELECT 'chunks', repository_id, count(*), NULL::DECIMAL(20,6), sum(length(content))::BIGINT FROM chunks GROUP BY repository_id""",
)
def p4_totals(spark: SparkSession, directory: str) -> DataFrame:
    """Row count, total cost and total content length of every repository_id."""
    totals = repository_totals(table(spark, directory, "reviews"), table(spark, directory, "chunks"))
    return totals.select("table_name", "repository_id", "row_count", F.col("total_cost").cast("decimal(20,6)").alias("total_cost"), "total_length")


@query("p4_split", f"SELECT table_name, repository_id, true AS is_split {_HEAVY}")
def p4_split(spark: SparkSession, directory: str) -> DataFrame:
    """Whether the rows of each heavy repository were spread over several range partitions."""
    totals = cut(repository_totals(table(spark, directory, "reviews"), table(spark, directory, "chunks")))
    found = heavy_keys(totals)
    return found.join(totals, ["table_name", "repository_id"]).select("table_name", "repository_id", (F.col("pieces") > 1).alias("is_split"))
