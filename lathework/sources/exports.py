"""Findings as JSON, SARIF, CSV, Markdown and check runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels and ranks by severity.
LEVELS = {"critical": "error", "high": "error", "warning": "warning", "medium": "warning", "suggestion": "note", "low": "note", "info": "note"}
RANKS = {"critical": 95.0, "high": 80.0, "warning": 60.0, "medium": 50.0, "suggestion": 30.0, "low": 20.0, "info": 10.0}
ANNOTATIONS = {"critical": "failure", "high": "failure", "warning": "warning", "medium": "warning"}


def _of(table: dict, column: str, default) -> F.Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(default))


def json_documents(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON document per group: the findings in order and their number by severity."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("path", "line", "rule_id", "severity"))), lambda x: x)
    by_severity = findings.groupBy(*keys, "severity").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("stats"))
    return findings.groupBy(*keys).agg(rows.alias("comments")).join(by_severity, keys).select(*keys, F.to_json(F.struct("comments", "stats")).alias("json"))


def sarif_documents(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One SARIF 2.1.0 document per group: a rule per severity in order of first appearance, a result per finding, lines from 1."""
    order = F.struct("path", "line", "rule_id")
    first = findings.groupBy(*keys, "severity").agg(F.min(order).alias("first"))
    rules = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "severity"))), lambda x: x["severity"]).alias("names"))
    joined = findings.join(rules, keys)
    result = F.struct(
        F.col("severity").alias("ruleId"),
        (F.array_position("names", F.col("severity")) - 1).alias("ruleIndex"),
        _of(LEVELS, "severity", "note").alias("level"),
        _of(RANKS, "severity", 10.0).alias("rank"),
        F.struct(F.col("rule_id").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    grouped = joined.groupBy(*keys).agg(F.first("names").alias("names"), F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), result.alias("r")))), lambda x: x["r"]).alias("results"))
    driver = F.struct(F.lit("lathework").alias("name"), F.transform("names", lambda n: F.struct(n.alias("id"))).alias("rules"))
    document = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(driver.alias("driver")).alias("tool"), F.col("results"))).alias("runs"))
    return grouped.select(*keys, F.to_json(document).alias("sarif"))


def csv_rows(findings: DataFrame, body: str, cost: str) -> DataFrame:
    """Export columns of each finding: line ends of the body become blanks, costs have four decimals, halves rounded to even."""
    return findings.withColumns({body: F.regexp_replace(F.coalesce(body, F.lit("")), r"[\r\n]+", " "), cost: F.format_string("%.4f", F.coalesce(F.bround(F.col(cost), 4).cast("double"), F.lit(0.0)))})


def markdown_documents(findings: DataFrame, keys: list[str]) -> DataFrame:
    """One Markdown text per group: paths in order, under each its lines in order."""
    lines = findings.groupBy(*keys, "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "rule_id", "severity"))), lambda x: F.concat(F.lit("- **"), x["severity"], F.lit("** line "), x["line"].cast("string"), F.lit(": "), x["rule_id"])), "\n").alias("items"),
        F.count(F.lit(1)).alias("n"),
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "items"))), lambda x: F.concat(F.lit("### "), x["path"], F.lit("\n"), x["items"])), "\n\n")
    return lines.groupBy(*keys).agg(F.concat(F.lit("# "), F.sum("n").cast("string"), F.lit(" findings\n\n"), parts).alias("markdown"))


def check_runs(findings: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """Per group the conclusion (a failure with any critical one, neutral above three warnings, else success) and the first ``most`` annotations."""
    level = _of(ANNOTATIONS, "severity", "notice")
    notes = F.slice(F.array_sort(F.collect_list(F.struct("path", "line", "rule_id", level.alias("level")))), 1, most)
    grouped = findings.groupBy(*keys).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity").isin("warning", "medium")).alias("warnings"), notes.alias("annotations"))
    return grouped.withColumn("conclusion", F.when(F.col("critical") > 0, "failure").when(F.col("warnings") > 3, "neutral").otherwise("success"))
