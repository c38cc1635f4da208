"""Regex rule scanners over line tables.

Rules are literals of the plan, not rows of a join: each pattern is then compiled
once per task, and a line is tested in one projection without any exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.literals import contains, required_literals
from lathework.operators.paths import has_any, is_migration, is_test, language, severity_rank

Rule = tuple[str, str, str, tuple[str, ...], str]

#: Rules whose patterns other dialects cannot read: look-behind of any width, an unescaped brace.
DISABLED = {"PERF003"}
REWRITTEN = {"PERF002": r"(?:for|forEach|map)\s*\(.*\)\s*(?:=>|\{)\s*\n?\s*.*(?:await\s+)?(?:prisma|db|knex|sequelize|mongoose)\."}

#: The same lines without two ways to read a stretch of text, over which a backtracking engine takes the square or worse of a line's length.
#: PERF011: what the possessive form cannot stop at, the white space of the last part reaches from the stop before.
#: PERF002: on one line the first closing of the head serves as well as any later one; only a head at the end of a line reaches over it.
LINEAR = {
    "PERF011": r"for\s+.*:\s*\n(?:\s++.*\n)*?\s+\w+\s*\+=\s*['\"]",
    "PERF002": r"(?:for|forEach|map)\s*\((?:(?>.*?\)\s*(?:=>|\{)).*?(?:prisma|db|knex|sequelize|mongoose)\.|.*\)\s*(?:=>|\{)\s*\n\s*.*(?:prisma|db|knex|sequelize|mongoose)\.)",
}

#: Marks of test files in the performance scanner.
PERFORMANCE_TEST_MARKS = ["test_", "_test.", ".test.", ".spec.", "tests/", "__tests__/", "test/", "testing/", "e2e/", "cypress/", "playwright/", "fixtures/"]

#: Severities of scanner findings from the worst.
SCAN_SEVERITIES = ["critical", "high", "medium", "low"]


def _gate(rule: Rule) -> Column:
    return F.col("language").isin(*rule[3]) if rule[3] else F.lit(True)


def scan_lines(lines: DataFrame, rules: Sequence[Rule], flags: str = "(?id)", most: int = 100) -> DataFrame:
    """Every (line, rule) that hits: the columns of ``lines`` and ``rule_ord, rule_id, severity, category, matched``.

    ``lines`` has ``language`` and ``text``.  ``matched`` is cut to ``most`` characters.
    A regex runs only on lines that have the strings every match of it contains.
    """
    hits = [
        F.when(
            _gate(r) & contains(F.col("lower_text"), required_literals(r[4])) & F.col("text").rlike(flags + r[4]),
            F.struct(F.lit(i).alias("rule_ord"), F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("severity"), F.lit(r[2]).alias("category"), F.substring(F.regexp_extract("text", flags + r[4], 0), 1, most).alias("matched")),
        )
        for i, r in enumerate(rules)
    ]
    return lines.withColumn("lower_text", F.lower("text")).withColumn("hit", F.explode(F.array_compact(F.array(*hits)))).select(*lines.columns, "hit.*")


def security_findings(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All hits of the rules in lines of files that are no tests; ``severity_rank`` orders them."""
    ready = lines.filter(~is_test(F.col("filename"))).withColumn("language", language(F.col("filename")))
    return scan_lines(ready, rules).withColumn("severity_rank", severity_rank(F.col("severity"), SCAN_SEVERITIES, 4))


def migration_findings(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """All hits in migration files; ``matched`` is the stripped line, cut to 200 characters."""
    ready = lines.filter(is_migration(F.col("filename"))).withColumn("language", F.lit(""))
    return scan_lines(ready, rules).withColumn("matched", F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, 200))


def performance_findings(lines: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One finding per file and rule: the first line that hits, else the first hit over lines joined in order of their number.

    ``file_id, filename, rule_id, severity, category, line_no, matched``.
    """
    ready = lines.filter(~has_any(F.lower("filename"), PERFORMANCE_TEST_MARKS)).withColumn("language", language(F.col("filename")))
    able = [(r[0], r[1], r[2], r[3], (REWRITTEN | LINEAR).get(r[0], r[4])) for r in rules if r[0] not in DISABLED]
    hits = scan_lines(ready, able, flags="(?imd)")
    stripped = F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, 200)
    single = hits.groupBy("file_id", "rule_id").agg(F.min_by(F.struct("filename", "severity", "category", "line_no", stripped.alias("matched")), "first_position").alias("f"))
    blocks = (
        ready.groupBy("file_id", "filename", "language")
        .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("rows"))
        .select("file_id", "filename", "language", F.transform("rows", lambda x: x["line_no"]).alias("numbers"), F.array_join(F.transform("rows", lambda x: x["text"]), "\n").alias("text"))
    )
    whole = scan_lines(blocks, able, flags="(?imd)", most=200)
    at = F.instr("text", F.col("matched"))
    before = F.length(F.regexp_replace(F.substr(F.col("text"), F.lit(1), at - 1), "[^\n]", ""))
    multi = whole.join(single, ["file_id", "rule_id"], "left_anti").select("file_id", "filename", "rule_id", "severity", "category", F.coalesce(F.get("numbers", before), F.col("numbers")[0]).alias("line_no"), "matched")
    return single.select("file_id", "f.filename", "rule_id", "f.severity", "f.category", "f.line_no", "f.matched").unionByName(multi)


def first_rule_per_line(hits: DataFrame) -> DataFrame:
    """Of several rules that hit a line the first in rule order."""
    order = Window.partitionBy("file_id", "line_no").orderBy("rule_ord")
    return hits.withColumn("nth", F.row_number().over(order)).filter("nth = 1").drop("nth")


def files_without_companions(files: DataFrame, keys: list[str], match: Column, companion: Column) -> DataFrame:
    """Groups in which a file matches and none is a companion: ``keys`` and the first matching ``filename``."""
    grouped = files.groupBy(*keys).agg(F.bool_or(match).alias("hit"), F.bool_or(companion).alias("answered"), F.min(F.when(match, F.struct("file_ord", "file_id", "filename"))).alias("first"))
    return grouped.filter(F.col("hit") & ~F.col("answered")).select(*keys, F.col("first.filename").alias("filename"))


def merge_findings(main: DataFrame, scanners: DataFrame) -> DataFrame:
    """Comments and scanner findings in one list: a finding goes when an earlier row has its file and line.

    Both have ``source_ord, file_id, line_no``; rows of ``main`` all stay.
    """
    both = main.withColumn("is_main", F.lit(True)).unionByName(scanners.withColumn("is_main", F.lit(False)))
    order = Window.partitionBy("file_id", "line_no").orderBy(F.desc("is_main"), "source_ord", "rule_id")
    return both.withColumn("nth", F.row_number().over(order)).filter(F.col("is_main") | (F.col("nth") == 1)).drop("nth")


def snap_to_lines(comments: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Comments moved to the nearest line that exists, the lower of two equally near; comments on files without lines go.

    ``comments``: ``key, comment_id, wanted``; ``lines``: ``key, line_no``.  The
    nearest line on either side is found by one sort of both tables together.
    """
    marks = lines.select(key, F.col("line_no").alias("at"), F.lit(None).cast("string").alias("comment_id")).unionByName(comments.select(key, F.col("wanted").alias("at"), F.col("comment_id").cast("string").alias("comment_id")))
    line = F.when(F.col("comment_id").isNull(), F.col("at"))
    order = Window.partitionBy(key).orderBy("at")
    below = F.last(line, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first(line, ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = marks.withColumns({"below": below, "above": above}).filter("comment_id IS NOT NULL AND (below IS NOT NULL OR above IS NOT NULL)")
    nearest = F.when(F.col("above").isNull() | (F.col("at") - F.col("below") <= F.col("above") - F.col("at")), F.col("below")).otherwise(F.col("above"))
    return near.select(key, "comment_id", F.col("at").alias("wanted"), nearest.alias("line_no"))
