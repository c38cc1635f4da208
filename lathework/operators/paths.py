"""Predicates on file names and titles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.globs import matches_shell

#: Files that are not reviewed unless configured otherwise.
IGNORED = [
    "*.lock", "*.min.js", "*.min.css", "*.map", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "go.sum", "*.pb.go", "*.generated.*", "*_generated.*",
    "vendor/**", "node_modules/**", "dist/**", "build/**", ".env", ".env.*", "*.pem", "*.key", "*.cert", "*.wasm", "*.png", "*.jpg", "*.jpeg", "*.gif", "*.svg", "*.ico", "*.woff", "*.woff2", "*.ttf", "*.eot",
]

#: Language of a suffix; the first that fits counts.
LANGUAGES = [
    (".py", "python"), (".js", "javascript"), (".ts", "typescript"), (".tsx", "typescript"), (".jsx", "javascript"), (".mjs", "javascript"), (".cjs", "javascript"), (".go", "go"), (".java", "java"), (".rb", "ruby"),
    (".php", "php"), (".cs", "csharp"), (".rs", "rust"), (".kt", "kotlin"), (".swift", "swift"), (".sh", "shell"), (".bash", "shell"), (".zsh", "shell"), (".sql", "sql"), (".yaml", "yaml"), (".yml", "yaml"),
    (".dockerfile", "docker"), (".tf", "terraform"), (".hcl", "terraform"),
]

#: Parts of the names of tests, and of migrations.
TEST_MARKS = ["test_", "_test.", ".test.", ".spec.", "tests/", "__tests__/", "testing/", "fixtures/", "mocks/", "testdata/", "test-data/"]
MIGRATION_MARKS = ["migration", "migrate", "alembic", "flyway", "liquibase", "db/migrate", "migrations/", "schema.sql", "changeset", ".up.sql", ".down.sql"]

#: Severities from the worst; an unknown one comes after these.
SEVERITIES = ["critical", "warning", "suggestion", "info"]


def has_any(column: Column, parts: Sequence[str]) -> Column:
    tests = [column.contains(p) for p in parts]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def reviewable(files: DataFrame, ignored: Sequence[str] = IGNORED) -> DataFrame:
    """Files with a patch whose name no pattern ignores (``*`` crosses directories)."""
    return files.filter(~matches_shell(F.col("filename"), ignored) & (F.col("patch") != ""))


def with_title_words(rows: DataFrame, title: str, words: Sequence[str]) -> DataFrame:
    """Rows whose title has one of the words, in any letter case; a null title has none."""
    return rows.filter(has_any(F.lower(title), [w.lower() for w in words]))


def language(name: Column, pairs: Sequence[tuple[str, str]] = LANGUAGES) -> Column:
    base = F.lower(F.substring_index(name, "/", -1))
    found = F.when((base == "dockerfile") | base.startswith("dockerfile."), "docker")
    for suffix, lang in pairs:
        found = found.when(name.endswith(suffix), lang)
    return found.otherwise("")


def is_test(name: Column, marks: Sequence[str] = TEST_MARKS) -> Column:
    return has_any(F.lower(name), marks)


def is_migration(name: Column) -> Column:
    return has_any(F.lower(name), MIGRATION_MARKS) | F.lower(name).endswith(".sql")


def testable(files: DataFrame, skip: Sequence[str], languages: Sequence[str]) -> DataFrame:
    """Files to write tests for, with their ``language``."""
    named = files.withColumn("language", language(F.col("filename")))
    return named.filter((F.col("status") != "removed") & ~is_test(F.col("filename")) & F.col("language").isin(*languages) & ~has_any(F.col("filename"), [s.strip("*") for s in skip]))


def severity_rank(severity: Column, order: Sequence[str] = SEVERITIES, unknown: int | None = None) -> Column:
    rank = F.array_position(F.array(*map(F.lit, order)), severity)
    return F.when(F.coalesce(rank, F.lit(0)) == 0, len(order) if unknown is None else unknown).otherwise(rank - 1)


def at_least(findings: DataFrame, threshold: str, order: Sequence[str] = SEVERITIES) -> DataFrame:
    """Findings as bad as the threshold or worse; an unknown threshold keeps only the worst, an unknown severity counts as the mildest."""
    most = order.index(threshold) if threshold in order else 0
    return findings.filter(severity_rank(F.col("severity"), order, len(order) - 1) <= most)


def first_files(files: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("repo_full_name", "pr_number", "head_sha").orderBy("file_ord", "file_id")
    return files.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most).drop("nth")
