"""Labels by patterns, and a fold whose result depends on the order of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathework.operators.diff import PR
from lathework.operators.paths import has_any

#: Sizes, types and areas of a change.
SIZES = [(10, "size/XS"), (50, "size/S"), (200, "size/M"), (500, "size/L")]
LARGEST = "size/XL"
TYPES = [
    (r"\b(?:feat|feature|add|new)\b", "type/feature"), (r"\b(?:fix|bug|patch|hotfix|resolve)\b", "type/bugfix"), (r"\b(?:refactor|clean|restructure)\b", "type/refactor"), (r"\b(?:doc|docs|readme|documentation)\b", "type/docs"),
    (r"\b(?:test|spec|coverage)\b", "type/test"), (r"\b(?:chore|deps|dependency|bump|upgrade)\b", "type/chore"), (r"\b(?:perf|performance|optimize|speed)\b", "type/performance"), (r"\b(?:ci|cd|pipeline|workflow|deploy)\b", "type/ci"),
    (r"\b(?:security|vuln|cve|auth)\b", "type/security"), (r"\b(?:style|css|ui|design|layout)\b", "type/ui"), (r"\b(?:breaking|deprecat)\b", "type/breaking"), (r"\b(?:revert)\b", "type/revert"),
]
AREAS = [
    (r"(?:src/(?:components|pages|views|ui)/|\.tsx?$|\.jsx?$|\.css$|\.scss$)", "area/frontend"), (r"(?:src/(?:api|server|routes|controllers|services)/|\.go$|\.py$|\.rs$|\.java$)", "area/backend"),
    (r"(?:\.github/|Dockerfile|docker-compose|terraform|k8s|helm|\.tf$)", "area/infra"), (r"(?:test_|_test\.|\.test\.|\.spec\.|tests/|__tests__/)", "area/testing"), (r"(?:\.sql$|migration|alembic|flyway|schema)", "area/database"),
    (r"(?:\.md$|docs/|README|CHANGELOG)", "area/docs"), (r"(?:package\.json|pyproject|Cargo|go\.mod|Gemfile)", "area/deps"), (r"(?:\.proto$|graphql|swagger|openapi)", "area/api-spec"),
]

#: Paths and texts that make a change risky.
SENSITIVE = ["Dockerfile", "docker-compose", ".github/workflows", "Makefile", "package.json", "pyproject.toml", "Cargo.toml", "go.mod", ".env", "schema", "migration"]
RISKY_TEXT = [r"(?:DROP|ALTER|TRUNCATE)\s+TABLE", r"(?:migration|migrate)", r"(?:DELETE|REMOVE)\s+(?:FROM|WHERE)", r"(?:api|endpoint|route).*(?:v\d|version)", r"(?:auth|permission|rbac|acl)", r"(?:password|secret|token|credential)"]


def size_sql(total: str) -> str:
    return "CASE " + " ".join(f"WHEN {total} <= {n} THEN '{label}'" for n, label in SIZES) + f" ELSE '{LARGEST}' END"


def size_labels(files: DataFrame) -> DataFrame:
    totals = files.groupBy(*PR).agg(F.sum(F.col("additions") + F.col("deletions")).alias("total"))
    return totals.select(*PR, F.expr(size_sql("total")).alias("label"))


def type_labels(rows: DataFrame, key: str, title: str, body: str) -> DataFrame:
    """A missing title reads as the word None, a missing body as nothing."""
    text = F.concat(F.coalesce(title, F.lit("None")), F.lit(" "), F.coalesce(body, F.lit("")))
    hits = [F.when(text.rlike("(?i)" + p), label) for p, label in TYPES]
    return rows.select(key, F.explode(F.array_compact(F.array(*hits))).alias("label"))


def area_labels(files: DataFrame) -> DataFrame:
    """Areas of a pull request with the first file that shows each."""
    hits = [F.when(F.col("filename").rlike("(?i)" + p), label) for p, label in AREAS]
    exploded = files.select(*PR, "file_ord", "file_id", "filename", F.explode(F.array_compact(F.array(*hits))).alias("label"))
    return exploded.groupBy(*PR, "label").agg(F.min_by("filename", F.struct("file_ord", "file_id")).alias("filename"))


def risk_fold(files: DataFrame) -> DataFrame:
    """``risk`` per pull request: files in order add 3 up to 10 for a sensitive path and 5 up to 15 for a risky text, so a later path can lower it."""
    sensitive = has_any(F.lower("filename"), [s.lower() for s in SENSITIVE])
    risky = F.lit(False)
    for pattern in RISKY_TEXT:
        risky = risky | F.col("patch").rlike("(?id)" + pattern)
    marked = files.select(*PR, F.struct("file_ord", "file_id", sensitive.alias("sensitive"), F.coalesce(risky, F.lit(False)).alias("risky")).alias("f"))
    grouped = marked.groupBy(*PR).agg(F.array_sort(F.collect_list("f")).alias("files"))
    fold = F.expr(
        "aggregate(files, 0, (a, f) -> CASE WHEN f.risky THEN least(CASE WHEN f.sensitive THEN least(a + 3, 10) ELSE a END + 5, 15) WHEN f.sensitive THEN least(a + 3, 10) ELSE a END)"
    )
    return grouped.select(*PR, fold.alias("risk"))


#: Points of a change by component; a value above the bound has the points, the first that fits counts.
POINTS = {
    "size": [(1000, 30), (500, 25), (300, 18), (150, 10), (50, 5)],
    "spread": [(15, 15), (7, 10), (3, 5)],
    "languages": [(3, 10), (2, 6), (1, 3)],
    "coupling": [(7, 15), (4, 10), (2, 5)],
    "churn": [(3, 15), (2, 10), (1, 5)],
    "concentration": [(500, 10), (300, 5)],
}
#: Names of the total by its bounds, and language families by the endings of names.
LEVELS = [(80, "critical"), (60, "high"), (30, "medium"), (10, "low")]
FAMILIES = {
    "python": [".py", ".pyi"], "javascript": [".js", ".jsx"], "typescript": [".ts", ".tsx"], "go": [".go"], "java": [".java"], "kotlin": [".kt"], "rust": [".rs"], "ruby": [".rb"], "php": [".php"], "csharp": [".cs"],
    "swift": [".swift"], "sql": [".sql"], "shell": [".sh", ".bash"], "css": [".css", ".scss", ".less"], "html": [".html"], "config": [".yaml", ".yml", ".toml", ".json", ".xml"],
}


def _points(value: Column, component: str) -> Column:
    return F.coalesce(*[F.when(value > bound, points) for bound, points in POINTS[component]], F.lit(0))


def change_scores(files: DataFrame) -> DataFrame:
    """Points per pull request by component, their sum up to 100 and its level: ``repo_full_name, pr_number, head_sha, size, spread, languages, coupling, churn, concentration, risk, score, level``.

    A change without additions has no churn.  Everything but the fold over the
    files' order is combined on the map side.
    """
    parts = F.split("filename", "/")
    folder = F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], parts[1])).when(F.size(parts) > 1, parts[0])
    family = F.coalesce(*[F.when(F.col("filename").endswith(end), name) for name, ends in FAMILIES.items() for end in ends])
    changed = F.col("additions") + F.col("deletions")
    sums = files.groupBy(*PR).agg(
        F.sum(changed).alias("changed"), F.count(F.lit(1)).alias("files"), F.count_distinct(family).alias("families"), F.count_distinct(folder).alias("folders"),
        F.try_divide(F.sum("deletions"), F.nullif(F.sum("additions"), F.lit(0))).alias("ratio"), F.max(changed).alias("largest"),
    )
    of = {"size": "changed", "spread": "files", "languages": "families", "coupling": "folders", "churn": "ratio", "concentration": "largest"}
    scored = sums.select(*PR, *[_points(F.col(column), component).alias(component) for component, column in of.items()]).join(risk_fold(files), PR)
    score = F.least(sum((F.col(c) for c in of), F.col("risk")), F.lit(100))
    level = F.coalesce(*[F.when(F.col("score") > bound, name) for bound, name in LEVELS], F.lit("trivial"))
    return scored.withColumn("score", score).withColumn("level", level)


def special_labels(files: DataFrame, titles: DataFrame) -> DataFrame:
    """``repo_full_name, pr_number, head_sha, label`` of large changes, changes with migrations and such as are called breaking.

    ``titles``: ``repo_full_name, pr_number, pr_title``; of several titles one suffices.
    """
    breaking = titles.groupBy("repo_full_name", "pr_number").agg(F.bool_or(F.coalesce(F.col("pr_title").rlike(r"\b(?:breaking|BREAKING)\b"), F.lit(False))).alias("breaking"))
    seen = files.groupBy(*PR).agg((F.sum(F.col("additions") + F.col("deletions")) > 500).alias("large"), F.bool_or(F.contains(F.lower("filename"), F.lit("migration"))).alias("migrates"))
    labels = [F.when(F.col("large"), "needs-careful-review"), F.when(F.col("migrates"), "has-migration"), F.when(F.coalesce("breaking", F.lit(False)), "breaking-change")]
    return seen.join(breaking, ["repo_full_name", "pr_number"], "left").select(*PR, F.explode(F.array_compact(F.array(*labels))).alias("label"))
