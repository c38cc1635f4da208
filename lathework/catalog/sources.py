"""Queries of payloads, logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog.analytics import REVIEWS, reviews
from lathework.catalog.diffs import FILES, LANGUAGE, NEW_SIDE, pr_files
from lathework.catalog.registry import query
from lathework.catalog.scans import SAFE_SECURITY, _RULES, _values
from lathework.operators import diff as D
from lathework.operators import scan as S
from lathework.sources import exports as X
from lathework.sources import logs as G
from lathework.sources import payloads as A
from lathework.plans.tables import table


@query("a1_changed_files", "SELECT review_id, u.nth::INT AS nth, f.filename AS filename, f.status AS status, f.additions AS additions, f.deletions AS deletions FROM (SELECT DISTINCT review_id, changed_files FROM review_state), unnest(changed_files) WITH ORDINALITY AS u(f, nth)")
def a1_changed_files(spark: SparkSession, directory: str) -> DataFrame:
    states = table(spark, directory, "review_state").dropDuplicates(["review_id"])
    return A.page_rows(states, "review_id", "changed_files")


def _count_sql(mark: str) -> str:
    return f"greatest((length(diff) - length(replace(diff, chr(10) || '{mark}', ''))) // 2 - (length(diff) - length(replace(diff, chr(10) || '{mark * 3}', ''))) // 4, 0)"


@query("a2_counted_lines", f"SELECT DISTINCT sample_id, {_count_sql('+')}::INT AS additions, {_count_sql('-')}::INT AS deletions FROM samples WHERE diff IS NOT NULL")
def a2_counted_lines(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "samples").filter("diff IS NOT NULL").dropDuplicates(["sample_id"])
    return rows.select("sample_id", A.counted_lines(F.col("diff"), "+").alias("additions"), A.counted_lines(F.col("diff"), "-").alias("deletions"))


_PATCHES = """lines AS (SELECT review_id, u.pos, u.line FROM (SELECT DISTINCT review_id, pr_diff FROM review_state) s, unnest(string_split(pr_diff, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE pr_diff <> ''),
  blocks AS (SELECT *, sum((line LIKE 'diff --git%')::INT) OVER (PARTITION BY review_id ORDER BY pos) AS block FROM lines),
  named AS (SELECT *, max(CASE WHEN line LIKE 'diff --git%' AND contains(line, ' b/') THEN substr(line, strpos(line, ' b/') + 3) END) OVER (PARTITION BY review_id, block) AS path, max((line LIKE '@@%')::INT) OVER (PARTITION BY review_id, block ORDER BY pos) AS seen FROM blocks WHERE block > 0),
  patches AS (SELECT review_id, path, string_agg(line, chr(10) ORDER BY pos) AS patch FROM named WHERE path <> '' AND seen = 1 AND line NOT LIKE 'diff --git%' GROUP BY review_id, path, block QUALIFY row_number() OVER (PARTITION BY review_id, path ORDER BY block DESC) = 1)"""


@query("a3_files_with_patches", f"WITH {_PATCHES}, f AS (SELECT DISTINCT review_id, f.filename AS filename FROM review_state, unnest(changed_files) AS u(f)) SELECT f.review_id, f.filename, md5(coalesce(patch, '')) AS patch_md5 FROM f LEFT JOIN patches p ON f.review_id = p.review_id AND f.filename = p.path")
def a3_files_with_patches(spark: SparkSession, directory: str) -> DataFrame:
    states = table(spark, directory, "review_state").dropDuplicates(["review_id"])
    stats = A.page_rows(states, "review_id", "changed_files").select("review_id", "filename").distinct()
    patches = D.split_files(states, "review_id", "pr_diff", from_hunk=True)
    return A.with_patches(stats, patches, "review_id").select("review_id", "filename", F.md5("patch").alias("patch_md5"))


@query("a4_assembled_diffs", f"SELECT repo_full_name, pr_number, head_sha, md5(string_agg('diff --git a/' || filename || ' b/' || filename || chr(10) || patch, chr(10) ORDER BY file_ord, file_id)) AS diff_md5 FROM {FILES} WHERE patch <> '' GROUP BY 1, 2, 3")
def a4_assembled_diffs(spark: SparkSession, directory: str) -> DataFrame:
    return A.assembled(pr_files(spark, directory), D.PR).select(*D.PR, F.md5("diff").alias("diff_md5"))


@query("a5_numstat", f"SELECT file_id, CASE WHEN coalesce(patch, '') = '' THEN 0 ELSE additions END AS additions, CASE WHEN coalesce(patch, '') = '' THEN 0 ELSE deletions END AS deletions, filename FROM {FILES}")
def a5_numstat(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of additions, deletions and name (dashes for files without text), written and parsed."""
    files = pr_files(spark, directory)
    number = lambda c: F.when(F.coalesce("patch", F.lit("")) == "", "-").otherwise(F.col(c).cast("string"))
    lines = files.select("file_id", F.concat_ws("\t", number("additions"), number("deletions"), "filename").alias("line"))
    return A.parsed_numstat(lines, "line")


@query("a13_last_days", f"SELECT id, strftime(created_at, '%Y-%m-%d') AS day, duration_ms FROM {REVIEWS} WHERE strftime(created_at, '%Y-%m-%d') IN (SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS d FROM reviews ORDER BY d DESC LIMIT 5)")
def a13_last_days(spark: SparkSession, directory: str) -> DataFrame:
    """Reviews logged as JSON lines by day, and the last five days read back."""
    path = G.shared_path(spark, "review-log")
    G.write_by_day(reviews(spark, directory).select("id", "created_at", "duration_ms"), "created_at", path)
    return G.read_last_days(spark, path, "id string, duration_ms int, day string", 5).select("id", "day", "duration_ms")


@query("a11_newest_log_rows", f"SELECT id FROM {REVIEWS} ORDER BY created_at DESC, id LIMIT 500")
def a11_newest_log_rows(spark: SparkSession, directory: str) -> DataFrame:
    """A log keeps its newest 500 rows; the limit is the feature."""
    return reviews(spark, directory).select("created_at", "id").orderBy(F.desc("created_at"), "id").limit(500).select("id")


_FOUND = f"""WITH {NEW_SIDE}, named AS (SELECT file_id, language, is_test FROM {LANGUAGE}), lines AS (SELECT * FROM new_side JOIN named USING (file_id)),
  found AS (SELECT repo_full_name, pr_number, head_sha, filename AS path, line_no AS line, rule_id, severity FROM lines, {_RULES.format(_values(SAFE_SECURITY))}
            WHERE NOT is_test AND (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern, 'i'))"""


def _found(spark: SparkSession, directory: str) -> DataFrame:
    hits = S.security_findings(D.new_side(pr_files(spark, directory)), SAFE_SECURITY)
    return hits.select(*D.PR, F.col("filename").alias("path"), F.col("line_no").alias("line"), "rule_id", "severity")


@query(
    "a16_json_export",
    f"""{_FOUND} SELECT repo_full_name, pr_number, head_sha, count(*) AS comments, count(*) FILTER (severity = 'critical') AS critical FROM found GROUP BY 1, 2, 3""",
)
def a16_json_export(spark: SparkSession, directory: str) -> DataFrame:
    """Documents are written and parsed back."""
    parsed = F.from_json("json", "comments array<struct<path string, line int, rule_id string, severity string>>, stats map<string, bigint>")
    back = X.json_documents(_found(spark, directory), D.PR).select(*D.PR, parsed.alias("d"))
    return back.select(*D.PR, F.size("d.comments").cast("bigint").alias("comments"), F.coalesce(F.col("d.stats")["critical"], F.lit(0)).alias("critical"))


@query("a17_sarif_export")
def a17_sarif_export(spark: SparkSession, directory: str) -> DataFrame:
    return X.sarif_documents(_found(spark, directory), D.PR)


@query(
    "a18_csv_export",
    f"""SELECT id, repository_id, pr_number, pr_classification, risk_level, status, duration_ms, regexp_replace(coalesce(summary, ''), '[\r\n]+', ' ', 'g') AS summary, printf('%.4f', round_even(total_cost_usd, 4)::DOUBLE) AS total_cost_usd FROM {REVIEWS}""",
)
def a18_csv_export(spark: SparkSession, directory: str) -> DataFrame:
    """Nine columns as they go into a CSV file."""
    rows = reviews(spark, directory).select("id", "repository_id", "pr_number", "pr_classification", "risk_level", "status", "duration_ms", "summary", "total_cost_usd")
    return X.csv_rows(rows, "summary", "total_cost_usd")


@query(
    "a19_markdown_export",
    f"""{_FOUND}, items AS (SELECT repo_full_name, pr_number, head_sha, path, count(*) AS n, string_agg('- **' || severity || '** line ' || line || ': ' || rule_id, chr(10) ORDER BY line, rule_id, severity) AS items FROM found GROUP BY 1, 2, 3, 4)
        SELECT repo_full_name, pr_number, head_sha, '# ' || sum(n)::BIGINT || ' findings' || chr(10) || chr(10) || string_agg('### ' || path || chr(10) || items, chr(10) || chr(10) ORDER BY path, items) AS markdown FROM items GROUP BY 1, 2, 3""",
)
def a19_markdown_export(spark: SparkSession, directory: str) -> DataFrame:
    return X.markdown_documents(_found(spark, directory), D.PR)


@query(
    "a21_golden_set",
    """SELECT s.review_id, c.comments, md5(substr(s.pr_diff, 1, 50000)) AS diff_md5 FROM (SELECT DISTINCT review_id, repo_full_name, pr_number, pr_diff FROM review_state) s
       JOIN (SELECT repo_full_name, pr_number, count(*) AS comments FROM documents WHERE NOT coalesce(author LIKE '%[bot]', false) AND text <> '' AND pr_number IS NOT NULL GROUP BY 1, 2) c USING (repo_full_name, pr_number)""",
)
def a21_golden_set(spark: SparkSession, directory: str) -> DataFrame:
    states = table(spark, directory, "review_state").dropDuplicates(["review_id"])
    golden = A.golden_set(states.select("review_id", "repo_full_name", "pr_number"), table(spark, directory, "documents").filter("pr_number IS NOT NULL"), states.select("review_id", "pr_diff"))
    return golden.select("review_id", "comments", F.md5("diff").alias("diff_md5"))


@query(
    "a23_check_runs",
    f"""{_FOUND} SELECT repo_full_name, pr_number, head_sha, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity IN ('warning', 'medium')) AS warnings, least(count(*), 50)::INT AS annotations,
          CASE WHEN critical > 0 THEN 'failure' WHEN warnings > 3 THEN 'neutral' ELSE 'success' END AS conclusion FROM found GROUP BY 1, 2, 3""",
)
def a23_check_runs(spark: SparkSession, directory: str) -> DataFrame:
    """At most 50 annotations are sent with a run; the limit is the feature."""
    runs = X.check_runs(_found(spark, directory), D.PR)
    return runs.select(*D.PR, "critical", "warnings", F.size("annotations").alias("annotations"), "conclusion")
