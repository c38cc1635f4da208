"""Queries over diffs: line maps, splits, combined texts, filters on paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog.registry import query
from lathework.functions.globs import matches_path, matches_shell
from lathework.operators import diff as D
from lathework.operators import paths as P
from lathework.plans.tables import table

#: Distinct files in SQL.
FILES = "(SELECT DISTINCT file_id, repo_full_name, pr_number, head_sha, file_ord, filename, status, additions, deletions, patch FROM pr_files)"

_KINDS = f"""
  kinds AS (
    SELECT f.*, CASE WHEN regexp_matches(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)') THEN 'hunk'
                     WHEN line LIKE '+%' AND line NOT LIKE '+++%' THEN 'added'
                     WHEN line LIKE '-%' AND line NOT LIKE '---%' THEN 'removed'
                     WHEN line LIKE '\\%' THEN 'note' ELSE 'context' END AS kind
    FROM (SELECT file_id, repo_full_name, pr_number, head_sha, file_ord, filename, status, u.pos, u.line
          FROM {FILES} f, unnest(string_split(f.patch, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE f.patch <> '') f),
  hunks AS (SELECT *, sum((kind = 'hunk')::INT) OVER (PARTITION BY file_id ORDER BY pos) AS hunk FROM kinds),
  numbered AS (SELECT *, coalesce(max(CASE WHEN kind = 'hunk' THEN regexp_extract(line, '^@@ -\\d+(?:,\\d+)? \\+(\\d+)', 1)::INT END) OVER (PARTITION BY file_id, hunk), 0)
                 + sum((kind IN ('added', 'context'))::INT) OVER (PARTITION BY file_id, hunk ORDER BY pos) - 1 AS line_no FROM hunks),
  shown AS (SELECT *, CASE WHEN kind = 'added' OR line LIKE ' %' THEN substr(line, 2) ELSE line END AS text,
              row_number() OVER (PARTITION BY file_id, line_no ORDER BY pos DESC) AS newest,
              min(pos) OVER (PARTITION BY file_id, line_no) AS first_position FROM numbered WHERE kind IN ('added', 'context')),
  new_side AS (SELECT file_id, repo_full_name, pr_number, head_sha, file_ord, filename, status, line_no::INT AS line_no, text, pos AS position, kind, first_position FROM shown WHERE newest = 1)
"""

#: The line table in SQL, for queries that build on it: WITH {NEW_SIDE} SELECT ... FROM new_side.
NEW_SIDE = _KINDS


def pr_files(spark: SparkSession, directory: str) -> DataFrame:
    return D.distinct_files(table(spark, directory, "pr_files"))


@query("b1_line_map", f"WITH {NEW_SIDE} SELECT file_id, line_no, text, first_position::INT AS first_position FROM new_side")
def b1_line_map(spark: SparkSession, directory: str) -> DataFrame:
    return D.new_side(pr_files(spark, directory)).select("file_id", "line_no", "text", "first_position")


@query("b2_position_map", f"WITH {NEW_SIDE} SELECT file_id, line_no, position::INT AS position FROM new_side")
def b2_position_map(spark: SparkSession, directory: str) -> DataFrame:
    return D.new_side(pr_files(spark, directory)).select("file_id", "line_no", "position")


def _split_sql(key: str, source: str, text: str, from_hunk: bool) -> str:
    lines = f"""lines AS (SELECT {key}, u.pos, u.line FROM (SELECT DISTINCT {key}, {text} FROM {source}) s, unnest(string_split({text}, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE {text} <> ''),
      blocks AS (SELECT *, sum((line LIKE 'diff --git%')::INT) OVER (PARTITION BY {key} ORDER BY pos) AS block FROM lines),
      named AS (SELECT *, max(CASE WHEN line LIKE 'diff --git%' AND contains(line, ' b/') THEN substr(line, strpos(line, ' b/') + 3) END) OVER (PARTITION BY {key}, block) AS path,
                  max((line LIKE '@@%')::INT) OVER (PARTITION BY {key}, block ORDER BY pos) AS seen FROM blocks WHERE block > 0),
      texts AS (SELECT {key}, path, block, string_agg(line, chr(10) ORDER BY pos) AS patch FROM named
                WHERE path <> '' {"AND seen = 1 AND line NOT LIKE 'diff --git%'" if from_hunk else ""} GROUP BY ALL)"""
    return f"WITH {lines} SELECT {key}, path, md5(patch) AS patch_md5 FROM texts QUALIFY row_number() OVER (PARTITION BY {key}, path ORDER BY block DESC) = 1"


@query("b3_split_files", _split_sql("review_id", "review_state", "pr_diff", False))
def b3_split_files(spark: SparkSession, directory: str) -> DataFrame:
    diffs = table(spark, directory, "review_state").select("review_id", "pr_diff").dropDuplicates(["review_id"])
    return D.split_files(diffs, "review_id", "pr_diff").select("review_id", "path", F.md5("patch").alias("patch_md5"))


@query("b4_split_patches", _split_sql("sample_id", "samples", "diff", True))
def b4_split_patches(spark: SparkSession, directory: str) -> DataFrame:
    diffs = table(spark, directory, "samples").select("sample_id", "diff").dropDuplicates(["sample_id"])
    return D.split_files(diffs, "sample_id", "diff", from_hunk=True).select("sample_id", "path", F.md5("patch").alias("patch_md5"))


_BOTH = f"""
  lines AS (SELECT file_id, u.pos, u.line, CASE WHEN line LIKE '@@%' THEN 'hunk' WHEN line LIKE '-%' AND line NOT LIKE '---%' THEN 'removed'
              WHEN line LIKE '+%' AND line NOT LIKE '+++%' THEN 'added' ELSE 'other' END AS kind
            FROM {FILES} f, unnest(string_split(f.patch, chr(10))) WITH ORDINALITY AS u(line, pos) WHERE f.patch <> ''),
  hunks AS (SELECT *, sum((kind = 'hunk')::INT) OVER (PARTITION BY file_id ORDER BY pos) AS hunk FROM lines),
  numbered AS (SELECT *,
      coalesce(max(CASE WHEN kind = 'hunk' THEN try_cast(regexp_extract(line, '@@ -(\\d+)', 1) AS INT) END) OVER w - 1, 0) + sum((kind IN ('removed', 'other'))::INT) OVER o AS old_no,
      coalesce(max(CASE WHEN kind = 'hunk' THEN try_cast(regexp_extract(line, '\\+(\\d+)', 1) AS INT) END) OVER w - 1, 0) + sum((kind IN ('added', 'other'))::INT) OVER o AS new_no
    FROM hunks WINDOW w AS (PARTITION BY file_id, hunk), o AS (PARTITION BY file_id, hunk ORDER BY pos)),
  sides AS (SELECT file_id, kind AS side, (CASE WHEN kind = 'removed' THEN old_no ELSE new_no END)::INT AS line_no, substr(line, 2) AS text, pos FROM numbered WHERE kind IN ('removed', 'added')),
  both_sides AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY file_id, side, line_no ORDER BY pos DESC) = 1)
"""
BOTH_SIDES = _BOTH


@query("b5_both_sides", f"WITH {_BOTH} SELECT file_id, side, line_no, text FROM both_sides")
def b5_both_sides(spark: SparkSession, directory: str) -> DataFrame:
    return D.both_sides(pr_files(spark, directory)).select("file_id", "side", "line_no", "text")


@query(
    "b6_identifiers",
    r"""WITH lines AS (SELECT review_id, unnest(string_split(pr_diff, chr(10))) AS line FROM review_state WHERE pr_diff <> ''),
        added AS (SELECT * FROM lines WHERE line LIKE '+%' AND line NOT LIKE '+++%'),
        both_kinds AS (SELECT review_id, regexp_extract(line, '^\+\s*(?:async\s+)?(?:def|class)\s+(\w+)', 1) AS identifier FROM added
                 UNION ALL SELECT review_id, regexp_extract(line, '^\+\s*(?:export\s+)?(?:function|const|let|var)\s+(\w+)', 1) FROM added)
        SELECT DISTINCT review_id, identifier FROM both_kinds WHERE identifier <> ''""",
)
def b6_identifiers(spark: SparkSession, directory: str) -> DataFrame:
    return D.added_identifiers(table(spark, directory, "review_state").select("review_id", "pr_diff"), "review_id", "pr_diff")


@query(
    "b7_combined_diff",
    f"""WITH parts AS (SELECT repo_full_name, pr_number, head_sha, file_ord, file_id,
            CASE status WHEN 'modified' THEN 0 WHEN 'added' THEN 1 WHEN 'renamed' THEN 2 WHEN 'removed' THEN 3 ELSE 4 END AS rank,
            '--- a/' || filename || chr(10) || '+++ b/' || filename || chr(10) || coalesce(patch, '') AS part FROM {FILES}),
          sized AS (SELECT *, row_number() OVER w AS nth, sum(length(part)) OVER w AS upto FROM parts WINDOW w AS (PARTITION BY repo_full_name, pr_number, head_sha ORDER BY rank, file_ord, file_id)),
          kept AS (SELECT *, min(CASE WHEN upto > 30000 THEN nth END) OVER (PARTITION BY repo_full_name, pr_number, head_sha) AS over_at FROM sized),
          shown AS (SELECT *, CASE WHEN upto <= 30000 THEN part WHEN nth = over_at AND 30000 - (upto - length(part)) > 200
                      THEN substr(part, 1, (30000 - (upto - length(part)))::INT) || chr(10) || '... (truncated)' END AS text FROM kept),
          texts AS (SELECT repo_full_name, pr_number, head_sha, string_agg(text, chr(10) || chr(10) ORDER BY nth) AS text, count(text) AS n_parts, count(*) AS n_files, max(over_at) AS over_at FROM shown GROUP BY 1, 2, 3)
        SELECT repo_full_name, pr_number, head_sha, n_parts, md5(CASE WHEN over_at IS NOT NULL THEN coalesce(text, '') || CASE WHEN n_parts > 0 THEN chr(10) || chr(10) ELSE '' END
            || chr(10) || '... and ' || (n_files - n_parts) || ' more files (truncated due to size)' ELSE text END) AS text_md5 FROM texts""",
)
def b7_combined_diff(spark: SparkSession, directory: str) -> DataFrame:
    return D.combined_diff(pr_files(spark, directory)).select(*D.PR, "n_parts", F.md5("text").alias("text_md5"))


@query(
    "b8_files_summary",
    f"""SELECT repo_full_name, pr_number, head_sha, string_agg('- ' || CASE status WHEN 'added' THEN '[NEW]' WHEN 'modified' THEN '[MOD]' WHEN 'removed' THEN '[DEL]' WHEN 'renamed' THEN '[REN]' ELSE '[FILE]' END
          || ' `' || filename || '` (+' || additions || '/-' || deletions || ')', chr(10) ORDER BY file_ord, file_id) AS summary FROM {FILES} GROUP BY 1, 2, 3""",
)
def b8_files_summary(spark: SparkSession, directory: str) -> DataFrame:
    return D.files_summary(pr_files(spark, directory))


def _glob_sql(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"{column} GLOB '{p}'" for p in patterns) + ")"


_KEPT = f"(SELECT * FROM {FILES} WHERE NOT {_glob_sql('filename', P.IGNORED)} AND patch <> '')"


@query(
    "b9_diff_stats",
    f"""WITH kept AS (SELECT repo_full_name, pr_number, head_sha, count(*) AS kept_files, sum(additions) AS additions, sum(deletions) AS deletions,
            string_agg(DISTINCT {"CASE lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in D.EXTENSION_LANGUAGE.items()) + " END"}, ',' ORDER BY {"CASE lower(regexp_extract(filename, '(\\.[^.]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in D.EXTENSION_LANGUAGE.items()) + " END"}) AS languages
          FROM {_KEPT} GROUP BY 1, 2, 3),
        everything AS (SELECT repo_full_name, pr_number, head_sha, count(*) AS total_files FROM {FILES} GROUP BY 1, 2, 3)
        SELECT repo_full_name, pr_number, head_sha, total_files, coalesce(kept_files, 0) AS kept_files, coalesce(additions, 0)::BIGINT AS additions, coalesce(deletions, 0)::BIGINT AS deletions,
          coalesce(languages, '') AS languages, coalesce(additions, 0) + coalesce(deletions, 0) > 500 AS is_large FROM everything LEFT JOIN kept USING (repo_full_name, pr_number, head_sha)""",
)
def b9_diff_stats(spark: SparkSession, directory: str) -> DataFrame:
    files = pr_files(spark, directory)
    return D.diff_stats(files, P.reviewable(files))


@query("c1_ignore_paths", f"SELECT file_id, filename FROM {_KEPT}")
def c1_ignore_paths(spark: SparkSession, directory: str) -> DataFrame:
    return P.reviewable(pr_files(spark, directory)).select("file_id", "filename")


@query(
    "c2_path_globs",
    rf"""SELECT file_id, regexp_full_match(filename, 'src/.*[^/]*\.py') AS src_python, regexp_full_match(filename, '[^/]*/[^/]*\.md') AS one_deep_docs,
            regexp_full_match(filename, 'config/[^/]*-[^/]*\.\{{toml,ini\}}') AS literal_braces FROM {FILES}""",
)
def c2_path_globs(spark: SparkSession, directory: str) -> DataFrame:
    name = F.col("filename")
    return pr_files(spark, directory).select(
        "file_id", matches_path(name, ["src/**/*.py"]).alias("src_python"), matches_path(name, ["*/*.md"]).alias("one_deep_docs"), matches_path(name, ["config/*-*.{toml,ini}"]).alias("literal_braces")
    )


@query(
    "c4_name_or_path_globs",
    f"SELECT file_id FROM {FILES} WHERE filename GLOB '*.md' OR regexp_extract(filename, '([^/]*)$', 1) GLOB 'test_*' OR filename GLOB 'docs/*'",
)
def c4_name_or_path_globs(spark: SparkSession, directory: str) -> DataFrame:
    patterns = ["*.md", "test_*", "docs/*"]
    name = F.col("filename")
    return pr_files(spark, directory).filter(matches_shell(name, patterns) | matches_shell(F.substring_index("filename", "/", -1), patterns)).select("file_id")


@query(
    "c6_ignored_titles",
    "SELECT review_id, pr_title FROM review_state WHERE contains(lower(pr_title), 'wip') OR contains(lower(pr_title), 'bump') OR contains(lower(pr_title), 'fix:')",
)
def c6_ignored_titles(spark: SparkSession, directory: str) -> DataFrame:
    return P.with_title_words(table(spark, directory, "review_state"), "pr_title", ["WIP", "Bump", "fix:"]).select("review_id", "pr_title")


def _language_sql(pairs: list[tuple[str, str]]) -> str:
    return "CASE WHEN base = 'dockerfile' OR base LIKE 'dockerfile.%' THEN 'docker' " + " ".join(f"WHEN ends_with(filename, '{e}') THEN '{lang}'" for e, lang in pairs) + " ELSE '' END"


#: ``file_id, filename, language, is_test`` in SQL.
LANGUAGE = f"(SELECT *, {_language_sql(P.LANGUAGES)} AS language, {' OR '.join(f'contains(lower(filename), {chr(39)}{t}{chr(39)})' for t in P.TEST_MARKS)} AS is_test FROM (SELECT *, lower(regexp_extract(filename, '([^/]*)$', 1)) AS base FROM {FILES}))"


@query("c7_language", f"SELECT file_id, language, is_test, {' OR '.join(f'contains(lower(filename), {chr(39)}{t}{chr(39)})' for t in P.MIGRATION_MARKS)} OR ends_with(lower(filename), '.sql') AS is_migration FROM {LANGUAGE}")
def c7_language(spark: SparkSession, directory: str) -> DataFrame:
    """Language, test and migration predicates."""
    name = F.col("filename")
    return pr_files(spark, directory).select("file_id", P.language(name).alias("language"), P.is_test(name).alias("is_test"), P.is_migration(name).alias("is_migration"))


@query(
    "c10_testable_files",
    f"""SELECT file_id, language FROM {LANGUAGE} WHERE status <> 'removed' AND NOT is_test AND language IN ('python', 'javascript', 'typescript', 'go', 'java')
          AND NOT (contains(filename, '__init__') OR contains(filename, 'config') OR contains(filename, '.min.'))""",
)
def c10_testable_files(spark: SparkSession, directory: str) -> DataFrame:
    return P.testable(pr_files(spark, directory), ["__init__", "config", ".min."], ["python", "javascript", "typescript", "go", "java"]).select("file_id", "language")


@query("c13_first_files", f"SELECT file_id FROM {_KEPT} QUALIFY row_number() OVER (PARTITION BY repo_full_name, pr_number, head_sha ORDER BY file_ord, file_id) <= 3")
def c13_first_files(spark: SparkSession, directory: str) -> DataFrame:
    """The feature is the limit: at most so many files of a pull request are reviewed."""
    return P.first_files(P.reviewable(pr_files(spark, directory)), 3).select("file_id")
