"""Queries of the scanners and structural analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog import examples
from lathework.catalog.diffs import BOTH_SIDES, FILES, LANGUAGE, NEW_SIDE, pr_files
from lathework.catalog.registry import query
from lathework.functions.globs import matches_path
from lathework.functions.rules import MIGRATION, PERFORMANCE, SECURITY
from lathework.operators import diff as D
from lathework.operators import paths as P
from lathework.operators import scan as S
from lathework.operators import structure as T
from lathework.plans.lineage import cut
from lathework.plans.tables import table

#: Rules whose patterns RE2 cannot read; they have queries of their own, without SQL.
NOT_RE2 = {"SEC010", "SEC042", "SEC071", "PERF005", "PERF009", "MIG005", "MIG006", "MIG012"}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rules: list[S.Rule]) -> str:
    return ", ".join(f"({i}, {_q(r[0])}, {_q(r[1])}, {_q(r[2])}, [{', '.join(map(_q, r[3]))}]::VARCHAR[], {_q(r[4])})" for i, r in enumerate(rules))


_RULES = "(VALUES {}) AS r(rule_ord, rule_id, severity, category, languages, pattern)"
_LINES = f"WITH {NEW_SIDE}, named AS (SELECT file_id, language, is_test FROM {LANGUAGE}), lines AS (SELECT * FROM new_side JOIN named USING (file_id))"

SAFE_SECURITY = [r for r in SECURITY if r[0] not in NOT_RE2]
SAFE_MIGRATION = [r for r in MIGRATION if r[0] not in NOT_RE2]
SAFE_PERFORMANCE = [r for r in PERFORMANCE if r[0] not in NOT_RE2 | S.DISABLED]


#: Changed files and the example change set.
ALL_FILES = f"({FILES[1:-1]} UNION ALL {examples.SQL})"


def _with_examples(sql: str) -> str:
    return sql.replace(FILES, ALL_FILES)


def all_files(spark: SparkSession, directory: str) -> DataFrame:
    return pr_files(spark, directory).select(*[c.split()[0] for c in examples.SCHEMA.split(", ")]).unionByName(examples.example_files(spark))


def new_lines(spark: SparkSession, directory: str) -> DataFrame:
    return D.new_side(pr_files(spark, directory))


def all_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of the changed files and of the example change set."""
    return D.new_side(all_files(spark, directory))


@query(
    "d1_security_scan",
    f"""{_LINES} SELECT file_id, line_no, rule_id, severity, category, substr(regexp_extract(text, r.pattern, 0, 'i'), 1, 100) AS matched,
          CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS severity_rank
        FROM lines, {_RULES.format(_values(SAFE_SECURITY))} WHERE NOT is_test AND (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern, 'i')""",
)
def d1_security_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = S.security_findings(new_lines(spark, directory), SAFE_SECURITY)
    return found.select("file_id", "line_no", "rule_id", "severity", "category", "matched", "severity_rank")


@query("d1_lookaround_rules")
def d1_lookaround_rules(spark: SparkSession, directory: str) -> DataFrame:
    """The rules of the scanners that RE2 cannot read."""
    lines = new_lines(spark, directory)
    security = S.security_findings(lines, [r for r in SECURITY if r[0] in NOT_RE2]).select("file_id", "line_no", "rule_id", "matched")
    migration = S.migration_findings(lines, [r for r in MIGRATION if r[0] in NOT_RE2]).select("file_id", "line_no", "rule_id", "matched")
    performance = S.performance_findings(lines, [r for r in PERFORMANCE if r[0] in NOT_RE2]).select("file_id", "line_no", "rule_id", "matched")
    return security.unionByName(migration).unionByName(performance)


def _performance_sql() -> str:
    rules = [(r[0], r[1], r[2], r[3], S.REWRITTEN.get(r[0], r[4])) for r in SAFE_PERFORMANCE]
    test = " OR ".join(f"contains(lower(filename), {_q(m)})" for m in S.PERFORMANCE_TEST_MARKS)
    return f"""{_LINES}, ready AS (SELECT * FROM lines WHERE NOT ({test})),
      blocks AS (SELECT file_id, language, string_agg(text, chr(10) ORDER BY line_no) AS block, list(line_no ORDER BY line_no) AS numbers FROM ready GROUP BY 1, 2),
      rules AS (SELECT * REPLACE ('(?im)' || pattern AS pattern) FROM {_RULES.format(_values(rules))}),
      single AS (SELECT file_id, rule_id, min_by(line_no, first_position) AS line_no FROM ready, rules WHERE (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, pattern) GROUP BY 1, 2),
      multi AS (SELECT file_id, rule_id, block, numbers, regexp_extract(block, pattern, 0) AS hit FROM blocks, rules
                WHERE (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(block, pattern) AND (file_id, rule_id) NOT IN (SELECT (file_id, rule_id) FROM single))
      SELECT file_id, rule_id, line_no FROM single
      UNION ALL SELECT file_id, rule_id, coalesce(numbers[len(string_split(substr(block, 1, strpos(block, hit) - 1), chr(10)))], numbers[1]) FROM multi"""


@query("d2_performance_scan", _with_examples(_performance_sql()))
def d2_performance_scan(spark: SparkSession, directory: str) -> DataFrame:
    return S.performance_findings(all_lines(spark, directory), SAFE_PERFORMANCE).select("file_id", "rule_id", "line_no")


_MIGRATION_FILE = "(" + " OR ".join(f"contains(lower(filename), {_q(m)})" for m in P.MIGRATION_MARKS) + " OR ends_with(lower(filename), '.sql'))"


@query(
    "d3_migration_scan",
    f"""{_with_examples(_LINES)} SELECT file_id, line_no, rule_id, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 200) AS matched
        FROM lines, {_RULES.format(_values(SAFE_MIGRATION))} WHERE {_MIGRATION_FILE} AND regexp_matches(text, r.pattern, 'i')""",
)
def d3_migration_scan(spark: SparkSession, directory: str) -> DataFrame:
    return S.migration_findings(all_lines(spark, directory), SAFE_MIGRATION).select("file_id", "line_no", "rule_id", "matched")


#: Rules as a user writes them; letter case counts.
USER_RULES: list[S.Rule] = [
    ("no-print", "warning", "user", ("python",), r"\bprint\("),
    ("todo", "info", "user", (), r"(?:TODO|FIXME)\b"),
    ("logger", "info", "user", (), r"logger?\.(?:info|debug)\("),
    ("raise", "suggestion", "user", ("python",), r"raise \w+Error"),
    ("throw", "suggestion", "user", (), r"throw new \w+\("),
]


@query(
    "d4_user_rules",
    f"""{_LINES} SELECT file_id, line_no, rule_id, regexp_extract(text, r.pattern, 0) AS matched FROM lines, {_RULES.format(_values(USER_RULES))}
        WHERE regexp_full_match(filename, '(?:src|app|core|lib|services)/.*') AND NOT regexp_full_match(filename, '.*vendor/.*') AND (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern)""",
)
def d4_user_rules(spark: SparkSession, directory: str) -> DataFrame:
    name = F.col("filename")
    lines = new_lines(spark, directory).filter(matches_path(name, ["src/**", "app/**", "core/**", "lib/**", "services/**"]) & ~matches_path(name, ["**/vendor/**"]))
    hits = S.scan_lines(lines.withColumn("language", P.language(name)), USER_RULES, flags="(?d)", most=1000)
    return hits.select("file_id", "line_no", "rule_id", "matched")


@query(
    "d5_missing_companions",
    f"""SELECT repo_full_name, pr_number, head_sha, min_by(filename, (file_ord, file_id)) FILTER (regexp_full_match(filename, 'src/.*')) AS filename FROM {FILES} GROUP BY 1, 2, 3
        HAVING bool_or(regexp_full_match(filename, 'src/.*')) AND NOT bool_or(regexp_full_match(filename, 'docs/.*'))""",
)
def d5_missing_companions(spark: SparkSession, directory: str) -> DataFrame:
    """Pull requests that touch sources and no docs."""
    name = F.col("filename")
    return S.files_without_companions(pr_files(spark, directory), D.PR, matches_path(name, ["src/**"]), matches_path(name, ["docs/**"]))


@query(
    "d6_all_user_rules",
    f"""{_LINES} SELECT rule_id, count(*) AS n FROM lines, {_RULES.format(_values(USER_RULES))} WHERE (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern) GROUP BY 1
        UNION ALL SELECT 'needs-docs', count(*) FROM (SELECT 1 FROM {FILES} GROUP BY repo_full_name, pr_number, head_sha HAVING bool_or(regexp_full_match(filename, 'src/.*')) AND NOT bool_or(regexp_full_match(filename, 'docs/.*')))""",
)
def d6_all_user_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Pattern rules and file rules together, counted."""
    name = F.col("filename")
    hits = S.scan_lines(new_lines(spark, directory).withColumn("language", P.language(name)), USER_RULES, flags="(?d)").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    files = S.files_without_companions(pr_files(spark, directory), D.PR, matches_path(name, ["src/**"]), matches_path(name, ["docs/**"]))
    return hits.unionByName(files.agg(F.count(F.lit(1)).alias("n")).select(F.lit("needs-docs").alias("rule_id"), "n"))


_CLONES = f"""WITH {NEW_SIDE},
  clean AS (SELECT file_id, repo_full_name, pr_number, head_sha, file_ord, filename, line_no,
              regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '//.*$', ''), '#.*$', ''), '\\s+', ' ', 'g') AS clean FROM new_side),
  framed AS (SELECT *, count(*) OVER w AS n, sum((length(clean) >= 10)::INT) OVER w AS long, md5(array_to_string(list(clean) OVER w, chr(10))) AS key FROM clean
             WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
  windows AS (SELECT file_id, repo_full_name, pr_number, head_sha, file_ord, filename, key, min(line_no) AS line_no FROM framed WHERE n = 4 AND long >= 2 GROUP BY ALL)"""


@query("d8_fingerprints", f"{_CLONES} SELECT file_id, key, line_no FROM windows")
def d8_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    return T.clone_windows(new_lines(spark, directory)).select("file_id", "key", "line_no")


@query(
    "d7_clones",
    f"""{_with_examples(_CLONES)} SELECT a.file_id AS file_a, b.file_id AS file_b, a.filename AS path_a, a.line_no AS line_a, b.filename AS path_b, b.line_no AS line_b
        FROM windows a JOIN windows b USING (repo_full_name, pr_number, head_sha, key) WHERE (a.file_ord, a.file_id) < (b.file_ord, b.file_id)
        QUALIFY row_number() OVER (PARTITION BY a.file_id, b.file_id ORDER BY a.line_no, b.line_no, key) <= 3""",
)
def d7_clones(spark: SparkSession, directory: str) -> DataFrame:
    return T.clones(T.clone_windows(all_lines(spark, directory)))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"

_IMPORTS = f"""{_LINES},
  py AS (SELECT file_id, line_no, {_STRIP.format('unnest(string_split(coalesce(nullif(regexp_extract(bare, $p$^from\\s+[\\w.]+\\s+import\\s+(.+)$$p$, 1), $e$$e$), nullif(regexp_extract(bare, $p$^import\\s+(.+)$$p$, 1), $e$$e$)), $c$,$c$))')} AS part
         FROM (SELECT *, {_STRIP.format('text')} AS bare FROM lines WHERE language = 'python')),
  py_names AS (SELECT file_id, line_no, {_STRIP.format("CASE WHEN contains(part, ' as ') THEN string_split(part, ' as ')[-1] ELSE string_split(part, '.')[-1] END")} AS name FROM py),
  js AS (SELECT file_id, line_no, {_STRIP.format("unnest(string_split(nullif(regexp_extract(text, 'import\\s+\\{([^}]+)\\}', 1), ''), ','))")} AS part FROM lines WHERE language IN ('javascript', 'typescript')
         UNION ALL SELECT file_id, line_no, nullif(regexp_extract(text, 'import\\s+(\\w+)\\s+from', 1), '') FROM lines WHERE language IN ('javascript', 'typescript')),
  js_names AS (SELECT file_id, line_no, {_STRIP.format("CASE WHEN contains(part, ' as ') THEN string_split(part, ' as ')[-1] ELSE part END")} AS name FROM js),
  names AS (SELECT DISTINCT * FROM (SELECT * FROM py_names WHERE NOT starts_with(name, '_') UNION ALL SELECT * FROM js_names) WHERE regexp_full_match(name, '\\w+'))"""


@query(
    "d9_unused_imports",
    f"""{_IMPORTS} SELECT file_id, line_no, name FROM names n WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.file_id = n.file_id AND l.line_no <> n.line_no AND regexp_matches(l.text, '\\b' || n.name || '\\b'))""",
)
def d9_unused_imports(spark: SparkSession, directory: str) -> DataFrame:
    return T.unused_imports(new_lines(spark, directory))


@query(
    "d10_unreachable",
    f"""{_with_examples(_LINES)}, ordered AS (SELECT file_id, line_no, text, row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS nth FROM lines WHERE language IN ('python', 'javascript', 'typescript', 'go')),
        next AS (SELECT *, lead(text) OVER w AS follows, lead(nth) OVER w - nth AS gap FROM ordered WHERE regexp_matches(text, '\\S') WINDOW w AS (PARTITION BY file_id ORDER BY line_no))
        SELECT file_id, line_no FROM next WHERE regexp_matches(text, '(?:return|throw|raise|panic|os\\.Exit)\\s*(?:\\(.*\\))?\\s*;?\\s*$')
          AND (regexp_matches(follows, '^\\s+\\w') OR (gap > 1 AND regexp_matches(follows, '^\\s*\\w')))""",
)
def d10_unreachable(spark: SparkSession, directory: str) -> DataFrame:
    return T.unreachable(all_lines(spark, directory))


def _broken_sql() -> str:
    bare = _STRIP.format("text")
    kinds = [*[("endpoint_removed", f"regexp_extract(text, {_q(p)}, 1)") for p in T.ENDPOINTS], ("function_removed", f"regexp_extract({bare}, {_q(T.FUNCTION)}, 1)"), ("class_removed", f"regexp_extract({bare}, {_q(T.CLASS)}, 1)"), ("export_removed", f"regexp_extract({bare}, {_q(T.EXPORT)}, 1)"), ("function_removed", f"regexp_extract({bare}, {_q(T.GO_EXPORTED)}, 1)")]
    declared = " UNION ALL ".join(f"SELECT file_id, line_no, {i} AS how, '{k}' AS kind, {e} AS name FROM both_sides WHERE side = 'removed'" for i, (k, e) in enumerate(kinds))
    return f"""WITH {BOTH_SIDES}, declared AS ({declared})
      SELECT file_id, kind, line_no, name FROM declared d WHERE name <> '' AND NOT (how IN (3, 4) AND starts_with(name, '_'))
        AND NOT EXISTS (SELECT 1 FROM both_sides a WHERE a.file_id = d.file_id AND a.side = 'added' AND CASE WHEN kind = 'endpoint_removed' THEN contains(a.text, name)
          WHEN kind = 'export_removed' THEN regexp_matches(a.text, 'export\\b.*\\b' || name || '\\b') ELSE regexp_matches(a.text, '\\b' || name || '\\b') END)"""


@query("d11_broken_interfaces", _broken_sql())
def d11_broken_interfaces(spark: SparkSession, directory: str) -> DataFrame:
    return T.broken_interfaces(D.both_sides(pr_files(spark, directory)))


def _undocumented_sql() -> str:
    cases = " ".join(f"WHEN language = '{lang}' AND regexp_matches(text, {_q(p)}) THEN {{'kind': '{k}', 'name': regexp_extract(text, {_q(p)}, 1)}}" for lang, ps in T.PUBLIC.items() for p, k in ps)
    docs = " OR ".join(f"(language = '{lang}' AND (coalesce(regexp_matches(one, {_q(p)}), false) OR coalesce(regexp_matches(two, {_q(p)}), false)))" for lang, p in T.DOCUMENTED.items())
    test = " OR ".join(f"contains(lower(filename), {_q(m)})" for m in T.DOC_TEST_MARKS)
    return f"""{_LINES}, near AS (SELECT file_id, line_no, language, text, lag(text, 1) OVER w AS one, lag(text, 2) OVER w AS two FROM (SELECT * REPLACE ({_STRIP.format('text')} AS text) FROM lines WHERE NOT ({test}))
        WINDOW w AS (PARTITION BY file_id ORDER BY line_no)), found AS (SELECT *, CASE {cases} END AS f FROM near)
      SELECT file_id, line_no, f.kind AS kind, f.name AS name FROM found WHERE f IS NOT NULL AND NOT ({docs})"""


@query("d12_undocumented", _undocumented_sql())
def d12_undocumented(spark: SparkSession, directory: str) -> DataFrame:
    return T.undocumented(new_lines(spark, directory))


def _metrics_sql() -> str:
    head = "CASE " + " ".join(f"WHEN language = '{lang}' THEN regexp_matches(bare, {_q(p)})" for lang, p in T.HEAD.items()) + " END"
    branch = "CASE " + " ".join(f"WHEN language = '{lang}' THEN len(regexp_extract_all(text, {_q(p)}))" for lang, p in T.BRANCH.items()) + " END"
    return f"""{_LINES}, ready AS (SELECT *, {_STRIP.format('text')} AS bare FROM lines WHERE language IN ({', '.join(map(_q, T.HEAD))})),
      blocks AS (SELECT *, sum(({head})::INT) OVER (PARTITION BY file_id ORDER BY line_no) AS block, {branch} AS branches FROM ready)
      SELECT file_id, min(line_no) AS start_line, count(*) AS loc, (1 + sum(branches))::INT AS cyclomatic FROM blocks WHERE block > 0 GROUP BY file_id, block"""


@query("d14_cyclomatic", _metrics_sql())
def d14_cyclomatic(spark: SparkSession, directory: str) -> DataFrame:
    return T.function_metrics(new_lines(spark, directory)).select("file_id", "start_line", "loc", "cyclomatic")


def _all_metrics_sql() -> str:
    of = lambda make: "CASE " + " ".join(f"WHEN language = '{lang}' THEN {make(lang, p)}" for lang, p in T.HEAD.items()) + " END"
    script = ("javascript", "typescript")
    group = lambda p, g: f"regexp_extract(bare, {_q(p)}, {g})"
    head = of(lambda lang, p: f"regexp_matches(bare, {_q(p)})")
    name = of(lambda lang, p: f"{group(p, 1)} || {group(p, 2)}" if lang in script else group(p, 1))
    given = of(lambda lang, p: group(p, 3 if lang in script else 2))
    branch = "CASE " + " ".join(f"WHEN language = '{lang}' THEN len(regexp_extract_all(text, {_q(p)}))" for lang, p in T.BRANCH.items()) + " END"
    return f"""{_LINES}, ready AS (SELECT *, {_STRIP.format('text')} AS bare FROM lines WHERE language IN ({', '.join(map(_q, T.HEAD))})),
      blocks AS (SELECT *, sum(({head})::INT) OVER (PARTITION BY file_id ORDER BY line_no) AS block, {branch} AS branches, {name} AS name, {given} AS given, regexp_matches(bare, {_q(T.DEEPER)})::BIGINT AS deeper, regexp_matches(bare, {_q(T.SHALLOWER)})::BIGINT AS shallower FROM ready),
      grouped AS (SELECT file_id, min(line_no) AS start_line, min_by(name, line_no) AS name, min_by(given, line_no) AS given, count(*) AS loc, (1 + sum(branches))::INT AS cyclomatic,
        list_reduce(list({{'level': deeper, 'total': branches::BIGINT, 'deepest': shallower}} ORDER BY line_no), lambda a, x: {{'level': greatest(0, a.level + x.level - x.deepest), 'total': a.total + x.total * (1 + greatest(0, a.level + x.level - x.deepest)), 'deepest': greatest(a.deepest, a.level + x.level)}},
          {{'level': 0::BIGINT, 'total': 0::BIGINT, 'deepest': 0::BIGINT}}) AS fold FROM blocks WHERE block > 0 GROUP BY file_id, block)
      SELECT file_id, start_line, name, loc, cyclomatic, fold.total AS cognitive, fold.deepest AS depth, len(list_filter(string_split(given, ','), lambda p: {_STRIP.format('p')} NOT IN ('', 'self', 'cls'))) AS parameters FROM grouped"""


@query("d13_function_metrics", _all_metrics_sql())
def d13_function_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """All metrics of every function (D13, D15, D16), folds over ordered lines included."""
    return T.function_metrics(new_lines(spark, directory))


@query(
    "g14_metric_totals",
    f"SELECT count(*) AS functions, avg(cyclomatic) AS avg_cyclomatic, max(cyclomatic) AS max_cyclomatic FROM ({_metrics_sql()})",
)
def g14_metric_totals(spark: SparkSession, directory: str) -> DataFrame:
    return T.function_metrics(new_lines(spark, directory)).agg(F.count(F.lit(1)).alias("functions"), F.avg("cyclomatic").alias("avg_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"))


_LICENCE = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q(p.replace('(?id)', '(?i)'))}) THEN '{n}'" for n, p in T.LICENCES) + " END"
_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(upper(licence), {_q(x.upper())})" for x in parts) + f" THEN '{risk}'" for risk, _, parts in T.LICENCE_CLASSES) + " ELSE 'unknown' END"


@query("d17_licence_texts", f"SELECT doc_id, licence, {_CLASS} AS risk FROM (SELECT doc_id, {_LICENCE} AS licence FROM (SELECT doc_id, text FROM documents UNION ALL SELECT file_id, patch FROM ({examples.SQL}))) WHERE licence IS NOT NULL")
def d17_licence_texts(spark: SparkSession, directory: str) -> DataFrame:
    """Licence texts in documents and in the example patches, and their classes."""
    texts = table(spark, directory, "documents").select("doc_id", "text").unionByName(examples.example_files(spark).select(F.col("file_id").alias("doc_id"), F.col("patch").alias("text")))
    named = texts.select("doc_id", T.licence_of(F.col("text")).alias("licence")).filter("licence IS NOT NULL")
    return named.select("doc_id", "licence", T.licence_class(F.col("licence"))["risk"].alias("risk"))


def _licence_sql() -> str:
    fields = " UNION ALL ".join(f"SELECT file_id, line_no, coalesce({', '.join(f'nullif(regexp_extract(text, {_q(p)}, {g}), {_q(chr(0))[:1]}{chr(39)})' for g in groups)}) AS licence FROM lines WHERE ends_with(lower(filename), '{name}')" for name, p, groups in T.LICENCE_FIELDS)
    return f"""{_with_examples(_LINES)}, texts AS (SELECT file_id, min(line_no) AS line_no, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines WHERE contains(lower(filename), 'license') OR contains(lower(filename), 'copying') GROUP BY 1),
      licenced AS (SELECT file_id, line_no, {_LICENCE} AS licence FROM texts UNION ALL {fields})
      SELECT * FROM (SELECT file_id, line_no, licence, {_CLASS} AS risk FROM licenced WHERE licence IS NOT NULL) WHERE risk <> 'permissive'"""


@query("d17_licences", _licence_sql())
def d17_licences(spark: SparkSession, directory: str) -> DataFrame:
    """Licence files and licence fields of manifests that are not permissive."""
    return T.licence_findings(all_lines(spark, directory)).select("file_id", "line_no", "licence", "risk")


@query(
    "d18_licence_classes",
    f"SELECT licence, {_CLASS} AS risk FROM (VALUES {', '.join(f'({_q(x)})' for x in ['MIT', ' gpl-3.0-or-later ', 'LGPL-2.1', 'SSPL-1.0', 'CC-BY-NC-4.0', 'Proprietary', 'Apache-2.0 WITH LLVM', 'elastic-2.0', ''])}) AS l(licence)",
)
def d18_licence_classes(spark: SparkSession, directory: str) -> DataFrame:
    names = ["MIT", " gpl-3.0-or-later ", "LGPL-2.1", "SSPL-1.0", "CC-BY-NC-4.0", "Proprietary", "Apache-2.0 WITH LLVM", "elastic-2.0", ""]
    return spark.createDataFrame([(n,) for n in names], "licence string").select("licence", T.licence_class(F.col("licence"))["risk"].alias("risk"))


def _manifest_sql() -> str:
    ecosystem = "CASE regexp_extract(filename, '([^/]*)$', 1) " + " ".join(f"WHEN {_q(n)} THEN '{e}'" for n, e in T.MANIFESTS.items()) + " END"
    risky = ", ".join(f"({_q(p)}, '{'critical' if p in T.COMPROMISED else 'high'}')" for p in T.RISKY)
    pair = '"([^"]+)":\\s*"([^"]+)"'
    return f"""{_with_examples(_LINES)}, ready AS (SELECT *, {_STRIP.format('text')} AS bare, {ecosystem} AS ecosystem, regexp_extract({_STRIP.format('text')}, '{pair}', 1) AS name, regexp_extract({_STRIP.format('text')}, '{pair}', 2) AS version FROM lines)
      SELECT file_id, line_no, 'risky' AS kind, package, severity FROM ready, (VALUES {risky}) AS r(package, severity) WHERE ecosystem IS NOT NULL AND contains(lower(bare), lower(package))
      UNION ALL SELECT file_id, line_no, 'unpinned', name, 'high' FROM ready WHERE ecosystem = 'npm' AND version IN ('*', 'latest')
      UNION ALL SELECT file_id, line_no, 'risky', name, 'medium' FROM ready WHERE ecosystem = 'npm' AND name <> '' AND regexp_matches(version, '^(?:git|http|file:|github:)')
      UNION ALL SELECT file_id, line_no, 'unpinned', regexp_extract(bare, '^([\\w-]+)\\s*$', 1), 'medium' FROM ready WHERE ecosystem = 'pip' AND regexp_matches(filename, '\\.(?:txt|cfg)$') AND regexp_matches(bare, '^([\\w-]+)\\s*$')
      UNION ALL SELECT NULL, 0, 'excessive', repo_full_name || '#' || pr_number || ': ' || count(*) || ' packages', 'medium' FROM ready
        WHERE (ecosystem = 'npm' AND name <> '') OR (ecosystem = 'pip' AND regexp_matches(filename, '\\.(?:txt|cfg)$') AND regexp_matches(bare, '^([\\w-]+)\\s*([><=!~]+.+)?$')) GROUP BY repo_full_name, pr_number, head_sha HAVING count(*) > 5"""


@query("d19_dependencies", _manifest_sql())
def d19_dependencies(spark: SparkSession, directory: str) -> DataFrame:
    """Risky and open dependencies, and a row for a pull request that adds more than five."""
    lines = all_lines(spark, directory)
    many = T.many_dependencies(lines)
    named = F.concat("repo_full_name", F.lit("#"), F.col("pr_number").cast("string"), F.lit(": "), F.col("dependencies").cast("string"), F.lit(" packages"))
    excessive = many.select(F.lit(None).cast("bigint").alias("file_id"), F.lit(0).alias("line_no"), F.lit("excessive").alias("kind"), named.alias("package"), F.lit("medium").alias("severity"))
    return T.dependency_findings(lines).unionByName(excessive)


def _remapped(severity: str, worse: str, other: str) -> str:
    return f"CASE WHEN {severity} IN ('critical', 'high') THEN '{worse}' ELSE '{other}' END"


_D20 = f"""WITH main AS ({_with_examples(_LINES)} SELECT file_id, line_no, 0 AS source_ord, rule_id, severity, true AS is_main FROM lines, {_RULES.format(_values(USER_RULES))} WHERE (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern)),
  security AS ({_with_examples(_LINES)} SELECT file_id, line_no, 1 AS source_ord, rule_id, {_remapped('severity', 'critical', 'warning')} AS severity, false AS is_main FROM lines, {_RULES.format(_values(SAFE_SECURITY))} WHERE NOT is_test AND (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern, 'i')),
  performance AS (SELECT file_id, line_no, 2 AS source_ord, rule_id, {_remapped('r.severity', 'warning', 'suggestion')} AS severity, false AS is_main FROM ({_with_examples(_performance_sql())}) JOIN {_RULES.format(_values(SAFE_PERFORMANCE))} USING (rule_id)),
  migration AS ({_with_examples(_LINES)} SELECT file_id, line_no, 3 AS source_ord, rule_id, {_remapped('severity', 'critical', 'warning')} AS severity, false AS is_main FROM lines, {_RULES.format(_values(SAFE_MIGRATION))} WHERE {_MIGRATION_FILE} AND regexp_matches(text, r.pattern, 'i')),
  dependency AS (SELECT file_id, line_no, 4 AS source_ord, kind || ':' || package AS rule_id, {_remapped('severity', 'warning', 'suggestion')} AS severity, false AS is_main FROM ({_manifest_sql()}) WHERE line_no > 0)"""


def _merged(spark: SparkSession, directory: str, security: list[S.Rule], performance: list[S.Rule], migration: list[S.Rule]) -> DataFrame:
    # read by five branches, so it is written down
    lines = cut(all_lines(spark, directory))
    mild = F.col("severity").isin("critical", "high")

    def take(hits: DataFrame, source: int, severity: Column) -> DataFrame:
        return hits.select("file_id", "line_no", F.lit(source).alias("source_ord"), "rule_id", severity.alias("severity"))

    named = T.dependency_findings(lines).withColumn("rule_id", F.concat_ws(":", "kind", "package"))
    main = take(S.scan_lines(lines.withColumn("language", P.language(F.col("filename"))), USER_RULES, flags="(?d)"), 0, F.col("severity"))
    blocking, advising = F.when(mild, "critical").otherwise("warning"), F.when(mild, "warning").otherwise("suggestion")
    scanners = (
        take(S.security_findings(lines, security), 1, blocking)
        .unionByName(take(S.performance_findings(lines, performance), 2, advising))
        .unionByName(take(S.migration_findings(lines, migration), 3, blocking))
        .unionByName(take(named.filter("line_no > 0"), 4, advising))
    )
    return S.merge_findings(main, scanners).select("file_id", "line_no", "rule_id", "severity", "is_main")


@query(
    "d20_merged_findings",
    f"""{_D20} SELECT file_id, line_no, rule_id, severity, is_main FROM (SELECT *, row_number() OVER (PARTITION BY file_id, line_no ORDER BY is_main DESC, source_ord, rule_id) AS nth
          FROM (SELECT * FROM main UNION ALL SELECT * FROM security UNION ALL SELECT * FROM performance UNION ALL SELECT * FROM migration UNION ALL SELECT * FROM dependency)) WHERE is_main OR nth = 1""",
)
def d20_merged_findings(spark: SparkSession, directory: str) -> DataFrame:
    """User rules and the security, performance, migration and dependency scanners in one list, with the rules that SQL can read."""
    return _merged(spark, directory, SAFE_SECURITY, SAFE_PERFORMANCE, SAFE_MIGRATION)


@query("d20_all_rules")
def d20_all_rules(spark: SparkSession, directory: str) -> DataFrame:
    """The same with every rule."""
    return _merged(spark, directory, SECURITY, PERFORMANCE, MIGRATION)


_HINTS = """hints AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY nth) AS nth, f.line_hint AS wanted FROM (SELECT DISTINCT sample_id, expected_findings FROM samples), unnest(expected_findings) WITH ORDINALITY AS u(f, nth) WHERE f.line_hint IS NOT NULL),
  lines AS (SELECT sample_id, u.nth AS line_no FROM (SELECT DISTINCT sample_id, diff FROM samples WHERE diff <> '') s, unnest(string_split(diff, chr(10))) WITH ORDINALITY AS u(line, nth) WHERE line LIKE '+%' AND line NOT LIKE '+++%')"""


@query(
    "d21_snapped_lines",
    f"""WITH {_HINTS} SELECT sample_id, nth::VARCHAR AS comment_id, wanted, min_by(line_no, (abs(line_no - wanted), line_no))::INT AS line_no FROM hints JOIN lines USING (sample_id) GROUP BY ALL""",
)
def d21_snapped_lines(spark: SparkSession, directory: str) -> DataFrame:
    """Expected findings moved to the nearest added line of their diff."""
    samples = table(spark, directory, "samples").dropDuplicates(["sample_id"])
    hints = samples.select("sample_id", F.posexplode("expected_findings").alias("nth", "f")).select("sample_id", (F.col("nth") + 1).alias("comment_id"), F.col("f.line_hint").alias("wanted")).filter("wanted IS NOT NULL")
    lines = D.raw_lines(samples, ["sample_id"], "diff").filter("line LIKE '+%' AND NOT line LIKE '+++%'").select("sample_id", F.col("pos").alias("line_no"))
    return S.snap_to_lines(hints, lines, "sample_id")


@query(
    "d22_blocked_patterns",
    f"""{_LINES} SELECT file_id, line_no, rule_id FROM lines, {_RULES.format(_values(USER_RULES))} WHERE (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern)
        QUALIFY row_number() OVER (PARTITION BY file_id, line_no ORDER BY rule_ord) = 1""",
)
def d22_blocked_patterns(spark: SparkSession, directory: str) -> DataFrame:
    lines = new_lines(spark, directory).withColumn("language", P.language(F.col("filename")))
    return S.first_rule_per_line(S.scan_lines(lines, USER_RULES, flags="(?d)")).select("file_id", "line_no", "rule_id")


@query(
    "c11_severity_threshold",
    f"""{_LINES} SELECT rule_id, count(*) AS n FROM lines, {_RULES.format(_values(USER_RULES))} WHERE severity IN ('critical', 'warning', 'suggestion') AND (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern) GROUP BY 1""",
)
def c11_severity_threshold(spark: SparkSession, directory: str) -> DataFrame:
    lines = new_lines(spark, directory).withColumn("language", P.language(F.col("filename")))
    return P.at_least(S.scan_lines(lines, USER_RULES, flags="(?d)"), "suggestion").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g11_finding_counts",
    f"""{_LINES} SELECT severity, category, count(*) AS n FROM lines, {_RULES.format(_values(SAFE_SECURITY))} WHERE NOT is_test AND (len(languages) = 0 OR list_contains(languages, language)) AND regexp_matches(text, r.pattern, 'i') GROUP BY 1, 2""",
)
def g11_finding_counts(spark: SparkSession, directory: str) -> DataFrame:
    return S.security_findings(new_lines(spark, directory), SAFE_SECURITY).groupBy("severity", "category").agg(F.count(F.lit(1)).alias("n"))
