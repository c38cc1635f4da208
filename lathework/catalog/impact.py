"""Queries of the joins between change sets, packages, owners, threads and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog.analytics import REVIEWS, SINCE, reviews
from lathework.catalog.diffs import FILES, pr_files
from lathework.catalog.registry import query
from lathework.functions.globs import path_regex
from lathework.operators import diff as D
from lathework.operators import impact as I
from lathework.operators import labels as L
from lathework.plans.tables import table


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "f1_overlapping_changes",
    f"""WITH f AS {FILES} SELECT a.repo_full_name, a.filename, a.pr_number AS pr_a, b.pr_number AS pr_b, max(a.additions + a.deletions) + max(b.additions + b.deletions) AS volume,
          CASE WHEN volume > 100 THEN 'high' WHEN volume > 30 THEN 'medium' ELSE 'low' END AS risk
        FROM f a JOIN f b ON a.repo_full_name = b.repo_full_name AND a.filename = b.filename AND a.pr_number <> b.pr_number WHERE a.file_id % 10 = 0 GROUP BY 1, 2, 3, 4""",
)
def f1_overlapping_changes(spark: SparkSession, directory: str) -> DataFrame:
    """The current changes are those whose id is divisible by 10, against all."""
    files = pr_files(spark, directory)
    return I.overlapping_changes(files.filter("file_id % 10 = 0"), files)


#: Configuration tables, as a monorepo declares them.
PACKAGES = [("core", "core"), ("core-fable", "core/fable"), ("web", "web"), ("assets", "web/assets"), ("lib", "lib"), ("services", "services"), ("docs", "docs"), ("config", "config")]
DEPENDS = [("web", "core"), ("services", "core"), ("services", "lib"), ("docs", "web"), ("lib", "core"), ("core", "lib"), ("assets", "web")]


@query(
    "f2_owning_package",
    f"""SELECT file_id, min_by(package, ord) AS package FROM {FILES} LEFT JOIN (VALUES {", ".join(f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate(PACKAGES))}) AS p(ord, package, path)
        ON starts_with(filename, path || '/') GROUP BY 1""",
)
def f2_owning_package(spark: SparkSession, directory: str) -> DataFrame:
    packages = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(PACKAGES)], "ord int, package string, path string")
    return I.owning_package(pr_files(spark, directory), packages)


_CLOSURE = f"""WITH RECURSIVE edges(src, dst) AS (VALUES {", ".join(f"('{b}', '{a}')" for a, b in DEPENDS)}),
  reach(start, node) AS (SELECT src, dst FROM edges UNION SELECT start, dst FROM reach JOIN edges ON node = src)"""


@query("f3_downstream_packages", f"{_CLOSURE} SELECT start, node FROM reach WHERE start <> node")
def f3_downstream_packages(spark: SparkSession, directory: str) -> DataFrame:
    """Everything that depends on a package, over any number of steps and around cycles."""
    return I.reachable(spark.createDataFrame([(b, a) for a, b in DEPENDS], "src string, dst string"))


GLOBS = [("client", "src/**/*.ts"), ("client", "web/**"), ("reports", "db/**/*.sql"), ("reports", "**/*.sql"), ("infra", "deploy/*.yaml"), ("infra", "charts/**")]


@query(
    "f4_cross_repository_impact",
    f"""SELECT repo_full_name, pr_number, head_sha, dependent, string_agg(DISTINCT pattern, ',' ORDER BY pattern) AS patterns, count(DISTINCT filename) AS files
        FROM {FILES}, (VALUES {", ".join(f"('{r}', '{p}', {_q(path_regex(p))})" for r, p in GLOBS)}) AS d(dependent, pattern, regex) WHERE regexp_matches(filename, regex) GROUP BY 1, 2, 3, 4""",
)
def f4_cross_repository_impact(spark: SparkSession, directory: str) -> DataFrame:
    return I.glob_impacts(pr_files(spark, directory), GLOBS)


OWNERS = """# who looks after what
*            @core-team
docs/        @writers  docs@x/y
*.py         @snakes

web/         @web @design
/web/assets/ @nobody
config/*     @ops
Makefile
db/dump      @data"""


@query(
    "f6_parse_owners",
    r"""WITH lines AS (SELECT nth AS ord, trim(line) AS line FROM (SELECT unnest(string_split(""" + _q(OWNERS) + r""", chr(10))) AS line, generate_subscripts(string_split(""" + _q(OWNERS) + r""", chr(10)), 1) AS nth)),
        words AS (SELECT ord, list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '') AS w FROM lines WHERE line <> '' AND line NOT LIKE '#%')
        SELECT ord::INT AS ord, w[1] AS pattern, array_to_string(list_transform(list_filter(w[2:], lambda x: x LIKE '@%' OR contains(x, '/')), lambda x: ltrim(x, '@')), ',') AS owners FROM words WHERE len(list_filter(w[2:], lambda x: x LIKE '@%' OR contains(x, '/'))) > 0""",
)
def f6_parse_owners(spark: SparkSession, directory: str) -> DataFrame:
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(OWNERS.split("\n"), 1)], "ord int, line string")
    return I.parse_owners(lines).select("ord", "pattern", F.array_join("owners", ",").alias("owners"))


RULES = [("*", ["core-team"]), ("docs/", ["writers"]), ("*.py", ["snakes"]), ("web/", ["web", "design"]), ("config/*", ["ops"]), ("db/dump", ["data"])]
_RULE = "CASE WHEN filename = 'db/dump' OR starts_with(filename, 'db/dump/') OR ends_with(filename, '/db/dump') THEN ['data'] WHEN filename GLOB 'config/*' OR '/' || filename GLOB 'config/*' THEN ['ops'] WHEN starts_with(filename, 'web/') THEN ['web', 'design'] WHEN filename GLOB '*.py' THEN ['snakes'] WHEN starts_with(filename, 'docs/') THEN ['writers'] ELSE ['core-team'] END"


@query(
    "f5_reviewers",
    f"""WITH owned AS (SELECT repo_full_name, pr_number, head_sha, filename, CASE WHEN contains(filename, '/') THEN split_part(filename, '/', 1) END AS top, {_RULE} AS owners FROM {FILES}),
          by_rule AS (SELECT repo_full_name, pr_number, head_sha, filename, top, unnest(owners) AS owner FROM owned),
          points AS (SELECT repo_full_name, pr_number, head_sha, owner, count(*) * 10 AS points FROM by_rule GROUP BY 1, 2, 3, 4
            UNION ALL SELECT t.repo_full_name, t.pr_number, t.head_sha, owner, sum(n) * 3 FROM (SELECT DISTINCT repo_full_name, pr_number, head_sha, owner, top FROM by_rule WHERE top IS NOT NULL) t
              JOIN (SELECT repo_full_name, pr_number, head_sha, top, count(*) AS n FROM owned WHERE top IS NOT NULL GROUP BY 1, 2, 3, 4) s USING (repo_full_name, pr_number, head_sha, top) GROUP BY 1, 2, 3, 4)
        SELECT repo_full_name, pr_number, head_sha, owner, least(sum(points), 100)::BIGINT AS score FROM points GROUP BY 1, 2, 3, 4
        QUALIFY row_number() OVER (PARTITION BY repo_full_name, pr_number, head_sha ORDER BY sum(points) DESC, owner) <= 5""",
)
def f5_reviewers(spark: SparkSession, directory: str) -> DataFrame:
    return I.owner_scores(pr_files(spark, directory), RULES)


@query(
    "f7_threads",
    "SELECT repo_full_name, pr_number, min_by(doc_id, (created_at, doc_id)) AS root, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY created_at, doc_id)) AS ids, count(*) AS n FROM documents WHERE pr_number IS NOT NULL GROUP BY 1, 2",
)
def f7_threads(spark: SparkSession, directory: str) -> DataFrame:
    """The messages of a pull request in order of time, under the first."""
    rows = table(spark, directory, "documents").filter("pr_number IS NOT NULL").select("repo_full_name", "pr_number", "created_at", "doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    return rows.groupBy("repo_full_name", "pr_number").agg(F.min_by("doc_id", F.struct("created_at", "doc_id")).alias("root"), F.md5(F.array_join(ordered, ",")).alias("ids"), F.count(F.lit(1)).alias("n"))


@query(
    "f8_reply_outcomes",
    f"SELECT repo_full_name, pr_number, count(*) AS n, bool_or(coalesce(regexp_matches(text, {_q(I.DISAGREES)}), false)) AS disagrees, max_by(doc_id, (created_at, doc_id)) AS last_doc FROM documents WHERE pr_number IS NOT NULL AND source = 'chat_reply' GROUP BY 1, 2",
)
def f8_reply_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    return I.reply_outcomes(table(spark, directory, "documents").filter("pr_number IS NOT NULL AND source = 'chat_reply'"))


@query(
    "f9_mentioned_files",
    r"""SELECT doc_id, path, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '`([\w./-]+\.\w+)`', 1)) AS path FROM documents WHERE source IN ('review_comment', 'review_summary')) GROUP BY 1, 2""",
)
def f9_mentioned_files(spark: SparkSession, directory: str) -> DataFrame:
    """Files that comments and summaries mention, by text."""
    rows = table(spark, directory, "documents").filter("source IN ('review_comment', 'review_summary')")
    return rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"`([\w./-]+\.\w+)`"), F.lit(1))).alias("path")).groupBy("doc_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f10_feedback_of_period",
    f"""SELECT source, count(*) AS n FROM documents d WHERE pr_number IS NOT NULL AND EXISTS (SELECT 1 FROM repositories p JOIN {REVIEWS} r ON r.repository_id = p.id
          WHERE p.github_full_name = d.repo_full_name AND r.pr_number = d.pr_number AND r.created_at >= TIMESTAMP '{SINCE}') GROUP BY 1""",
)
def f10_feedback_of_period(spark: SparkSession, directory: str) -> DataFrame:
    """Messages on pull requests that were reviewed in the period: semi joins only."""
    recent = reviews(spark, directory).filter(F.col("created_at") >= F.lit(SINCE).cast("timestamp")).select("repository_id", "pr_number")
    names = table(spark, directory, "repositories").select(F.col("id").alias("repository_id"), F.col("github_full_name").alias("repo_full_name"))
    keys = recent.join(names, "repository_id").select("repo_full_name", "pr_number")
    return table(spark, directory, "documents").join(keys, ["repo_full_name", "pr_number"], "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f11_calls_by_branch",
    f"SELECT default_branch, count(*) AS n, sum(tool_calls_count)::BIGINT AS calls FROM (SELECT DISTINCT review_id, repository_id, tool_calls_count FROM review_state) s JOIN repositories p ON s.repository_id = p.id GROUP BY 1",
)
def f11_calls_by_branch(spark: SparkSession, directory: str) -> DataFrame:
    states = table(spark, directory, "review_state").select("review_id", "repository_id", "tool_calls_count").dropDuplicates(["review_id"])
    names = table(spark, directory, "repositories").select(F.col("id").alias("repository_id"), "default_branch")
    return states.join(names, "repository_id").groupBy("default_branch").agg(F.count(F.lit(1)).alias("n"), F.sum("tool_calls_count").alias("calls"))


_COMMENTS = "(SELECT sample_id AS key, nth AS comment_id, f.line_hint AS line, f.type || ' ' || f.severity || ' ' || f.pattern AS body, f.severity AS severity FROM (SELECT DISTINCT sample_id, expected_findings FROM samples), unnest(expected_findings) WITH ORDINALITY AS u(f, nth) WHERE f.line_hint IS NOT NULL)"


def _comments(spark: SparkSession, directory: str) -> DataFrame:
    samples = table(spark, directory, "samples").dropDuplicates(["sample_id"]).select("sample_id", F.posexplode("expected_findings").alias("nth", "f"))
    return samples.filter("f.line_hint IS NOT NULL").select(F.col("sample_id").alias("key"), (F.col("nth") + 1).cast("bigint").alias("comment_id"), (F.col("nth") + 1).alias("ord"), F.col("f.line_hint").alias("line"), F.concat_ws(" ", "f.type", "f.severity", "f.pattern").alias("body"), "f.severity")


_OVERLAPS = f"""c AS (SELECT key, comment_id, line, list_distinct(regexp_split_to_array(lower(body), '\\s+')) AS w, length(body) AS size, severity FROM {_COMMENTS}),
  o AS (SELECT a.key, a.comment_id AS a, b.comment_id AS b FROM c a JOIN c b ON a.key = b.key AND a.comment_id < b.comment_id AND abs(a.line - b.line) <= 3
        WHERE len(list_intersect(a.w, b.w)) > 0.3 * len(list_distinct(list_concat(a.w, b.w))))"""


@query("f12_overlapping_comments", f"WITH {_OVERLAPS} SELECT key, a, b FROM o")
def f12_overlapping_comments(spark: SparkSession, directory: str) -> DataFrame:
    return I.comment_overlaps(_comments(spark, directory))


@query(
    "f13_merged_comments",
    f"""WITH RECURSIVE {_OVERLAPS}, reach AS (SELECT key, comment_id, comment_id AS via FROM c UNION SELECT r.key, r.comment_id, o.a FROM reach r JOIN o ON o.key = r.key AND o.b = r.via),
          g AS (SELECT key, comment_id, min(via) AS first_id FROM reach GROUP BY 1, 2)
        SELECT key, first_id, count(*) AS members, min_by(comment_id, (-size, comment_id)) AS comment_id,
          min_by(severity, (CASE severity WHEN 'critical' THEN 1 WHEN 'warning' THEN 2 WHEN 'suggestion' THEN 3 WHEN 'info' THEN 4 ELSE 5 END, comment_id)) AS severity,
          round(count(*) / 2, 6) AS confidence, count(*) >= 2 AS in_majority, count(*) >= 2 AS in_all FROM c JOIN g USING (key, comment_id) GROUP BY 1, 2""",
)
def f13_merged_comments(spark: SparkSession, directory: str) -> DataFrame:
    """First-fit grouping in input order, with what each strategy keeps."""
    return I.merge_comments(_comments(spark, directory))


@query("f14_totals", f"SELECT repository_id, sum(total_cost_usd)::DECIMAL(20,6) AS cost, max(duration_ms) AS longest_ms, min(CASE risk_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END) AS worst FROM {REVIEWS} WHERE repository_id IS NOT NULL GROUP BY 1")
def f14_totals(spark: SparkSession, directory: str) -> DataFrame:
    worst = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).when(F.col("risk_level") == "low", 2)
    return reviews(spark, directory).filter("repository_id IS NOT NULL").groupBy("repository_id").agg(F.sum("total_cost_usd").cast("decimal(20,6)").alias("cost"), F.max("duration_ms").alias("longest_ms"), F.min(worst).alias("worst"))


@query("e2_size_labels", f"SELECT repo_full_name, pr_number, head_sha, {L.size_sql('sum(additions + deletions)')} AS label FROM {FILES} GROUP BY 1, 2, 3")
def e2_size_labels(spark: SparkSession, directory: str) -> DataFrame:
    return L.size_labels(pr_files(spark, directory))


@query(
    "e3_type_labels",
    f"""SELECT DISTINCT review_id, label FROM review_state, (VALUES {", ".join(f"({_q(n)}, {_q(p)})" for p, n in L.TYPES)}) AS t(label, pattern) WHERE regexp_matches(coalesce(pr_title, 'None') || ' ' || coalesce(pr_body, ''), pattern, 'i')""",
)
def e3_type_labels(spark: SparkSession, directory: str) -> DataFrame:
    return L.type_labels(table(spark, directory, "review_state").dropDuplicates(["review_id"]), "review_id", "pr_title", "pr_body")


@query(
    "e4_area_labels",
    f"""SELECT repo_full_name, pr_number, head_sha, label, min_by(filename, (file_ord, file_id)) AS filename FROM {FILES}, (VALUES {", ".join(f"({_q(n)}, {_q(p)})" for p, n in L.AREAS)}) AS t(label, pattern)
        WHERE regexp_matches(filename, pattern, 'i') GROUP BY 1, 2, 3, 4""",
)
def e4_area_labels(spark: SparkSession, directory: str) -> DataFrame:
    return L.area_labels(pr_files(spark, directory))


_SPECIAL = f"""special AS (SELECT repo_full_name, pr_number, head_sha, unnest(list_filter([CASE WHEN large THEN 'needs-careful-review' END, CASE WHEN migrates THEN 'has-migration' END, CASE WHEN breaking THEN 'breaking-change' END], lambda x: x IS NOT NULL)) AS label
  FROM (SELECT repo_full_name, pr_number, head_sha, sum(additions + deletions) > 500 AS large, bool_or(contains(lower(filename), 'migration')) AS migrates FROM {FILES} GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT repo_full_name, pr_number, bool_or(coalesce(regexp_matches(pr_title, '\\b(?:breaking|BREAKING)\\b'), false)) AS breaking FROM review_state GROUP BY 1, 2) USING (repo_full_name, pr_number))"""


@query("e5_special_labels", f"WITH {_SPECIAL} SELECT * FROM special")
def e5_special_labels(spark: SparkSession, directory: str) -> DataFrame:
    return L.special_labels(pr_files(spark, directory), table(spark, directory, "review_state"))


_TYPED = f"""typed AS (SELECT DISTINCT f.repo_full_name, f.pr_number, f.head_sha, label FROM (SELECT DISTINCT repo_full_name, pr_number, head_sha FROM {FILES}) f JOIN review_state s USING (repo_full_name, pr_number), (VALUES {", ".join(f"({_q(n)}, {_q(p)})" for p, n in L.TYPES)}) AS t(label, pattern)
  WHERE regexp_matches(coalesce(s.pr_title, 'None') || ' ' || coalesce(s.pr_body, ''), pattern, 'i'))"""


@query(
    "e6_all_labels",
    f"""WITH {_SPECIAL}, {_TYPED} SELECT repo_full_name, pr_number, head_sha, count(DISTINCT label) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
          SELECT repo_full_name, pr_number, head_sha, label FROM {FILES}, (VALUES {', '.join(f'({_q(n)}, {_q(p)})' for p, n in L.AREAS)}) AS t(label, pattern) WHERE regexp_matches(filename, pattern, 'i')
          UNION ALL SELECT repo_full_name, pr_number, head_sha, {L.size_sql('sum(additions + deletions)')} FROM {FILES} GROUP BY 1, 2, 3
          UNION ALL SELECT * FROM typed UNION ALL SELECT * FROM special) GROUP BY 1, 2, 3""",
)
def e6_all_labels(spark: SparkSession, directory: str) -> DataFrame:
    """Labels of sizes, areas, types and special conditions, each name once."""
    files, states = pr_files(spark, directory), table(spark, directory, "review_state")
    types = L.type_labels(states.dropDuplicates(["review_id"]), "review_id", "pr_title", "pr_body").join(states.select("review_id", "repo_full_name", "pr_number").distinct(), "review_id")
    typed = files.select(*D.PR).distinct().join(types, ["repo_full_name", "pr_number"]).select(*D.PR, "label")
    every = L.area_labels(files).select(*D.PR, "label").unionByName(L.size_labels(files)).unionByName(typed).unionByName(L.special_labels(files, states))
    return every.groupBy(*D.PR).agg(F.count_distinct("label").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def _points_sql(value: str, component: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} > {bound} THEN {points}" for bound, points in L.POINTS[component]) + " ELSE 0 END"


_FAMILY = "CASE " + " ".join(f"WHEN ends_with(filename, '{end}') THEN '{name}'" for name, ends in L.FAMILIES.items() for end in ends) + " END"
_SENSITIVE = "(" + " OR ".join(f"contains(lower(filename), {_q(x.lower())})" for x in L.SENSITIVE) + ")"
_RISKY = "coalesce(" + " OR ".join(f"regexp_matches(patch, {_q(p)}, 'i')" for p in L.RISKY_TEXT) + ", false)"
_FOLD = f"""fold AS (SELECT repo_full_name, pr_number, head_sha, list_reduce(list({_SENSITIVE}::INT + 2 * ({_RISKY})::INT ORDER BY file_ord, file_id),
  lambda a, x: CASE WHEN x >= 2 THEN least(CASE WHEN x = 3 THEN least(a + 3, 10) ELSE a END + 5, 15) WHEN x = 1 THEN least(a + 3, 10) ELSE a END, 0) AS risk FROM {FILES} GROUP BY 1, 2, 3)"""


@query("e1_risk_fold", f"WITH {_FOLD} SELECT * FROM fold")
def e1_risk_fold(spark: SparkSession, directory: str) -> DataFrame:
    """A clamped sum over the files of a pull request in their order, which a plain sum cannot give."""
    return L.risk_fold(pr_files(spark, directory))


@query(
    "e1_change_scores",
    f"""WITH {_FOLD}, sums AS (SELECT repo_full_name, pr_number, head_sha, sum(additions + deletions) AS changed, count(*) AS files, count(DISTINCT {_FAMILY}) AS families,
            count(DISTINCT CASE WHEN len(string_split(filename, '/')) > 2 THEN split_part(filename, '/', 1) || '/' || split_part(filename, '/', 2) WHEN contains(filename, '/') THEN split_part(filename, '/', 1) END) AS folders,
            sum(deletions) / nullif(sum(additions), 0) AS ratio, max(additions + deletions) AS largest FROM {FILES} GROUP BY 1, 2, 3),
          points AS (SELECT repo_full_name, pr_number, head_sha, {_points_sql('changed', 'size')} AS size, {_points_sql('files', 'spread')} AS spread, {_points_sql('families', 'languages')} AS languages, {_points_sql('folders', 'coupling')} AS coupling,
            {_points_sql('ratio', 'churn')} AS churn, {_points_sql('largest', 'concentration')} AS concentration FROM sums)
        SELECT *, least(size + spread + languages + coupling + churn + concentration + risk, 100) AS score, CASE {" ".join(f"WHEN score > {bound} THEN '{name}'" for bound, name in L.LEVELS)} ELSE 'trivial' END AS level FROM points JOIN fold USING (repo_full_name, pr_number, head_sha)""",
)
def e1_change_scores(spark: SparkSession, directory: str) -> DataFrame:
    """All components of a change's score."""
    return L.change_scores(pr_files(spark, directory))
