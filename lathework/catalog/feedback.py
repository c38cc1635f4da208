"""Queries of answers: threads and outcomes of comments, repaired model comments, commands, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.catalog import examples
from lathework.catalog.diffs import FILES, NEW_SIDE, pr_files
from lathework.catalog.registry import query
from lathework.operators import diff as D
from lathework.operators import feedback as A
from lathework.plans.tables import table
from lathework.streaming import events as E

_q = examples.quoted

#: Messages of a pull request as comments: each answers the first review comment there; and the example comments.
_COMMENTS = f"""(SELECT d.doc_id AS comment_id, author, repo_full_name || '#' || pr_number AS path, coalesce(text, '') AS body,
    nullif(min(CASE WHEN source = 'review_comment' THEN doc_id END) OVER (PARTITION BY repo_full_name, pr_number), doc_id) AS reply_to, 0 AS likes, 0 AS dislikes
  FROM documents d WHERE pr_number IS NOT NULL UNION ALL SELECT -comment_id, author, path, body, -reply_to, likes, dislikes FROM ({examples.COMMENT_SQL}))"""


def _comments(spark: SparkSession, directory: str) -> DataFrame:
    rows = table(spark, directory, "documents").filter("pr_number IS NOT NULL")
    first = rows.filter("source = 'review_comment'").groupBy("repo_full_name", "pr_number").agg(F.min("doc_id").alias("first"))
    own = rows.join(first, ["repo_full_name", "pr_number"], "left").select(
        F.col("doc_id").alias("comment_id"), "author", F.concat("repo_full_name", F.lit("#"), F.col("pr_number").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("body"),
        F.nullif("first", F.col("doc_id")).alias("reply_to"), F.lit(0).alias("likes"), F.lit(0).alias("dislikes"),
    )
    return own.unionByName(examples.example_comments(spark).withColumns({"comment_id": -F.col("comment_id"), "reply_to": -F.col("reply_to")}))


@query("f7_reply_threads", f"SELECT coalesce(reply_to, comment_id) AS root, comment_id, row_number() OVER (PARTITION BY coalesce(reply_to, comment_id) ORDER BY comment_id) AS nth FROM {_COMMENTS}")
def f7_reply_threads(spark: SparkSession, directory: str) -> DataFrame:
    """Comments under the one they answer."""
    return A.threads(_comments(spark, directory))


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


_PROGRAM = f"(coalesce(ends_with(author, '[bot]'), false) OR {_any('body', [m for m, _ in A.MARKS])})"
_SEVERITY = "CASE " + " ".join(f"WHEN contains(body, {_q(m)}) THEN '{s}'" for m, s in A.MARKS) + " ELSE 'info' END"
_SUBJECT = "CASE " + " ".join(f"WHEN {_any('lower(body)', words)} THEN '{name}'" for name, words in A.SUBJECTS) + " ELSE 'general' END"
_OUTCOMES = f"""WITH c AS (SELECT * FROM {_COMMENTS}),
  replies AS (SELECT reply_to AS comment_id, bool_or({_any('lower(body)', A.DISAGREEMENT)}) AS disagrees, max_by(body, comment_id) AS reply FROM c WHERE reply_to IS NOT NULL AND NOT {_PROGRAM} GROUP BY 1),
  outcomes AS (SELECT comment_id, path, {_SEVERITY} AS severity, {_SUBJECT} AS subject, CASE WHEN dislikes > 0 OR coalesce(disagrees, false) THEN 'rejected' WHEN likes > 0 THEN 'accepted' END AS outcome, coalesce(substr(reply, 1, 200), '') AS reply
    FROM c LEFT JOIN replies USING (comment_id) WHERE {_PROGRAM})"""


@query("f8_feedback_outcomes", f"{_OUTCOMES} SELECT * FROM outcomes WHERE outcome IS NOT NULL")
def f8_feedback_outcomes(spark: SparkSession, directory: str) -> DataFrame:
    """Which comments of a program people accepted or rejected."""
    return A.outcomes(_comments(spark, directory))


@query("g1_precision", f"{_OUTCOMES} SELECT subject, count(*) AS n, round(100 * count(*) FILTER (outcome = 'accepted') / count(*), 1) AS precision_percent FROM outcomes WHERE outcome IS NOT NULL GROUP BY 1")
def g1_precision(spark: SparkSession, directory: str) -> DataFrame:
    """Share of accepted comments by subject."""
    found = A.outcomes(_comments(spark, directory)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "accepted").alias("accepted"))
    return found.select("subject", "n", F.round(100 * F.col("accepted") / F.col("n"), 1).alias("precision_percent"))


@query(
    "g12_acceptance",
    f"""{_OUTCOMES} SELECT field, value, count(*) AS n, round(count(*) FILTER (outcome = 'accepted') / count(*), 6) AS acceptance FROM (SELECT outcome, unnest([{{'field': 'severity', 'value': severity}}, {{'field': 'subject', 'value': subject}}, {{'field': 'outcome', 'value': outcome}}], recursive := true)
        FROM outcomes WHERE outcome IS NOT NULL) WHERE value <> '' GROUP BY 1, 2""",
)
def g12_acceptance(spark: SparkSession, directory: str) -> DataFrame:
    """Feedback by each field's values, and the share that was accepted."""
    return A.acceptance(A.outcomes(_comments(spark, directory)), ["severity", "subject", "outcome"])


@query(
    "g13_low_value_share",
    f"""{_OUTCOMES} SELECT count(*) FILTER (outcome = 'rejected') AS rejected, count(*) FILTER (outcome = 'rejected' AND severity IN ('info', 'suggestion')) AS minor, minor > 0.5 * rejected AS low_value FROM outcomes""",
)
def g13_low_value_share(spark: SparkSession, directory: str) -> DataFrame:
    """Whether more than half of the rejected comments were of the mildest severities."""
    return A.low_value(A.outcomes(_comments(spark, directory)))


@query("l3_subjects", f"SELECT {_SUBJECT} AS subject, {_SEVERITY} AS severity, count(*) AS n FROM {_COMMENTS} WHERE {_PROGRAM} OR reply_to IS NULL GROUP BY 1, 2")
def l3_subjects(spark: SparkSession, directory: str) -> DataFrame:
    """Subjects and severities of comments by a program and of those that start a thread."""
    rows = _comments(spark, directory).filter(A.by_program(F.col("author"), F.col("body")) | F.col("reply_to").isNull())
    return rows.groupBy(A.subject(F.col("body")).alias("subject"), A.marked_severity(F.col("body")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


#: What models answered: JSON, JSON inside text, and no JSON.
ANSWERS = [
    (-1, 'Here is my review:\n{"summary": "Fine", "risk_level": "low", "category": "bugfix", "comments": [{"path": "a.py", "line": 3, "body": "x"}]}\nBye.'),
    (-2, '{"summary": "Two", "comments": [{"path": "b.py", "line": 1, "body": "y"}, {"path": "", "body": "z"}], "labels": []}'),
    (-3, "I could not look at the diff {sorry}."),
    (-4, '{"risk_level": "high"}'),
    (-5, '```json\n{"summary": "Fenced", "category": "feature"}\n```'),
    (-6, ""),
]
_ANSWERS = f"(SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(f'({i}, {_q(t)})' for i, t in ANSWERS)}) AS a(doc_id, text))"


@query(
    "n4_answers",
    f"""WITH found AS (SELECT doc_id, text, nullif(regexp_extract(text, '(?s)(\\{{.*\\}})', 1), '') AS j FROM {_ANSWERS}), read AS (SELECT doc_id, text, coalesce(json_valid(j), false) AS is_json, CASE WHEN json_valid(j) THEN j END AS j FROM found)
        SELECT doc_id, is_json, md5(CASE WHEN is_json THEN coalesce(json_extract_string(j, '$.summary'), '') ELSE substr(text, 1, 500) END) AS summary_md5, coalesce(json_extract_string(j, '$.risk_level'), 'medium') AS risk_level,
          coalesce(json_extract_string(j, '$.category'), 'other') AS category, coalesce(json_array_length(j, '$.comments'), 0)::INT AS comments FROM read""",
)
def n4_answers(spark: SparkSession, directory: str) -> DataFrame:
    """JSON read out of free text."""
    texts = table(spark, directory, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(ANSWERS, "doc_id bigint, text string"))
    return A.answers(texts, "doc_id", "text").select("doc_id", "is_json", F.md5("summary").alias("summary_md5"), "risk_level", "category", F.size("comments").alias("comments"))


_WRONG = "CASE file_id % 4 WHEN 0 THEN filename WHEN 1 THEN 'repo/' || filename WHEN 2 THEN regexp_replace(filename, '^[^/]*/', '') ELSE 'unknown/' || file_id || '.zz' END"


@query(
    "d21_repaired_comments",
    f"""WITH {NEW_SIDE}, c AS (SELECT file_id AS comment_id, repo_full_name, pr_number, head_sha, {_WRONG} AS path, file_ord * 3 + 2 AS line, CASE WHEN file_id % 7 > 0 THEN 'look here' END AS body FROM {FILES}),
          valid AS (SELECT file_id, repo_full_name, pr_number, head_sha, file_ord, filename FROM {FILES} WHERE patch <> ''),
          placed AS (SELECT comment_id, line, valid.file_id FROM c JOIN valid USING (repo_full_name, pr_number, head_sha) WHERE body <> '' AND path <> '' AND (filename = path OR ends_with(filename, path) OR ends_with(path, filename))
            QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY (filename = path) DESC, file_ord, valid.file_id) = 1)
        SELECT comment_id::VARCHAR AS comment_id, p.file_id, line AS wanted, min_by(line_no, (abs(line_no - line), line_no))::INT AS line_no FROM placed p JOIN new_side n USING (file_id) GROUP BY ALL""",
)
def d21_repaired_comments(spark: SparkSession, directory: str) -> DataFrame:
    """A comment on every file, with right, longer, shorter and unknown paths, put right."""
    files = pr_files(spark, directory)
    wrong = F.expr(_WRONG.replace("'^[^/]*/'", "r'^[^/]*/'"))
    comments = files.select(*D.PR, F.col("file_id").alias("comment_id"), wrong.alias("path"), (F.col("file_ord") * 3 + 2).alias("line"), F.when(F.col("file_id") % 7 > 0, F.lit("look here")).alias("body"))
    valid = files.filter("patch <> ''").select(*D.PR, "file_id", "file_ord", "filename")
    found = A.repaired_comments(comments, valid, D.new_side(files).select("file_id", "line_no"), D.PR)
    return found.select("comment_id", "file_id", "wanted", "line_no")


_CASE = "CASE " + " ".join(f"WHEN starts_with(t, '/{c}') THEN '{c}'" for c in E.COMMANDS) + " END"
_SAID = [(-i, "ada" if i % 5 else "helper[bot]", text) for i, text in enumerate(["/fix", "  /review please", "/ask why?", "/generate-tests", "/describe", "\n/changelog", "/split it", "/approve", "/fixture", "say /fix", "/Fix", "/reviewer"], 1)]


@query(
    "l5_commands",
    f"""SELECT doc_id, CASE WHEN NOT coalesce(ends_with(author, '[bot]'), false) THEN {_CASE} END AS command FROM (SELECT doc_id, author, regexp_replace(text, '^\\s+', '') AS t FROM
        (SELECT doc_id, author, text FROM documents WHERE source IN ('review_comment', 'issue_comment', 'chat_reply') UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, {_q(a)}, {_q(t)})" for i, a, t in _SAID)}) AS s(doc_id, author, text)))""",
)
def l5_commands(spark: SparkSession, directory: str) -> DataFrame:
    """The command a comment gives, of eight in their order; a program gives none."""
    rows = table(spark, directory, "documents").filter("source IN ('review_comment', 'issue_comment', 'chat_reply')").select("doc_id", "author", "text")
    said = rows.unionByName(spark.createDataFrame(_SAID, "doc_id bigint, author string, text string"))
    person = ~F.coalesce(F.col("author").endswith("[bot]"), F.lit(False))
    return said.select("doc_id", F.when(person, E.commands(F.col("text"), E.COMMANDS)).alias("command"))


@query(
    "l10_deliveries",
    """SELECT id, least(fails + 1, 5)::INT AS attempts, CASE WHEN fails < 5 THEN 'delivered' ELSE 'dead_letter' END AS status, round(list_sum(list_transform(range(1, least(fails, 4) + 1), lambda k: least(2.0 * pow(2.0, k - 1), 20.0))), 3) AS waited
       FROM (SELECT DISTINCT id, pr_number % 8 AS fails FROM reviews)""",
)
def l10_deliveries(spark: SparkSession, directory: str) -> DataFrame:
    """Messages that fail a number of times: attempts, where they end, and how long they waited between attempts."""
    rows = table(spark, directory, "reviews").select("id", (F.col("pr_number") % 8).alias("fails")).distinct()
    return E.deliveries(rows, F.col("fails"), most_attempts=5, base=2.0, longest=20.0).select("id", "attempts", "status", F.round("waited", 3).alias("waited"))
