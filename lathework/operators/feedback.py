"""What people answer to review comments, and what a model's answer says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.scan import snap_to_lines

#: Marks of a comment that a program wrote, with the severity each stands for.
MARKS = [("[CRITICAL]", "critical"), ("[WARNING]", "warning"), ("[SUGGESTION]", "suggestion"), ("[INFO]", "info")]

#: Words by which a comment's subject is known, the first subject that fits, and words of disagreement.
SUBJECTS = [
    ("security", ["injection", "xss", "ssrf", "secret", "credential", "auth", "csrf"]),
    ("performance", ["n+1", "performance", "slow", "index", "cache", "memory", "leak"]),
    ("correctness", ["bug", "null", "none", "error", "exception", "race", "deadlock"]),
    ("design", ["coupling", "abstraction", "pattern", "refactor", "solid", "dry"]),
    ("testing", ["test", "coverage", "mock", "assert"]),
]
DISAGREEMENT = ["disagree", "don't think", "not necessary", "not needed", "won't fix", "by design", "intentional", "false positive", "this is fine", "already handled", "not an issue", "nit"]


def _has_any(text: Column, words: list[str]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | text.contains(word)
    return F.coalesce(test, F.lit(False))


def marked_severity(body: Column) -> Column:
    """The severity a comment's mark says; info without any."""
    return F.coalesce(*[F.when(body.contains(mark), severity) for mark, severity in MARKS], F.lit("info"))


def subject(body: Column) -> Column:
    """The first subject whose words the comment has, else general."""
    lower = F.lower(body)
    return F.coalesce(*[F.when(_has_any(lower, words), name) for name, words in SUBJECTS], F.lit("general"))


def by_program(author: Column, body: Column, name: str = "") -> Column:
    """Whether a comment comes from a program: its name, the ending of its name, or a mark in its text."""
    return F.coalesce(author.endswith("[bot]") | (author == name), F.lit(False)) | _has_any(body, [mark for mark, _ in MARKS])


def threads(comments: DataFrame) -> DataFrame:
    """``root, comment_id, nth``: the comments under the one they answer, in order of their ids; ``comments`` has ``comment_id, reply_to``."""
    rooted = comments.select(F.coalesce("reply_to", "comment_id").alias("root"), "comment_id")
    return rooted.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("comment_id")))


def outcomes(comments: DataFrame, name: str = "") -> DataFrame:
    """``comment_id, path, severity, subject, outcome, reply`` of a program's comments that people answered to.

    ``comments``: ``comment_id, author, path, body, reply_to, likes, dislikes``.
    Rejected when disliked or when a person's reply disagrees, which beats likes;
    accepted when liked; without a sign there is no row.  ``reply`` is the last
    one by a person.  Replies are combined on the map side.
    """
    program = by_program(F.col("author"), F.col("body"), name)
    replies = (
        comments.filter(F.col("reply_to").isNotNull() & ~program)
        .groupBy(F.col("reply_to").alias("comment_id"))
        .agg(F.bool_or(_has_any(F.lower("body"), DISAGREEMENT)).alias("disagrees"), F.max_by("body", "comment_id").alias("reply"))
    )
    judged = comments.filter(program).select("comment_id", "path", "body", "likes", "dislikes").join(replies, "comment_id", "left")
    outcome = F.when((F.col("dislikes") > 0) | F.coalesce("disagrees", F.lit(False)), "rejected").when(F.col("likes") > 0, "accepted")
    return judged.withColumn("outcome", outcome).filter("outcome IS NOT NULL").select(
        "comment_id", "path", marked_severity(F.col("body")).alias("severity"), subject(F.col("body")).alias("subject"), "outcome", F.coalesce(F.substring("reply", 1, 200), F.lit("")).alias("reply")
    )


def acceptance(feedback: DataFrame, fields: list[str]) -> DataFrame:
    """``field, value, n, acceptance``: feedback by the values of each field, empty ones left out, and the share that was accepted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    rows = feedback.select("outcome", pairs.alias("p")).select("outcome", "p.*").filter("value <> ''")
    accepted = F.count_if(F.col("outcome").isin("accepted", "resolved"))
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.round(accepted / F.count(F.lit(1)), 6).alias("acceptance"))


def low_value(feedback: DataFrame) -> DataFrame:
    """One row: rejected comments, those of them with the mildest severities, and whether these are more than half."""
    rejected = F.col("outcome") == "rejected"
    counts = feedback.agg(F.count_if(rejected).alias("rejected"), F.count_if(rejected & F.col("severity").isin("info", "suggestion")).alias("minor"))
    return counts.withColumn("low_value", F.col("minor") > 0.5 * F.col("rejected"))


# ---------------------------------------------------------------- what a model answers


def answers(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, is_json, summary, risk_level, category, comments`` of a model's free text.

    The JSON is what stands between the first and the last brace; where that does
    not parse, the summary is the first 500 characters and the rest is assumed.
    """
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # in an array of one, because the parser does not mind what follows a value
    body = F.try_parse_json(F.when(found != "", F.concat(F.lit("["), found, F.lit("]"))))
    field = lambda path, kind="string": F.try_variant_get(F.col("j"), path.replace("$", "$[0]"), kind)
    parsed = texts.select(key, F.col(text).alias("text"), body.alias("j"))
    is_json = F.col("j").isNotNull() & field("$", "variant").isNotNull() & F.try_variant_get(F.col("j"), "$[1]", "variant").isNull()
    read = parsed.withColumn("j", F.when(is_json, F.col("j")))
    is_json = F.col("j").isNotNull()
    comment = "array<struct<path string, line int, body string, severity string>>"
    return read.select(
        key,
        is_json.alias("is_json"),
        F.when(is_json, F.coalesce(field("$.summary"), F.lit(""))).otherwise(F.substring("text", 1, 500)).alias("summary"),
        F.coalesce(field("$.risk_level"), F.lit("medium")).alias("risk_level"),
        F.coalesce(field("$.category"), F.lit("other")).alias("category"),
        F.coalesce(field("$.comments", comment), F.array().cast(comment)).alias("comments"),
    )


def repaired_comments(comments: DataFrame, files: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """``comment_id, file_id, wanted, line_no``: a model's comments on files and lines that exist.

    ``comments``: ``keys, comment_id, path, line, body``; ``files``: ``keys,
    file_id, file_ord, filename`` of the files with a patch; ``lines``: ``file_id,
    line_no``.  A comment without path or body goes; a path that is none of the
    pull request's files counts as the first one that ends with it or that it
    ends with, else the comment goes; the line moves to the nearest one shown,
    and without any the comment goes.
    """
    usable = comments.filter("path <> '' AND body <> ''").withColumn("comment_id", F.col("comment_id").cast("string"))
    order = F.struct("file_ord", "file_id")
    exact = usable.join(files.withColumnRenamed("filename", "path"), [*keys, "path"]).groupBy("comment_id", "line").agg(F.min_by("file_id", order).alias("file_id"))
    rest = usable.join(exact.select("comment_id"), "comment_id", "left_anti")
    near = rest.join(files, keys).filter(F.col("filename").endswith(F.col("path")) | F.col("path").endswith(F.col("filename")))
    placed = exact.unionByName(near.groupBy("comment_id", "line").agg(F.min_by("file_id", order).alias("file_id")))
    return snap_to_lines(placed.select("file_id", "comment_id", F.col("line").alias("wanted")), lines, "file_id")
