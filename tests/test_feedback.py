from pyspark.sql import functions as F

from lathework.catalog import examples
from lathework.functions.rules import PERFORMANCE
from lathework.operators import feedback as A
from lathework.operators import scan as S
from lathework.operators import structure as T
from lathework.streaming import events as E
from tests.test_diff import files


def test_outcomes(spark):
    """A reply that disagrees, also in part of a word, beats a reaction; replies by programs do not count; no sign gives no row."""
    comments = examples.example_comments(spark)
    got = {r.comment_id: (r.severity, r.subject, r.outcome, r.reply) for r in A.outcomes(comments).collect()}
    assert got == {
        1: ("critical", "security", "rejected", "Good catch, fixed in the next unit"),
        3: ("warning", "performance", "accepted", "thanks"),
        5: ("suggestion", "design", "rejected", ""),
        6: ("info", "testing", "rejected", "This is by design."),
        12: ("warning", "performance", "accepted", "second reply"),
    }
    assert A.outcomes(comments.filter("comment_id > 99")).collect() == []
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "a[bot]", None, None, None, 1, None)], examples.COMMENT_SCHEMA)
    assert [(r.comment_id, r.severity, r.outcome) for r in A.outcomes(nulls).collect()] == [(2, "info", "accepted")]


def test_threads(spark):
    got = {(r.root, r.nth): r.comment_id for r in A.threads(examples.example_comments(spark)).collect()}
    assert got[12, 1] == 12 and got[12, 2] == 13 and got[12, 3] == 14 and got[5, 1] == 5


def test_answers(spark):
    texts = ['so: {"summary": "s", "comments": [{"path": "a", "line": 2, "body": "b"}]} end', "no json", '{"a": 1} {"b": 2}', "x" * 600, None, "{", '{"summary": null}']
    got = [r for r in A.answers(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").orderBy("id").collect()]
    assert [r.is_json for r in got] == [True, False, False, False, False, False, True]
    assert got[0].summary == "s" and got[0].comments[0].path == "a" and got[0].risk_level == "medium"
    assert got[2].summary == '{"a": 1} {"b": 2}' and len(got[3].summary) == 500 and got[4].summary is None and got[6].summary == ""


def test_repaired_comments(spark):
    changed = files(spark, "", "", name=["src/app/main.py", "lib/main.py"])
    rows = [(1, "src/app/main.py", 15, "b"), (2, "main.py", 1, "b"), (3, "repo/lib/main.py", 99, "b"), (4, "other.py", 1, "b"), (5, "", 1, "b"), (6, "lib/main.py", 1, None)]
    pr = changed.select("repo_full_name", "pr_number", "head_sha").first()
    comments = spark.createDataFrame([(*pr, *r) for r in rows], "repo_full_name string, pr_number int, head_sha string, comment_id long, path string, line int, body string")
    lines = spark.createDataFrame([(0, 10), (0, 12), (0, 20), (1, 3)], "file_id long, line_no int")
    got = {r.comment_id: (r.file_id, r.line_no) for r in A.repaired_comments(comments, changed.select("repo_full_name", "pr_number", "head_sha", "file_id", "file_ord", "filename"), lines, ["repo_full_name", "pr_number", "head_sha"]).collect()}
    assert got == {"1": (0, 12), "2": (0, 10), "3": (1, 3)}


def test_commands_and_deliveries(spark):
    said = spark.createDataFrame([("/fixture",), (" \n/review x",), ("/Fix",), ("hey /ask",), (None,)], "t string")
    assert [r.c for r in said.select(E.commands(F.col("t"), E.COMMANDS).alias("c")).collect()] == ["fix", "review", None, None, None]
    got = [tuple(r) for r in E.deliveries(spark.createDataFrame([(0,), (2,), (9,)], "fails int"), F.col("fails"), 4, 1.0, 3.0).collect()]
    assert [(r[1], r[2]) for r in got] == [(1, "delivered"), (3, "delivered"), (4, "dead_letter")] and [r[3] or 0 for r in got] == [0, 3.0, 6.0]


def test_licences_and_many_dependencies(spark):
    from lathework.operators import diff as D

    lines = D.new_side(examples.example_files(spark))
    names = {r[0]: r[5] for r in examples.ROWS}
    got = {(names[r.file_id], r.licence, r.risk) for r in T.licence_findings(lines).collect()}
    assert ("LICENSE", "GPL-3.0", "copyleft") in got and ("pyproject.toml", "Proprietary", "unknown") in got and ("web/package.json", "AGPL-3.0", "copyleft") in got
    assert not {n for n, _, _ in got} & {"docs/license.md"}
    assert T.many_dependencies(lines).first().dependencies > 5
    assert T.many_dependencies(lines, most=99).collect() == []
    assert {r.rule_id for r in S.performance_findings(lines, PERFORMANCE).collect()} >= {"PERF001", "PERF002", "PERF010", "PERF013"}
