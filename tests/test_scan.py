import re

import pytest
from pyspark.sql import functions as F

from lathework.functions.globs import matches_owner_rule, path_regex, shell_regex
from lathework.functions.rules import MIGRATION, PERFORMANCE, SECURITY
from lathework.operators import diff as D
from lathework.operators import paths as P
from lathework.operators import scan as S
from tests.test_diff import files


def test_rule_tables():
    ids = [r[0] for r in SECURITY + PERFORMANCE + MIGRATION]
    assert len(ids) == len(set(ids)) == 78


@pytest.mark.parametrize(
    ("pattern", "path", "shell", "own"),
    [
        ("src/**/*.py", "src/a.py", False, True), ("*.lock", "a/b.lock", True, False), ("src/*.py", "src/x/a.py", True, False), ("a?c", "a/c", True, False),
        ("*.{ts,js}", "a.ts", False, False), ("[ab].py", "a.py", True, False), ("**/x", "x", False, True), ("docs/**", "docs/a/b", True, True),
    ],
)
def test_globs(spark, pattern, path, shell, own):
    row = spark.createDataFrame([(path,)], "p string").select(F.col("p").rlike(shell_regex(pattern)).alias("s"), F.col("p").rlike(path_regex(pattern)).alias("o")).first()
    assert (row.s, row.o) == (shell, own)


def test_owner_rules(spark):
    row = spark.createDataFrame([("web/app/x.js",)], "p string")
    test = lambda rule: row.select(matches_owner_rule(F.col("p"), rule).alias("m")).first().m
    assert test("web/") and test("*.js") and test("web/app") and test("x.js") and not test("app") and not test("web/*.ts")


SECURITY_LINES = {
    "SEC001": ("a.py", "cursor.execute(f\"SELECT {x}\")"), "SEC020": ("a.js", "api_key = 'ABCDEFGHIJKLMNOPQRST'"), "SEC024": ("a.txt", "-----BEGIN RSA PRIVATE KEY-----"), "SEC041": ("a.py", "subprocess.run(c, shell=True)"),
    "SEC042": ("a.py", "eval(x)"), "SEC010": ("a.js", "e.innerHTML = x"), "SEC071": ("a.py", "yaml.load(f)"), "SEC101": ("a.go", "InsecureSkipVerify: true"), "SEC140": ("a.rs", "unsafe {"), "SEC151": ("a.php", "include($x)"),
}


def test_security_rules_find_their_lines(spark):
    for rule, (name, line) in SECURITY_LINES.items():
        hits = S.security_findings(D.new_side(files(spark, f"@@ -0,0 +7,1 @@\n+{line}", name=name)), SECURITY).collect()
        assert rule in {h.rule_id for h in hits} and {h.line_no for h in hits} == {7}, rule
        assert S.security_findings(D.new_side(files(spark, f"@@ -0,0 +7,1 @@\n+{line}", name="tests/" + name)), SECURITY).collect() == []


def test_performance_first_line_and_multi_line(spark):
    patch = "@@ -0,0 +1,9 @@\n+x = 1\n+for u in users:\n+    db.get(u)\n+rows = 'SELECT * FROM t'\n+again = 'SELECT * FROM t'"
    got = {r.rule_id: r.line_no for r in S.performance_findings(D.new_side(files(spark, patch)), PERFORMANCE).collect()}
    assert got == {"PERF001": 2, "PERF004": 4}


def test_linear_form_accepts_the_same():
    text = "for a in b:\n    c = 1\n\n    d\n    s += 'x'\n"
    assert re.search(S.LINEAR["PERF011"], text, re.I | re.M) and re.search(dict((r[0], r[4]) for r in PERFORMANCE)["PERF011"], text, re.I | re.M)


def test_migration(spark):
    lines = D.new_side(files(spark, "@@ -0,0 +1,1 @@\n+  DROP TABLE users;", name="db/1.sql"))
    assert {r.rule_id for r in S.migration_findings(lines, MIGRATION).collect()} == {"MIG001", "MIG012"}
    assert S.migration_findings(D.new_side(files(spark, "@@ -0,0 +1,1 @@\n+DROP TABLE users;", name="a.py")), MIGRATION).collect() == []


def test_merge(spark):
    main = spark.createDataFrame([(1, 5, 0, "m"), (1, 5, 0, "n")], "file_id long, line_no int, source_ord int, rule_id string")
    scan = spark.createDataFrame([(1, 5, 1, "s"), (1, 6, 1, "t"), (1, 6, 2, "u")], main.schema)
    assert sorted(r.rule_id for r in S.merge_findings(main, scan).collect()) == ["m", "n", "t"]


def test_snap(spark):
    lines = spark.createDataFrame([("a", 10), ("a", 12), ("a", 20)], "k string, line_no int")
    comments = spark.createDataFrame([("a", 1, 15), ("a", 2, 11), ("a", 3, 99), ("b", 4, 1), ("a", 5, 12)], "k string, comment_id int, wanted int")
    assert {(r.comment_id, r.line_no) for r in S.snap_to_lines(comments, lines, "k").collect()} == {("1", 12), ("2", 10), ("3", 20), ("5", 12)}


def test_companions(spark):
    frame = files(spark, "x", "y", name=["src/a.py", "docs/x.md"])
    name = F.col("filename")
    assert S.files_without_companions(frame, D.PR, name.startswith("src/"), name.startswith("docs/")).collect() == []
    assert S.files_without_companions(frame, D.PR, name.startswith("src/"), name.startswith("none")).first().filename == "src/a.py"


def test_severity_threshold(spark):
    frame = spark.createDataFrame([("critical",), ("warning",), ("info",), ("odd",)], "severity string")
    assert sorted(r.severity for r in P.at_least(frame, "warning").collect()) == ["critical", "warning"]
    assert [r.severity for r in P.at_least(frame, "unknown").collect()] == ["critical"]
