from pyspark.sql import functions as F

from lathework.operators import diff as D
from lathework.operators import structure as T

SCHEMA = "file_id long, repo_full_name string, pr_number int, head_sha string, file_ord int, filename string, status string, additions int, deletions int, patch string"


def files(spark, *patches, name="a.py", status="modified"):
    rows = [(i, "r/a", 1, "s", i, name if isinstance(name, str) else name[i], status, 1, 1, p) for i, p in enumerate(patches)]
    return spark.createDataFrame(rows, SCHEMA)


PATCH = "--- a/x\n+++ b/x\n@@ -1,2 +5,3 @@\n ctx\n-old\n+new\n--- comment\n+last\n\\ No newline at end of file\n"


def test_new_side(spark):
    got = sorted((r.line_no, r.text, r.position) for r in D.new_side(files(spark, PATCH, None, "")).collect())
    assert got == [(0, "--- a/x", 1), (1, "+++ b/x", 2), (5, "ctx", 4), (6, "new", 6), (7, "--- comment", 7), (8, "last", 8), (9, "", 10)]


def test_repeated_number_keeps_first_place_and_last_text(spark):
    patch = "@@ -1 +1 @@\n+one\n@@ -9 +1 @@\n+two"
    (row,) = D.new_side(files(spark, patch)).collect()
    assert (row.text, row.position, row.first_position) == ("two", 4, 2)


def test_both_sides(spark):
    got = {(r.side, r.line_no, r.text) for r in D.both_sides(files(spark, "@@ -10,3 +20,3 @@\n a\n-b\n+c\n d")).collect()}
    assert got == {("removed", 11, "b"), ("added", 21, "c")}


def test_split_files(spark):
    diff = "noise\ndiff --git a/lib/u.py b/lib/u.py\n--- a/lib/u.py\n+++ b/lib/u.py\n@@ -1 +1 @@\n+x\ndiff --git a/v b/v\n@@ -1 +1 @@\n+1\ndiff --git a/v b/v\n@@ -1 +1 @@\n+2"
    frame = spark.createDataFrame([(1, diff), (2, None), (3, "")], "id long, diff string")
    got = {r.path: r.patch for r in D.split_files(frame, "id", "diff", from_hunk=True).collect()}
    assert got == {"lib/u.py": "@@ -1 +1 @@\n+x", "v": "@@ -1 +1 @@\n+2"}
    whole = {r.path: r.patch for r in D.split_files(frame, "id", "diff").collect()}
    assert whole["lib/u.py"].startswith("diff --git a/lib/u.py")


def test_combined_diff_is_cut(spark):
    frame = files(spark, "x" * 100, "y" * 500, "z" * 10)
    (row,) = D.combined_diff(frame, max_size=400).collect()
    parts = row.text.split("\n\n")
    assert row.n_parts == 2 and parts[0] == "--- a/a.py\n+++ b/a.py\n" + "x" * 100 and parts[1].endswith("\n... (truncated)")
    assert row.text.endswith("\n\n\n... and 1 more files (truncated due to size)")


def test_identifiers(spark):
    frame = spark.createDataFrame([(1, "+def f(x):\n+  async def g():\n-def h():\n+++ b/x\n+export const a = 1\n+class C:\n+def f():")], "id long, diff string")
    assert sorted(r.identifier for r in D.added_identifiers(frame, "id", "diff").collect()) == ["C", "a", "f", "g"]


def test_clones(spark):
    body = "".join(f"+value_number_{i} = compute(value_{i})\n" for i in range(5))
    lines = D.new_side(files(spark, "@@ -0,0 +1,6 @@\n" + body + "+x", "@@ -0,0 +1,6 @@\n" + body + "+y", name=["a.py", "b.py"]))
    got = [tuple(r) for r in T.clones(T.clone_windows(lines)).select("path_a", "line_a", "path_b", "line_b").orderBy("line_a").collect()]
    assert got == [("a.py", 1, "b.py", 1), ("a.py", 2, "b.py", 2)]


def test_unused_imports(spark):
    patch = "@@ -0,0 +1,9 @@\n+import os, sys as system\n+from a.b import c as d, e\n+print(system, e)\n+from x import _hidden\n+import json"
    got = sorted(r.name for r in T.unused_imports(D.new_side(files(spark, patch))).collect())
    assert got == ["d", "json", "os"]
    script = "@@ -0,0 +1,3 @@\n+import { A, b as C } from './x'\n+import D from 'd'\n+use(C)"
    assert sorted(r.name for r in T.unused_imports(D.new_side(files(spark, script, name="a.ts"))).collect()) == ["A", "D"]


def test_broken_interfaces(spark):
    patch = "@@ -1,9 +1,9 @@\n-def gone(x):\n-def kept(x):\n-def _private(x):\n-class Old:\n-@app.get('/v1/x')\n-export const z = 1\n-func Exported(a int) {\n+def kept(y):\n+    Old = 3"
    got = sorted((r.kind, r.name) for r in T.broken_interfaces(D.both_sides(files(spark, patch))).collect())
    assert got == [("endpoint_removed", "/v1/x"), ("endpoint_removed", "/v1/x"), ("export_removed", "z"), ("function_removed", "Exported"), ("function_removed", "Exported"), ("function_removed", "gone")]


def test_undocumented(spark):
    patch = "@@ -0,0 +1,9 @@\n+// Open opens.\n+func Open(a int) {\n+}\n+\n+\n+func Close() {\n+func inner() {"
    got = [(r.line_no, r.name) for r in T.undocumented(D.new_side(files(spark, patch, name="a.go"))).collect()]
    assert got == [(6, "Close")]
    assert T.undocumented(D.new_side(files(spark, patch, name="tests/a.go"))).collect() == []


def test_function_metrics_match_a_walk(spark):
    code = ["def f(self, a, b=1):", "    if a and b:", "        for x in a:", "            if x:", "                y(", "                )", "    return 1", "async def g():", "    while True:", "        pass"]
    patch = "@@ -0,0 +1,10 @@\n" + "\n".join("+" + c for c in code)
    got = {r.name: r.asDict() for r in T.function_metrics(D.new_side(files(spark, patch))).collect()}
    level = total = deepest = branches = 0
    import re

    for line in code[:7]:
        bare = line.strip()
        if re.search(T.DEEPER, bare):
            level += 1
            deepest = max(deepest, level)
        if re.match(T.SHALLOWER, bare):
            level = max(0, level - 1)
        n = len(re.findall(T.BRANCH["python"], bare))
        branches += n
        total += n * (1 + level)
    f = got["f"]
    assert (f["cyclomatic"], f["cognitive"], f["depth"], f["loc"], f["parameters"], f["start_line"]) == (1 + branches, total, deepest, 7, 2, 1)
    assert got["g"]["start_line"] == 8 and got["g"]["parameters"] == 0


def test_licences(spark):
    row = spark.range(1).select(T.licence_of(F.lit("GNU General Public License, version 2")).alias("a"), T.licence_of(F.lit("under the MIT  License")).alias("b"), T.licence_of(F.lit("none")).alias("c"), T.licence_class(F.lit("AGPL-3.0-only"))["risk"].alias("d")).first()
    assert tuple(row) == ("GPL-2.0", "MIT", None, "copyleft")


def test_dependencies(spark):
    patch = '@@ -0,0 +1,3 @@\n+  "lodash": "*",\n+  "mine": "git+ssh://x",\n+  "ok": "^1.0.0"'
    got = sorted((r.kind, r.package) for r in T.dependency_findings(D.new_side(files(spark, patch, name="web/package.json"))).collect())
    assert got == [("risky", "lodash"), ("risky", "mine"), ("unpinned", "lodash")]
