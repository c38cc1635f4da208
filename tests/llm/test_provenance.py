import random

import pytest
from pyspark.sql import functions as F

from lathework.llm import provenance
from lathework.llm.provenance import BLOB, GENERATED, MINIFIED, NONE, VENDORED, bands, components, evidence, inspect, named, shape, shingles, similar_shapes, verdicts

SCHEMA = "file_id long, repo_full_name string, filename string, patch string"


@pytest.mark.parametrize(
    ("name", "kind"),
    [
        ("vendor/x/a.go", VENDORED), ("web/node_modules/x/i.js", VENDORED), ("src/bundled/lib-1.2/i.ts", VENDORED), ("src/vendor_portal/a.js", NONE),
        ("app/external_accounts/a.py", NONE), ("proto/a_pb2.py", GENERATED), ("gen/a.pb.go", GENERATED), ("yarn.lock", GENERATED), ("web/package-lock.json", GENERATED),
        ("app/lockfile/reader.py", NONE), ("tools/generators/a.py", NONE), ("a/b.min.js", MINIFIED), ("lib/math/min.py", NONE), ("dist/main.ed51a6a5.js", MINIFIED),
        ("build/release.py", NONE), (None, NONE), ("", NONE),
    ],
)
def test_names(name, kind):
    assert named(name) == kind


def added(text):
    lines = text.split("\n")
    return f"@@ -0,0 +1,{len(lines)} @@\n" + "\n".join("+" + x for x in lines)


CODE = "def load(a, b=None):\n    value = fetch(a, 3)\n    if value is None:\n        raise KeyError('gone')\n    return value\n"


@pytest.mark.parametrize(
    ("text", "header", "look"),
    [
        ("# Code generated by toolx. DO NOT EDIT.\n" + CODE, GENERATED, NONE),
        ("/*\n * Diese Datei wurde von toolx erzeugt und wird überschrieben.\n */\nfunction a() {}", GENERATED, NONE),
        ("// Upstream: git.invalid/a/b\n// Imported at 1.2.3; keep in sync with upstream.\n" + CODE, VENDORED, NONE),
        ("// liba v3.3.4\n// https://liba.invalid\n" + CODE, VENDORED, NONE),
        ("# Copyright the a project authors.\n# Licensed under the MIT licence.\n" + CODE, NONE, NONE),
        ("# Do not modify without asking the a team.\n" + CODE, NONE, NONE),
        ("// generated_on is set by the nightly job\n" + CODE, NONE, NONE),
        ("// drop-in for liba, rewritten for our rows\n" + CODE, NONE, NONE),
        (CODE + "\n    out.write('# Code generated by %s. DO NOT EDIT.' % tool)", NONE, NONE),
        ("T = [\n" + "".join(f"    {i}, {i * 7},\n" for i in range(20)) + "]", NONE, BLOB),
        ("blob = \"" + "Qk1" * 150 + "\"", NONE, BLOB),
        ("!function(a,b){a.x=b}(this,1);" * 30, NONE, MINIFIED),
        (CODE, NONE, NONE),
    ],
)
def test_contents(text, header, look):
    assert inspect("a.py", added(text))[:2] == (header, look)


def test_settings_are_no_blobs():
    text = "{\n" + "".join(f'  "key{i}": {i},\n' for i in range(40)) + "}"
    assert inspect("a.json", added(text))[1] == NONE


def test_shape_masks_names_and_literals():
    assert shape(["a = foo('x', 12)  # hi"]) == shape(["bcd=barbaz(\"long text\",  7) # yo"]) == "I=I(S,N)#I"


def test_links_match_brute_force(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("INS(),=.{};") for _ in range(120)) for _ in range(6)]
    forms = []
    for b in base:
        for _ in range(8):
            c = list(b)
            for _ in range(rnd.randint(0, 3)):
                c[rnd.randrange(len(c))] = rnd.choice("INS(),")
            forms.append("".join(c))
    forms = sorted(set(forms))
    codes = [shingles(f) for f in forms]
    rows = [(i, c.tolist(), bands(c)) for i, c in enumerate(codes)]
    frame = spark.createDataFrame(rows, "class long, codes array<int>, bands array<long>")
    links = {tuple(sorted((r.a, r.b))) for r in similar_shapes(frame).collect()}
    sets = [set(c.tolist()) for c in codes]
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert links <= true

    def groups(pairs):
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(x) for x in range(len(sets))]

    got = {r["class"]: r.family for r in components(similar_shapes(frame)).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == groups(links)
    assert sum(a == b for a, b in zip(groups(links), groups(true))) >= 0.9 * len(sets)


@pytest.mark.parametrize(("block", "cells"), [(2048, 1 << 24), (5, 1 << 24), (3, 64)])
def test_large_buckets_lose_no_link(spark, monkeypatch, block, cells):
    """Shapes that all share a bucket, cut into blocks and slices: connected is what brute force over the bucket connects."""
    monkeypatch.setattr(provenance, "BLOCK", block)
    monkeypatch.setattr(provenance, "CELLS", cells)
    rnd = random.Random(15)
    sets = []
    for family in range(4):
        base = rnd.sample(range(1000 * family, 1000 * family + 60), 40)
        sets += [sorted(base + rnd.sample(range(90_000, 99_000), rnd.randint(0, 6))) for _ in range(9)]
    rows = [(i, s, [7, 1000 + i // 2]) for i, s in enumerate(sets)] + [(99, [1, 2, 3], [8, 8])]
    frame = spark.createDataFrame(rows, "class long, codes array<int>, bands array<long>")
    links = similar_shapes(frame)
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))}
    assert {tuple(sorted((r.a, r.b))) for r in links.collect()} <= true
    family = {r["class"]: r.family for r in components(links).collect()}
    want = list(range(len(sets)))
    for _ in want:
        for i, j in true:
            want[i] = want[j] = min(want[i], want[j])
    assert [family.get(i, i) for i in range(len(sets))] == want
    assert similar_shapes(frame.filter("class > 99")).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select((F.col("id") * 3).alias("a"), (F.col("id") * 3 + 3).alias("b")).filter("a <> 450")
    got = {r["class"]: r.family for r in components(links).collect()}
    assert all(f == (0 if c <= 450 else 453) for c, f in got.items()) and len(got) == 301
    assert components(links.filter("a < 0")).collect() == []


def test_family_judges_silent_members(spark):
    def getters(k):
        return "\n".join(f"func (m *T{k}) Get{k}_{i}() int64 {{\n\tif m != nil {{\n\t\treturn m.F{i}\n\t}}\n\treturn 0\n}}\n" for i in range(6))

    rows = [(i, "r/a", f"pkg/f{i}.go", added("// Code generated by toolx. DO NOT EDIT.\n\n" + getters(i))) for i in range(6)]
    rows += [(10, "r/a", "pkg/silent.go", "@@ -30,0 +30,9 @@\n" + "\n".join("+" + x for x in getters(99).split("\n")))]
    rows += [(20, "r/a", "src/hand.py", added(CODE)), (20, "r/a", "src/hand.py", added(CODE))]
    rows += [(30, None, "assets/a.png", None), (31, "r/a", "vendor/x/logo.png", ""), (32, "r/b", "vendor/x/a.js", None), (33, "r/b", None, None), (34, "r/b", "a.py", "")]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("verdict", F.lit("clash"))
    rows = {r.file_id: r for r in verdicts(frame).collect()}
    assert rows[10].channel == "cluster" and rows[32].channel == "alone" and rows[20].channel is None and rows[0].proposed > 0
    got = {r.file_id: r.verdict for r in rows.values()}
    assert got[10] == GENERATED and got[0] == GENERATED and got[32] == VENDORED
    assert [got[i] for i in (20, 30, 31, 33, 34)] == [NONE] * 5
    assert len(got) == 13
    assert verdicts(frame.filter("file_id > 99")).collect() == []
    assert evidence(frame.filter("file_id = 33")).first().tokens == 0


def test_a_foreign_shape_in_a_bucket_breaks_no_link(spark):
    rows = []
    for v in range(20):
        rows += [(10 * v + 1, list(range(v, v + 40)), [v]), (10 * v + 2, list(range(v, v + 41)), [v]), (10 * v + 3, list(range(900, 940)), [v])]
    frame = spark.createDataFrame(rows, "class long, codes array<int>, bands array<long>")
    assert {tuple(sorted((r.a, r.b))) for r in similar_shapes(frame).collect()} == {(10 * v + 1, 10 * v + 2) for v in range(20)}
