import random

from pyspark.sql import functions as F

from lathework.operators import analytics as A
from lathework.operators import impact as I
from lathework.operators import labels as L
from lathework.operators import retrieval as R
from lathework.plans.ordinal import numbered
from tests.test_diff import files


def test_reachable(spark):
    edges = spark.createDataFrame([("core", "api"), ("api", "web"), ("web", "core"), ("db", "db")], "src string, dst string")
    got = {(r.start, r.node) for r in I.reachable(edges).collect()}
    assert got == {(a, b) for a in ("core", "api", "web") for b in ("core", "api", "web") if a != b}


def test_owning_package(spark):
    packages = spark.createDataFrame([(0, "core", "core"), (1, "inner", "core/x"), (2, "web", "web")], "ord int, package string, path string")
    got = {r.file_id: r.package for r in I.owning_package(files(spark, "", "", "", name=["core/x/a.py", "web.py", "web/a/b.py"]), packages).collect()}
    assert got == {0: "core", 1: None, 2: "web"}


def comments(spark, rows):
    return spark.createDataFrame([("p", i, line, body, severity) for i, (line, body, *more) in enumerate(rows) for severity in (more or ["info"])], "key string, comment_id long, line int, body string, severity string")


def test_overlaps_and_greedy_groups(spark):
    frame = comments(spark, [(10, "missing null check here"), (13, "missing null check"), (14, "missing null check"), (11, "other words entirely")])
    assert {(r.a, r.b) for r in I.comment_overlaps(frame).collect()} == {(0, 1), (1, 2)}
    got = {r.first_id: (r.members, r.comment_id) for r in I.merge_comments(frame).collect()}
    assert got == {0: (3, 0), 3: (1, 3)}


def test_merged_severity_and_strategies(spark):
    frame = comments(spark, [(1, "null check", "odd"), (2, "null check", "warning"), (3, "null check now", "critical"), (90, "alone", None)])
    got = {r.first_id: tuple(r)[2:] for r in I.merge_comments(frame, models=3).collect()}
    assert got == {0: (3, 2, "critical", 1.0, True, True), 3: (1, 3, None, 0.333333, False, False)}
    assert I.merge_comments(frame.filter("line > 100")).collect() == []


def test_first_fit_matches_the_sequence(spark):
    """Against taking the comments one by one, over chains and forks."""
    rnd = random.Random(11)
    for _ in range(3):
        pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(70)} | {(i, i + 1) for i in range(60, 120)}
        group: dict[int, int] = {}
        for c in range(121):
            group[c] = min((group[a] for a, b in pairs if b == c), default=c)
        overlaps = spark.createDataFrame([("k", a, b) for a, b in pairs], "key string, a long, b long")
        got = I.first_fit(overlaps, spark.range(121).selectExpr("'k' AS key", "id AS comment_id")).collect()
        assert {r.comment_id: r.first_id for r in got} == group


def test_a_long_path_is_closed_in_few_rounds(spark):
    edges = spark.range(150).selectExpr("id AS src", "id + 1 AS dst")
    assert I.reachable(edges).count() == 151 * 150 // 2


def test_owner_scores(spark):
    frame = files(spark, "", "", name=["web/a.js", "web/b.py"])
    got = {r.owner: r.score for r in I.owner_scores(frame, [("*", ["all"]), ("*.py", ["py"])]).collect()}
    assert got == {"all": 16, "py": 16}


def test_risk_fold_depends_on_order(spark):
    risky = ["DROP TABLE x"] * 3
    assert L.risk_fold(files(spark, *risky, "x", name=["a", "b", "c", "Dockerfile"])).first().risk == 10
    assert L.risk_fold(files(spark, "x", *risky, name=["Dockerfile", "a", "b", "c"])).first().risk == 15


def test_rank_fusion(spark):
    one = spark.createDataFrame([("x", 1), ("y", 2)], "id string, nth int")
    two = spark.createDataFrame([("y", 1)], "id string, nth int")
    got = {r.id: r.score for r in R.fused([one, two], ["id"]).collect()}
    assert abs(got["x"] - 1 / 61) < 1e-8 and abs(got["y"] - (1 / 62 + 1 / 61)) < 1e-8


def test_nearest_is_exact(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.random() for _ in range(8)] if i % 10 else None) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 50 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.nth): r.vec_id for r in R.nearest(vectors, queries, most=3).collect()}
    data = {r.vec_id: r.embedding for r in vectors.collect() if r.embedding}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5), 6)

    for q in (1, 51, 101, 151):
        best = sorted(data, key=lambda v: (-cosine(data[q], data[v]), v))[:3]
        assert [got[q, n] for n in (1, 2, 3)] == best


def test_nearest_with_gaps(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [None, 1.0]), (3, [0.0, 0.0]), (4, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(7, [2.0, 0.0]), (None, [1.0, 1.0]), (8, None)], "query_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id, r.score) for r in R.nearest(vectors, queries).collect()) == [(7, 1, 1.0), (7, 1, 1.0), (7, 2, 0.0)]
    assert R.nearest(vectors.filter("vec_id > 9"), queries).collect() == [] and R.nearest(vectors, queries.filter("query_id > 9")).collect() == []


def test_nearest_in_tiles(spark, monkeypatch):
    """Many small tiles give what one gives."""
    rnd = random.Random(3)
    vectors = spark.createDataFrame([(i, [rnd.random() for _ in range(4)]) for i in range(120)], "vec_id long, embedding array<float>")
    queries = vectors.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    one = sorted(map(tuple, R.nearest(vectors, queries, 5).collect()))
    monkeypatch.setattr(R, "ROWS_OF_TILE", 17)
    monkeypatch.setattr(R, "QUERIES_OF_TILE", 4)
    assert sorted(map(tuple, R.nearest(vectors, queries, 5).collect())) == one and len(one) == 14 * 5


def test_trigram_similarity(spark):
    row = spark.range(1).select(F.size(R.trigrams(F.lit("cat"))).alias("n"), R.similarity(R.trigrams(F.lit("word")), R.trigrams(F.lit("words"))).alias("s"), R.similarity(R.trigrams(F.lit("")), R.trigrams(F.lit("a"))).alias("z")).first()
    assert row.n == 4 and abs(row.s - 4 / 7) < 1e-9 and row.z == 0


def test_sections(spark):
    text = "intro\n# One\nbody\n\n#### deep\n## Two \n\n"
    got = [(r.start_line, r.end_line, r.identifier, r.level, r.content) for r in R.section_chunks(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").orderBy("start_line").collect()]
    assert got == [(1, 1, None, 0, "intro"), (2, 5, "One", 1, "# One\nbody\n\n#### deep"), (6, 8, "Two", 2, "## Two")]


def test_code_chunks(spark):
    code = "import os\nimport re\n\n@dec\ndef f(x):\n    return x\n\nclass C:\n    a = 1\n    def m(self):\n        pass\n\nX = 1\n"
    frame = spark.createDataFrame([("a.py", code), ("b.py", "def ("), ("c.go", "x\ny"), ("d.py", None)], "file_path string, text string")
    got = {(r.file_path, r.chunk_type, r.identifier): (r.start_line, r.end_line) for r in R.code_chunks(frame).collect()}
    assert got[("a.py", "module_imports", None)] == (1, 2) and got[("a.py", "function", "f")] == (4, 6)
    assert got[("a.py", "class", "C")] == (8, 11) and got[("a.py", "method", "C.m")] == (10, 11)
    assert got[("b.py", "module_top_level", None)] == (1, 1) and got[("c.go", "whole_file", None)] == (1, 2)
    # the decorator of a function counts as what remains; the last line is empty
    assert got[("a.py", "module_top_level", None)] == (4, 13) and len(got) == 7
    text = {(r.file_path, r.chunk_type): r.content for r in R.code_chunks(frame).collect()}
    assert text["a.py", "class"] == "class C:\n    a = 1" and text["a.py", "module_imports"] == "import os\nimport re"


def test_index_changes(spark):
    schema = "repository_id string, file_path string, identifier_coalesce string, start_line int, content_hash string"
    old = spark.createDataFrame([("r", "a", "", 1, "x"), ("r", "a", "", 2, "y"), ("r", "a", "", 3, "z")], schema)
    new = spark.createDataFrame([("r", "a", "", 1, "x"), ("r", "a", "", 2, "Y"), ("r", "a", "", 4, "w")], schema)
    assert {(r.start_line, r.change) for r in R.index_changes(old, new).collect()} == {(1, "unchanged"), (2, "changed"), (3, "deleted"), (4, "added")}


def test_numbered_over_many_partitions(spark):
    frame = spark.range(0, 5000, 1, 7).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("v"))
    got = numbered(frame, [F.col("v")]).collect()
    assert all(r.nth == r.v + 1 for r in got) and len(got) == 5000
    assert numbered(frame.filter("v < 0"), [F.col("v")]).collect() == []


def test_latest_reviews(spark):
    schema = "id string, status string, created_at timestamp, completed_at timestamp, total_cost_usd decimal(10,6), total_input_tokens int"
    from datetime import datetime as d

    rows = [("a", "queued", d(2025, 1, 1), None, None, 1), ("a", "posted", d(2025, 1, 1), d(2025, 1, 2), None, 1), ("b", "queued", d(2025, 1, 1), None, None, 1), ("b", "queued", d(2025, 1, 1), None, None, 1)]
    assert {(r.id, r.status) for r in A.latest_reviews(spark.createDataFrame(rows, schema)).collect()} == {("a", "posted"), ("b", "queued")}


def test_benchmark(spark):
    samples = spark.createDataFrame([(1, ["sql"]), (2, ["xss"]), (3, []), (4, [])], "sample_id long, expected array<string>")
    found = spark.createDataFrame([(1, "SEC001 sql"), (3, "SEC020 secrets")], "sample_id long, words string")
    assert tuple(A.benchmark(samples, found).first()) == (1, 1, 1, 1, 0.5, 0.5)
