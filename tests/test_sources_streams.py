import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lathework.sources import exports as X
from lathework.sources import logs as G
from lathework.sources import payloads as A
from lathework.streaming import events as E


def test_counted_lines(spark):
    row = spark.range(1).select(A.counted_lines(F.lit("+a\n-b\n+c"), "+").alias("a"), A.counted_lines(F.lit("+a\n-b\n+c"), "-").alias("d"), A.counted_lines(F.lit("x\n+++ b\n--- a"), "+").alias("h")).first()
    assert tuple(row) == (1, 1, 0)


def test_numstat(spark):
    frame = spark.createDataFrame([("1\t2\ta b.py",), ("-\t-\tx.png",), ("1\t2",), ("",)], "line string")
    assert [tuple(r) for r in A.parsed_numstat(frame, "line").collect()] == [(1, 2, "a b.py"), (0, 0, "x.png")]


def test_repository_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.PY").write_bytes(b"x = 1\xff")
    (tmp_path / "src/b.bin").write_bytes(b"x")
    (tmp_path / "src/big.py").write_bytes(b"x" * 1_000_001)
    (tmp_path / "node_modules/c.py").write_bytes(b"x")
    got = A.repository_files(spark, str(tmp_path), {".py": "python"}).collect()
    assert [(r.path.rsplit("/", 1)[1], r.language) for r in got] == [("a.PY", "python")]


def test_log_stops_at_a_broken_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n{"n": 2}\n{broken\n{"n": 4}\n')
    (tmp_path / "b.jsonl").write_text('{"n": 5}\n\n{"n": 6}')
    got = sorted(r.n for r in G.read_until_broken(spark, str(tmp_path), "n int").collect())
    assert got == [1, 2, 5, 6]


def test_log_defaults(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"repo": "a"}\n{"repo": "b", "cost": 2.5}\n')
    got = {r.repo: r.cost for r in G.read_log(spark, str(tmp_path), "repo string, cost double", {"cost": 0.0}).collect()}
    assert got == {"a": 0.0, "b": 2.5}


def test_configuration():
    text = "rules:\n  - {name: a, files: '*.py'}\n  - nonsense\n  - {name: b}\n  - {name: c, files: [x, y]}\n"
    assert G.load_config(text, "rules", {"name": str, "files": list}) == [{"name": "a", "files": ["*.py"]}, {"name": "c", "files": ["x", "y"]}]
    assert G.load_config("{: bad", "rules", {}) == [] and G.load_config("[]", "rules", {}) == []


def findings(spark):
    rows = [("r", "b.py", 0, "S2", "high"), ("r", "a.py", 3, "S1", "critical"), ("q", "a.py", 1, "S1", "warning")]
    return spark.createDataFrame(rows, "repo string, path string, line int, rule_id string, severity string")


def test_exports(spark):
    sarif = {r.repo: json.loads(r.sarif) for r in X.sarif_documents(findings(spark), ["repo"]).collect()}
    run = sarif["r"]["runs"][0]
    assert [x["id"] for x in run["tool"]["driver"]["rules"]] == ["critical", "high"]
    assert [(x["ruleIndex"], x["level"], x["locations"][0]["physicalLocation"]["region"]["startLine"]) for x in run["results"]] == [(0, "error", 3), (1, "error", 1)]
    text = {r.repo: r.markdown for r in X.markdown_documents(findings(spark), ["repo"]).collect()}
    assert text["r"] == "# 2 findings\n\n### a.py\n- **critical** line 3: S1\n\n### b.py\n- **high** line 0: S2"
    documents = {r.repo: json.loads(r.json) for r in X.json_documents(findings(spark), ["repo"]).collect()}
    assert documents["r"]["stats"] == {"critical": 1, "high": 1}
    assert {r.repo: r.conclusion for r in X.check_runs(findings(spark), ["repo"]).collect()} == {"r": "failure", "q": "success"}
    many = spark.createDataFrame([("w", "a", i, "S", "warning") for i in range(60)], findings(spark).schema)
    (run,) = X.check_runs(many, ["repo"]).collect()
    assert run.conclusion == "neutral" and len(run.annotations) == 50


def test_retry_times(spark):
    got = [r.w for r in spark.range(1, 12).select(E.retry_after(F.col("id")).alias("w")).collect()]
    assert got[2] == 4 and got[8] == 256 and got[9] == 300 and got[10] == 300


def test_commands(spark):
    row = spark.range(1).select(E.commands(F.lit("  /review all"), ["review", "rev"]).alias("a"), E.commands(F.lit("/revert"), ["review", "rev"]).alias("b"), E.commands(F.lit("hello"), ["review"]).alias("c"), E.commands(F.lit("/Review"), ["review"]).alias("d")).first()
    assert tuple(row) == ("review", "rev", None, None)  # letter case counts


def write_events(spark, tmp_path):
    start = datetime(2025, 1, 1)
    rows = [(i, start + timedelta(seconds=17 * i), i % 3, "view" if i % 2 else "click", float(i)) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return rows


def test_keyed_state_matches_a_walk(spark, tmp_path):
    rows = write_events(spark, tmp_path)
    stream = E.stream_table(spark, str(tmp_path), "events")
    got = {r.event_id for r in E.drained(E.cooled_down(stream, 60), "cool").collect()}
    last, want = {}, set()
    for i, ts, user, _, _ in rows:
        if user not in last or (ts - last[user]).total_seconds() >= 60:
            last[user] = ts
            want.add(i)
    assert got == want
    allowed = {r.event_id: r.allowed for r in E.drained(E.rate_limited(stream, 2.0, 2.0), "bucket").collect()}
    state, expect = {}, {}
    for i, ts, _, kind, _ in rows:
        tokens, before = state.get(kind, (2.0, None))
        if before is not None:
            tokens = min(2.0, tokens + (ts - before).total_seconds() * 2.0 / 60)
        expect[i] = tokens >= 1
        state[kind] = (tokens - expect[i], ts)
    assert allowed == expect


def test_windows_match_a_batch(spark, tmp_path):
    rows = write_events(spark, tmp_path)
    stream = E.stream_table(spark, str(tmp_path), "events")
    got = {(r.starts, r.event_type): r.n for r in E.drained(E.windowed(stream, "ts", ["event_type"], "5 minutes"), "win").collect()}
    want: dict = {}
    for _, ts, _, kind, _ in rows:
        start = ts.replace(minute=ts.minute // 5 * 5, second=0)
        want[start, kind] = want.get((start, kind), 0) + 1
    closed = rows[-1][1] - timedelta(minutes=10)
    assert got == {k: n for k, n in want.items() if k[0] + timedelta(minutes=5) <= closed}
