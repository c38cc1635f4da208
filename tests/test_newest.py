from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from lathework.catalog.analytics import g17_counters_and_window, h6_newest_rows


def written(spark, folder, rows):
    """A data directory whose events are these rows of (event_id, seconds, user_id, value)."""
    start = datetime(2024, 1, 1)
    data = [(i, None if s is None else start + timedelta(seconds=s), user, value) for i, s, user, value in rows]
    spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_counters_beside_the_newest_rows(spark, tmp_path):
    directory = written(spark, tmp_path, [(i, i // 2, i % 2, i / 4) for i in range(60)] + [(100, 5, 7, None)])
    got = {r.user_id: (r.all_time, r.kept, r.recent_value) for r in g17_counters_and_window(spark, directory).collect()}
    assert got == {u: (30, 20, sum(i / 4 for i in range(20 + u, 60, 2))) for u in (0, 1)} | {7: (1, 1, None)}
    assert entry.queries()["g17_counters_and_window"](spark, directory).columns == ["user_id", "all_time", "kept", "recent_value"]


def test_newest_rows_of_each_user(spark, tmp_path):
    rows = [(i, i // 3, i % 4, 1.0) for i in range(40)] + [(50, None, 9, 1.0), (51, 2, 9, 1.0), (52, 2, 9, 1.0), (53, 1, 9, 1.0)]
    got = h6_newest_rows(spark, written(spark, tmp_path, rows)).collect()
    want = {(u, i) for u in range(4) for i in (28 + u, 32 + u, 36 + u)} | {(9, 51), (9, 52), (9, 53)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_rows_without_user_are_counted(spark, tmp_path):
    directory = written(spark, tmp_path, [(i, i, None, 0.5) for i in range(25)] + [(30, 1, 3, 2.0), (31, None, 3, float("inf"))])
    got = {tuple(r) for r in g17_counters_and_window(spark, directory).collect()}
    assert got == {(None, 25, 20, 10.0), (3, 2, 2, float("inf"))}


@pytest.mark.parametrize("query", ["g17_counters_and_window", "h6_newest_rows"])
def test_odd_rows_agree_with_the_sql(spark, tmp_path, query):
    rows = [(i, None if i % 13 == 0 else i // 4 % 9, None if i % 7 == 0 else i % 5, None if i % 11 == 0 else float("inf") if i == 398 else -i / 8) for i in range(400)]
    directory = written(spark, tmp_path, rows)
    with duckdb.connect() as database:
        database.execute(f"CREATE VIEW events AS SELECT * FROM '{directory}/events.parquet/*.parquet'")
        want = database.execute(entry.oracle_sql()[query]).fetchall()
    got = [tuple(r) for r in entry.queries()[query](spark, directory).collect()]
    assert len(got) == {"g17_counters_and_window": 6, "h6_newest_rows": 18}[query] and sorted(map(repr, got)) == sorted(map(repr, want))
