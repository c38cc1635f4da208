from datetime import datetime

from pyspark.sql import functions as F

from lathework.operators import delivery
from lathework.operators.delivery import deliver_once, folded

SCHEMA = "delivery_id long, received_at timestamp, sha string, number int, name string, rank string, row string"


def at(minute):
    return datetime(2025, 1, 1, 0, minute)


def run(spark, rows, new=None, salts=4):
    frame = spark.createDataFrame(rows, SCHEMA)
    more = spark.createDataFrame(new, SCHEMA) if new is not None else None
    return deliver_once(
        frame, more, key=[folded("sha"), F.col("number"), folded("name")], order=[F.col("received_at")], row_id=F.col("delivery_id"), salts=salts
    )


def ids(frame):
    return sorted(r.delivery_id for r in frame.collect())


def test_singles_repeats_and_incomplete(spark):
    rows = [
        (1, at(5), "A", 1, "x/y", "r", "w"),
        (2, at(3), " a\t", 1, "X/Y　", "r", "w"),
        (3, at(3), "a", 1, "x/y", None, None),
        (4, at(9), "b", 1, "x/y", None, None),
        (5, at(1), None, 1, "x/y", None, None),
        (6, at(1), "  ", 1, "x/y", None, None),
        (7, at(1), "a", None, "x/y", None, None),
        (8, None, "b", 1, "x/y", None, None),
    ]
    got = run(spark, rows)
    assert ids(got.kept) == [2, 4, 5, 6, 7]
    assert ids(got.superseded) == [1, 3, 8]
    assert got.kept.columns == ["delivery_id", "received_at", "sha", "number", "name", "rank", "row"]


def test_new_messages_meet_stored_ones(spark):
    got = run(spark, [(1, at(1), "a", 1, "n", None, None)], [(2, at(0), "a", 1, "n", None, None), (3, at(2), "c", 1, "n", None, None)])
    assert ids(got.kept) == [2, 3]
    assert ids(got.superseded) == [1]


def test_repeated_rows_are_one_delivery(spark):
    row = (1, at(1), "a", 1, "n", None, None)
    got = run(spark, [row, row, row])
    assert ids(got.kept) == [1]
    assert ids(got.superseded) == []


def test_empty(spark):
    got = run(spark, [])
    assert ids(got.kept) == [] and ids(got.superseded) == []


def test_hot_identifier_matches_brute_force(spark):
    rows = [(i, at((i * 7) % 50), "hot" if i % 3 == 0 else f"s{i % 40}", 1, "n", None, None) for i in range(600)]
    got = run(spark, rows, salts=8)
    best = {}
    for r in rows:
        best[r[2]] = min(best.get(r[2], (at(59), 10**9)), (r[1], r[0]))
    keep = sorted(b[1] for b in best.values())
    assert ids(got.kept) == keep
    assert ids(got.superseded) == sorted(set(range(600)) - set(keep))


def test_only_hot_identifiers_are_salted(spark, monkeypatch):
    """Ten identifiers of two deliveries and a hot one: with a low bound only the hot one is cut into salts."""
    monkeypatch.setattr(delivery, "HOT", 3)
    rows = [(i, at(i % 50), "hot" if i >= 20 else f"s{i // 2}", 1, "n", None, None) for i in range(200)]
    got = run(spark, rows, salts=8)
    assert ids(got.kept) == [*range(0, 20, 2), 50]
    assert len(ids(got.superseded)) == 200 - 11


def test_maps_and_clashing_names(spark):
    frame = spark.createDataFrame(
        [(1, at(2), "a", 1, "n", {"x": 1}, "r"), (2, at(1), "A", 1, "n", None, "r"), (3, at(1), "b", 1, "n", {}, None)],
        "delivery_id long, received_at timestamp, sha string, number int, name string, k0 map<string,int>, `c.0` string",
    )
    got = deliver_once(frame, key=[folded("sha"), F.col("number"), folded("name")], order=[F.col("received_at")], row_id=F.col("delivery_id"))
    assert ids(got.kept) == [2, 3] and ids(got.superseded) == [1]
    assert got.kept.columns == frame.columns


def test_payload_is_not_shuffled_for_ids(spark):
    frame = spark.createDataFrame([(1, at(1), "a", 1, "n", "payload", "w")] * 2, SCHEMA)
    got = deliver_once(frame, key=[folded("sha"), F.col("number"), folded("name")], order=[F.col("received_at")], row_id=F.col("delivery_id"))
    plan = got.superseded.select("delivery_id")._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Window" in line]
    assert shuffled and not any("c6#" in line for line in shuffled)
