from pyspark.sql import functions as F

from lathework.operators.balance import PARTITIONS, balanced_totals, heavy_keys


def test_totals_match_brute_force_with_hot_key(spark):
    rows = [("hot" if i % 2 else (None if i % 10 == 0 else f"k{i % 7}"), i % 97 if i % 5 else None, i % 13 if i % 11 else None) for i in range(4000)]
    frame = spark.createDataFrame(rows, "k string, at int, v int")
    got = {r.key: r for r in balanced_totals(frame, F.col("k"), F.col("at"), {"v": F.col("v")}, partitions=8).collect()}
    want = {}
    for k, _, v in rows:
        n, s = want.get(k, (0, 0))
        want[k] = (n + 1, s + (v or 0))
    assert {k: (r.row_count, r.v) for k, r in got.items()} == want
    assert got["hot"].pieces > 1


def test_heavy_keys_are_spread_by_default(spark):
    """Also when most rows of the heavy key agree in the secondary order, and without a stated number of partitions."""
    rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END AS k", "IF(id % 2 = 0, NULL, id) AS at", "id AS v")
    by = {r.key: r for r in balanced_totals(rows, F.col("k"), F.col("at"), {"v": F.col("v")}).collect()}
    assert by["hot"].row_count == 2000 and by["hot"].pieces >= 10
    assert sum(r.v for r in by.values()) == 6000 * 5999 // 2


def test_no_partition_holds_the_bulk(spark):
    rows = spark.range(20_000).selectExpr("IF(id % 3 > 0, 'hot', concat('k', id % 50)) AS k", "id AS at")
    ranged = rows.repartitionByRange(PARTITIONS, "k", "at")
    sizes = [r["count"] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 20_000 / PARTITIONS * 1.5


def test_empty(spark):
    frame = spark.createDataFrame([], "k string, at int, v int")
    assert balanced_totals(frame, F.col("k"), F.col("at"), {"v": F.col("v")}).collect() == []


def test_heavy_keys_count_null_rows_in_the_total(spark):
    totals = spark.createDataFrame([("t", "a", 5), ("t", "b", 4), ("t", None, 91), ("u", "a", 1)], "table_name string, repository_id string, row_count long")
    assert sorted(map(tuple, heavy_keys(totals).collect())) == [("t", "a"), ("u", "a")]
