from pyspark.sql import functions as F

from lathework.plans import skew


def test_join_keyed_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HEAVY", 4)
    rows = spark.range(1000).selectExpr("IF(id % 3 = 0, 0, IF(id % 50 = 1, NULL, id % 40)) AS k", "id AS v")
    keyed = rows.filter("k IS NOT NULL AND k % 5 <> 2").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    for how in ("inner", "left"):
        got = skew.join_keyed(rows, keyed, ["k"], F.col("n"), 1000, how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(keyed, ["k"], how).collect()), key=str)
        assert skew.join_keyed(rows.filter("v < 0"), keyed, ["k"], F.col("n"), 0, how).collect() == []
