"""Helpers that every operator uses."""

from pyspark.sql import functions as F

from evidencia import runtime


def test_hash_sample_is_bounded_and_the_same_in_any_partitioning(spark):
    df = spark.range(5000)
    want = [r[0] for r in df.orderBy(F.xxhash64("id")).limit(40).collect()]
    for parts in (1, 7):
        assert [r[0] for r in runtime.hash_sample(df.repartition(parts), F.col("id"), 40).collect()] == want
    assert runtime.hash_sample(df.limit(3), F.col("id"), 40).count() == 3
    assert runtime.hash_sample(df.limit(0), F.col("id"), 40).count() == 0


def test_free_name_and_column(spark):
    df = spark.range(1).withColumn("a.b", F.lit(1)).withColumn("__H", F.lit(2))
    assert runtime.free_name(df, "__h") == "__h_1"
    assert df.select(runtime.col(df, "a.b")).first()[0] == 1


def test_bounded_broadcast(spark):
    plan = lambda d: d._jdf.queryExecution().toString()
    assert "broadcast" in plan(runtime.bounded_broadcast(spark.range(5), 5, "x"))
    assert "broadcast" not in plan(runtime.bounded_broadcast(spark.range(6), 5, "x"))


def test_cut_keeps_rows(spark):
    assert runtime.cut(spark.range(10)).count() == 10
