"""Joins of hot keys and the key filter."""

from collections import Counter

from pyspark.sql import functions as F

from lineweave.llm import common
from lineweave.llm.common import join_hot, marked_rows


def test_marked_rows_miss_no_key(spark, monkeypatch):
    rows = spark.range(-5000, 5000).select(F.col("id").alias("a.key"), F.col("id").alias("words"))
    marked = spark.range(-5000, 5000, 37).select(F.xxhash64("id").alias("k")).unionByName(spark.range(0, 5000, 41).select(F.col("id").alias("k")))
    for bits in (common.FILTER_BITS, 1 << 12):
        monkeypatch.setattr(common, "FILTER_BITS", bits)
        touched, untouched = marked_rows(rows, marked, "a.key")
        assert touched.columns == rows.columns
        inside = {r[0] for r in touched.collect()}
        outside = {r[0] for r in untouched.collect()}
        assert inside | outside == set(range(-5000, 5000))
        assert not inside & outside
        assert set(range(0, 5000, 41)) <= inside
    none = spark.createDataFrame([], "k long")
    touched, untouched = marked_rows(rows, none, "a.key")
    assert (touched.count(), untouched.count()) == (0, 10_000)


def test_join_hot_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 10)
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 300).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 9").withColumn("name", F.concat(F.lit("g"), "k"))
    got = Counter(tuple(r) for r in join_hot(rows, groups, ["k"], "n").select("k", "id", "n", "name").collect())
    assert got == Counter(tuple(r) for r in rows.join(groups, "k").select("k", "id", "n", "name").collect())
    got = join_hot(rows, groups, ["k"], "n", "left")
    assert got.count() == 3000


def test_batches_are_bounded_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for given, want in ((10_000, common.BATCH_ROWS), (7, 7)):
            spark.conf.set(name, given)
            common.bounded_batches(spark)
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
