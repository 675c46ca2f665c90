"""Drill-down validation: the same differences as a whole comparison, and few rows read."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import drilldown, reconcile


@pytest.fixture(scope="module")
def source(spark):
    return spark.range(20_000).select(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("a"), F.col("id").alias("b"), (F.col("id") * 3).alias("v"))


def test_few_differences_read_few_rows(spark, source, tmp_path):
    source.sort("a", "b").write.parquet(str(tmp_path / "s"))
    s = spark.read.parquet(str(tmp_path / "s"))
    t = s.filter("b <> 777").withColumn("v", F.when(F.col("b") == 5000, -1).otherwise(F.col("v"))).unionByName(spark.createDataFrame([("zz", 1, 1), (None, 2, 2)], s.schema))
    found, levels = drilldown.drill_down(s, t, ["a", "b"], fanout=16, leaf_rows=300)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("k17", 777, "insert"), ("k0", 5000, "update"), ("zz", 1, "delete"), (None, 2, "delete")], key=str)
    assert levels[0].rows == 40_001 and levels[0].differing <= 4
    assert levels[1].rows <= 4 * 2 * 2 * 20_000 / 16 and len(levels) <= 3
    part = drilldown.KeyRange("x", ("a", "b"), ("k17", 5), ("k18", 1))
    assert "PushedFilters: [Or" in (plan := drilldown.within(s, [part, part])._jdf.queryExecution().toString()) or "GreaterThanOrEqual(a,k17)" in plan


def test_equal_and_wholly_different_tables(spark, source):
    found, levels = drilldown.drill_down(source, source.repartition(3), ["b"], fanout=8, leaf_rows=100)
    assert found.count() == 0 and [(x.ranges, x.differing) for x in levels] == [(8, 0)]
    other = source.withColumn("v", F.lit(0)).filter("b % 2 = 0")
    found, _ = drilldown.drill_down(source.limit(500), other.limit(0), ["b"], fanout=4, leaf_rows=50)
    assert found.filter("action = 'insert'").count() == 500
    got, want = drilldown.drill_down(source, other, ["b"], fanout=4, leaf_rows=4000)[0], reconcile.diff(source, other, ["b"])
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    assert drilldown.drill_down(source.limit(0), source.limit(0), ["b"])[0].count() == 0


def test_a_key_that_many_rows_share_is_a_leaf(spark):
    s = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    found, levels = drilldown.drill_down(s, s.filter("v <> 5"), ["k"], ["k", "v"], fanout=4, leaf_rows=10)
    assert len(levels) == 1 and found is not None
