"""Set reconciliation by tables of cells, against the exact join."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import audit, reconcile


@pytest.mark.parametrize(("gone", "new"), [(0, 0), (3, 0), (40, 25), (900, 700)])
def test_agrees_with_the_join(spark, gone, new):
    whole = spark.range(5000).withColumn("k", F.concat(F.lit("id "), F.col("id").cast("string")))
    other = whole.where(F.col("id") >= gone).unionByName(spark.range(10_000, 10_000 + new).withColumn("k", F.col("id").cast("string"))).repartition(5)
    named = reconcile.difference_ids(whole, other, "k", 1024)
    assert (named is None) == (gone + new > 1024)
    assert named is None or len(set(named)) == gone + new
    expected = sorted(map(tuple, audit.set_audit(whole, other, "k").collect()))
    assert sorted(map(tuple, reconcile.reconcile(whole, other, "k", 1024).collect())) == expected and len(expected) == gone + new


def test_repeated_ids_are_compared_as_sets(spark):
    twice = spark.range(50).union(spark.range(20))
    for a, b in ((twice, spark.range(50)), (spark.range(45), twice), (spark.range(60).union(spark.range(55, 60)), spark.range(50)), (spark.range(0), spark.range(0))):
        assert sorted(map(tuple, reconcile.reconcile(a, b, "id").collect())) == sorted(map(tuple, audit.set_audit(a, b, "id").collect()))
