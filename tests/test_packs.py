"""Packs appear as a whole."""

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import packs


def test_a_killed_run_leaves_the_earlier_pack(spark, tmp_path):
    root = str(tmp_path / "pack")
    a, b = spark.range(10).withColumn("t", F.lit("x")), spark.range(3)
    assert packs.versions(spark, root) == []
    with pytest.raises(packs.PackError):
        packs.read_part(spark, root, "a")
    assert packs.publish({"a": a, "b": b, "none": b.limit(0)}, root) == 1
    broken = b.select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        packs.publish({"a": a.union(a), "b": broken}, root)
    assert packs.versions(spark, root) == [1] and packs.read_part(spark, root, "a", verify=True).count() == 10
    assert packs.read_part(spark, root, "none", verify=True).count() == 0
    assert packs.publish({"a": a.union(a)}, root) == 2
    assert packs.read_part(spark, root, "a").count() == 20 and packs.read_part(spark, root, "b", version=1).count() == 3
    with pytest.raises(packs.PackError, match="no part"):
        packs.read_part(spark, root, "b")
    assert packs.expire(spark, root, keep=1) == 2  # the first pack, and what the killed run had staged
    assert packs.versions(spark, root) == [2] and packs.read_part(spark, root, "a", verify=True).count() == 20


def test_two_runs_cannot_have_one_number(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "pack")
    packs.publish({"a": spark.range(2)}, root)
    monkeypatch.setattr(packs, "versions", lambda *a: [])
    with pytest.raises(packs.PackError, match="another run"):
        packs.publish({"a": spark.range(5)}, root)
    monkeypatch.undo()
    assert packs.read_part(spark, root, "a").count() == 2


def test_changed_parts_are_found(spark, tmp_path):
    root = str(tmp_path / "pack")
    packs.publish({"a": spark.range(4)}, root)
    spark.range(1, 5).write.mode("overwrite").parquet(f"{root}/{packs.manifest(spark, root)['parts']['a']['path']}")
    assert packs.read_part(spark, root, "a").count() == 4
    with pytest.raises(packs.PackError, match="not what was published"):
        packs.read_part(spark, root, "a", verify=True)
