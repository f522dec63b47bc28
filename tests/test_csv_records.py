"""The reader of CSV blocks against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import csv_records, ingest

WHOLE = {"multiLine": True, "quote": '"', "escape": '"', "header": True, "mode": "PERMISSIVE"}


@pytest.fixture
def small_blocks(spark):
    """Files are cut every 64 bytes."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(draw) -> str:
    value = "".join(draw.choice(["a", "b", '"', "\n", ",", " ", "é", '""']) for _ in range(draw.randint(0, 14)))
    return '"' + value.replace('"', '""') + '"' if draw.random() < 0.7 else value.replace("\n", "").replace(",", "").lstrip('"')


@pytest.mark.parametrize("seed", range(6))
def test_fuzzed_files_read_as_whole_ones(spark, small_blocks, tmp_path, seed):
    draw = random.Random(seed)
    eol = draw.choice(["\n", "\r\n"])
    rows = [",".join(cell(draw) for _ in range(3)) for _ in range(draw.randint(1, 50))]
    (tmp_path / "a.csv").write_bytes((eol.join(["h,i,j", *rows]) + draw.choice(["", eol])).encode())
    path = str(tmp_path / "a.csv")
    expected = [tuple(r) for r in spark.read.csv(path, **WHOLE).collect()]
    got = csv_records.read_table(spark, path, "place").orderBy("place").drop("place")
    assert got.columns == ["h", "i", "j"]
    assert [tuple(r) for r in got.collect()] == expected


def test_a_cell_over_many_blocks(spark, small_blocks, tmp_path):
    long = "line of a cell, with a comma\n" * 40
    (tmp_path / "a.csv").write_text('﻿k,v\n1,"' + long + '"\n\n2,x\n"","' + long + 'y"\n', encoding="utf-8")
    rows = ingest.read_csv(spark, str(tmp_path / "a.csv"), place="at").orderBy("at").collect()
    assert [(r["k"], r["v"]) for r in rows] == [("1", long), ("2", "x"), ("", long + "y")]
    assert csv_records._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20


def test_a_folder_of_files(spark, small_blocks, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("k,v\n" + "".join(f'{i}-{j},"a\n""b"""\n' for j in range(20)))
    rows = ingest.read_csv(spark, str(tmp_path), place="at").orderBy("at").collect()
    assert [r["k"] for r in rows] == [f"{i}-{j}" for i in range(3) for j in range(20)]
    assert {r["v"] for r in rows} == {'a\n"b"'} and len({r["at"] for r in rows}) == 60


def test_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,,name,x\n1,2,3,4\n")
    assert csv_records.read_table(spark, str(tmp_path / "a.csv")).columns == ["Name0", "_c1", "name2", "x"]
    (tmp_path / "b.csv").write_text("")
    assert csv_records.read_table(spark, str(tmp_path / "b.csv")).count() == 0
    assert ingest.inspect_csv(spark, str(tmp_path / "b.csv"))["errors"] == ["CSV body is empty"]


def test_blocks_cut_differently_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n")
    lines = csv_records._lines(spark, str(tmp_path / "a.csv"))
    with pytest.raises(Exception, match="cut differently"):
        csv_records._pieces(lines, {}).collect()


def test_states_compose(spark):
    effects = spark.createDataFrame([("f", 0, True, False), ("f", 9, True, False), ("f", 20, False, True), ("g", 0, False, False)], "file string, block long, outside boolean, inside boolean")
    assert csv_records.block_states(effects) == {("f", 0): (0, False), ("f", 9): (0, True), ("f", 20): (0, False), ("g", 0): (1, False)}


def test_inspection_of_many_parts(spark, small_blocks, tmp_path):
    table = spark.range(200).select(F.lit("a").alias("authors"), F.concat(F.lit('t, "q"\n'), F.col("id").cast("string")).alias("title"), F.lit("2001").alias("year"))
    table.repartition(5).write.csv(str(tmp_path / "out"), header=True, quote='"', escape='"')
    got = ingest.inspect_csv(spark, str(tmp_path / "out"), expected_rows=200)
    assert got["ok"] and got["row_count"] == 200 and got["header"] == ["authors", "title", "year"]
    (tmp_path / "bad.csv").write_text("authors,title,year\na,b\na,b,c\n, ,\na,b,c,d\n")
    got = ingest.inspect_csv(spark, str(tmp_path / "bad.csv"))
    assert got["row_count"] == 3 and got["errors"] == ["2 CSV row(s) do not match the header column count"]
