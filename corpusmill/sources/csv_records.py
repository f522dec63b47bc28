"""CSV records of files that many tasks read, line feeds in cells included.

Spark's text source splits a file into blocks of lines. Whether a line begins
inside a quoted cell depends on all lines before it, so each block is first read
under both assumptions: its effect is a pair of states (from outside, from inside),
and pairs compose. A prefix scan over the blocks of a file gives the true state at the
start of each block; a second scan cuts records. Only a record that runs over the end of a
block is put together from pieces, at most two of which come from a block.

Blocks have to be cut alike in both scans. ``spark.sql.files.minPartitionNum``, on which
their size depends, is therefore set to its present value if the session sets none,
and a block that the first scan has not seen is an error, never a wrong record.

Lines end with a line feed, with or without a carriage return before it; a carriage
return alone is part of a cell. A byte order mark is dropped. Empty lines are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
#: Bits of a record's place that count within its file.
FILE_BITS = 42
WHOLE, TAIL, HEAD = 0, 1, 2


def open_at_end(line: str, inside: bool) -> bool:
    """Whether the end of ``line`` is inside a quoted cell, if its start is (or is not)."""
    at, n = 0, len(line)
    while True:
        if not inside:
            # at the start of a cell: only a quote there opens it
            while at < n and line[at] != '"':
                at = line.find(",", at) + 1
                if not at:
                    return False
            if at >= n:
                return False
            at, inside = at + 1, True
        # inside: the first run of an odd number of quotes closes the cell, and the cell ends at the next comma
        while True:
            at = line.find('"', at)
            if at < 0:
                return True
            end = at
            while end < n and line[end] == '"':
                end += 1
            odd, at = (end - at) % 2, end
            if odd:
                break
        at = line.find(",", at) + 1
        if not at:
            return False
        inside = False


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _effects(lines: DataFrame) -> DataFrame:
    """(file, block, outside, inside): the state after each block, by its state before."""

    def run(batches: Iterator[pa.RecordBatch]):
        now, states = None, [False, True]
        for batch in batches:
            files, blocks, values = batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()
            for file, block, line in zip(files, blocks, values, strict=True):
                if (file, block) != now:
                    if now:
                        yield _row(now, states)
                    now, states = (file, block), [False, True]
                if line is not None:
                    states = [open_at_end(line, s) for s in states]
        if now:
            yield _row(now, states)

    def _row(now, states):
        return pa.RecordBatch.from_pylist([{"file": now[0], "block": now[1], "outside": states[0], "inside": states[1]}])

    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    return lines.select("file", "block", quoted.alias("value")).mapInArrow(run, "file string, block long, outside boolean, inside boolean")


def block_states(effects: DataFrame) -> dict[tuple[str, int], tuple[int, bool]]:
    """Number of its file and state at its start, of each block: the prefix scan over their effects.

    A row a block (128 MB by default) comes to the driver.
    """
    rows = sorted((r["file"], r["block"], r["outside"], r["inside"]) for r in effects.collect())
    out, last, number, state = {}, None, -1, False
    for file, block, outside, inside in rows:
        if file != last:
            last, number, state = file, number + 1, False
        out[file, block] = (number, state)
        state = inside if state else outside
    return out


def _pieces(lines: DataFrame, states: dict) -> DataFrame:
    """(place, piece, kind, first): whole records, and what of a record stands in a block."""
    shipped = lines.sparkSession.sparkContext.broadcast(states)
    schema = pa.schema([("place", pa.int64()), ("piece", pa.string()), ("kind", pa.int32()), ("first", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]):
        known = shipped.value
        now, number, state, at, kind, first, start, held = None, 0, False, 0, WHOLE, True, 0, []
        out: list[tuple] = []

        def close(k: int):
            nonlocal first, held
            piece = "\n".join(held)
            if k == WHOLE:
                piece = piece.removesuffix("\r")
            if piece or k != WHOLE:
                out.append(((number << FILE_BITS) + start, piece, k, first and now[1] == 0))
                first = False
            held = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            files, blocks, values = batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value").to_pylist()
            for file, block, line in zip(files, blocks, values, strict=True):
                if (file, block) != now:
                    if held:
                        close(HEAD if kind == HEAD else TAIL)
                    now, at, first = (file, block), 0, True
                    if now not in known:
                        raise ValueError(f"{file} was cut differently at byte {block} than before; read it again")
                    number, state = known[now]
                    kind, start = (HEAD if state else WHOLE), block
                if not held and kind == WHOLE:
                    start = block + at
                held.append(line)
                at += 1
                if '"' in line:
                    state = open_at_end(line, state)
                if not state:
                    close(kind)
                    kind = WHOLE
            if out:
                yield batch_of()
                out.clear()
        if held:
            close(HEAD if kind == HEAD else TAIL)
        if out:
            yield batch_of()

    return lines.select("file", "block", "value").mapInArrow(run, "place long, piece string, kind int, first boolean")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(place, record, first) of all records: ``place`` orders them by file and place in it, ``first`` marks the first of a file."""
    lines = _lines(spark, path)
    found = _pieces(lines, block_states(_effects(lines)))
    whole = found.where(F.col("kind") == WHOLE).select("place", F.col("piece").alias("record"), "first")
    # an open end, and the heads of the next blocks up to the one that closes it
    file = F.shiftright("place", FILE_BITS)
    in_order = Window.partitionBy(file).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = found.where(F.col("kind") != WHOLE).withColumn("open", F.max(F.when(F.col("kind") == TAIL, F.col("place"))).over(in_order))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "\n")
    joined = cut.groupBy(F.col("open").alias("place")).agg(F.regexp_replace(text, "\r$", "").alias("record"), F.bool_or("first").alias("first"))
    return whole.unionByName(joined)


def header_of(found: DataFrame) -> list[str]:
    """Cells of the first record of the first file."""
    import csv

    head = found.where("first").orderBy("place").limit(1).collect()
    return next(csv.reader([head[0]["record"].lstrip("﻿")], doublequote=True)) if head else []


def safe_names(header: list[str]) -> list[str]:
    """Column names: a number for a blank one, and a number after those that differ only in case."""
    low = [h.lower() for h in header]
    return [f"_c{i}" if not h else f"{h}{i}" if low.count(h.lower()) > 1 else h for i, h in enumerate(header)]


def cells(record: Column, names: list[str], broken: str | None = None) -> Column:
    """The cells of a record as text; ``broken`` names a cell that holds records of another width."""
    options = OPTIONS | ({"columnNameOfCorruptRecord": broken} if broken else {})
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, *([broken] if broken else [])])
    return F.from_csv(record, schema, options)


def read_table(spark: SparkSession, path: str | list[str], place: str | None = None) -> DataFrame:
    """All columns as text under the header of the first file; ``place`` names a column of their order."""
    found = records(spark, path)
    names = safe_names(header_of(found))
    if not names:
        return spark.createDataFrame([], f"`{place}` long" if place else "")
    plain = [f"c{i}" for i in range(len(names))]
    row = found.where(~F.col("first")).select("place", cells(F.col("record"), plain).alias("c"))
    return row.select(*([F.col("place").alias(place)] if place else []), *[F.col(f"c.{p}").alias(n) for p, n in zip(plain, names, strict=True)])
