"""First sheets of workbooks, a task for each file, rows as they come out of the zipped XML.

Spark reads the files as bytes (so any store that it knows will do); tasks unzip and
parse them with the standard library. Cells come as text, as they stand in the file: ``0``
stays ``0``. Blank cells are blank, rows of blank cells only are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces and paths of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
WORKBOOK, LINKS, STRINGS = "xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml"
#: Characters that XML cannot hold stand as _xHHHH_.
CODED, FORBIDDEN = re.compile(r"_x([0-9A-Fa-f]{4})_"), re.compile(r"[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")
BATCH = 2_000


def _plain(text: str) -> str:
    return CODED.sub(lambda m: chr(int(m[1], 16)), text)


def _text(node) -> str:
    """The text of a string item: its own and that of its runs, but not of phonetic hints."""
    runs = [t for r in node.findall(f"{MAIN}r") for t in r.findall(f"{MAIN}t")]
    return _plain("".join(t.text or "" for t in [*node.findall(f"{MAIN}t"), *runs]))


def _column(reference: str) -> int:
    """Place of a cell by the letters of its reference, from 0."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """Cells of the rows of the first sheet, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        first = ElementTree.parse(book.open(WORKBOOK)).getroot().find(f"{MAIN}sheets/{MAIN}sheet")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open(LINKS)).getroot()}
        target = targets[first.get(LINK)]
        strings = [_text(s) for s in ElementTree.parse(book.open(STRINGS)).getroot()] if STRINGS in book.namelist() else []
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        for _, row in ElementTree.iterparse(book.open(path)):
            if row.tag != f"{MAIN}row":
                continue
            cells: list[str] = []
            for k, c in enumerate(row.findall(f"{MAIN}c")):
                at = _column(c.get("r")) if c.get("r") else k
                cells += [""] * (at + 1 - len(cells))
                value, kind = c.find(f"{MAIN}v"), c.get("t", "n")
                if kind == "inlineStr":
                    cells[at] = _text(c.find(f"{MAIN}is"))
                elif value is not None and value.text is not None:
                    cells[at] = strings[int(value.text)] if kind == "s" else _plain(value.text)
            row.clear()
            if any(x.strip() for x in cells):
                yield cells


def workbook(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet of texts."""
    coded = lambda x: escape(FORBIDDEN.sub(lambda m: f"_x{ord(m[0]):04X}_", x))
    body = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{coded(x)}</t></is></c>' for x in r) + "</row>" for r in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(WORKBOOK, f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr(LINKS, f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINK[1:-3]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def parse_workbooks(files: DataFrame) -> DataFrame:
    """(path, row, cells, error) of files (path, content): ``row`` counts from 0, the header; a broken file has one row with its error."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                held: list[tuple] = []
                n = 0
                try:
                    for cells in sheet_rows(content):
                        held.append((path, n, cells, None))
                        n += 1
                        if len(held) == BATCH:
                            yield pd.DataFrame(held, columns=["path", "row", "cells", "error"])
                            held = []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, AttributeError, IndexError, ValueError) as e:
                    held.append((path, None, None, f"{type(e).__name__}: {e}"))
                out = pd.DataFrame(held, columns=["path", "row", "cells", "error"])
                yield out.assign(row=out["row"].astype("Int64"))

    return files.select("path", "content").mapInPandas(run, "path string, row long, cells array<string>, error string")


def read_workbooks(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """(path, row) and the columns ``names`` of all workbooks: each file's own header says where they stand; blank where it has none."""
    paths = [path] if isinstance(path, str) else path
    return named_rows(parse_workbooks(spark.read.format("binaryFile").load(paths)), names)


def named_rows(parsed: DataFrame, names: list[str]) -> DataFrame:
    """(path, row) and the columns ``names`` of parsed workbooks."""
    headers = parsed.where("row = 0").select(F.col("path").alias("of"), F.transform("cells", lambda c: F.lower(F.trim(c))).alias("header"))
    place = lambda n: F.array_position("header", F.lit(n.lower())).cast("int")
    rows = parsed.where("row > 0").join(headers, F.col("path") == F.col("of"))
    return rows.select("path", "row", *[F.coalesce(F.when(place(n) > 0, F.get("cells", place(n) - 1)), F.lit("")).alias(n) for n in names])
