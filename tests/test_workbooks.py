"""Workbooks parsed in tasks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import ingest, workbooks

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def changed(rows, sheet, strings=None):
    """A workbook whose sheet is replaced."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbooks.workbook(rows))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, SHEET.format(sheet) if "sheet1" in name else old.read(name))
        if strings:
            new.writestr(workbooks.STRINGS, strings)
    return out.getvalue()


def test_round_trip_of_texts():
    rows = [["Title", "Cited by"], ["a <b> & \"c\"\nline\r\n\x0b", "0"], [" padded ", "_x000B_"], ["é日本\U0001f600", ""]]
    assert list(workbooks.sheet_rows(workbooks.workbook([*rows, ["", " "], []]))) == rows


def test_cells_of_other_kinds():
    sheet = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="C3"><v>2001</v></c></row><row r="4"><c r="AA4" t="b"><v>1</v></c><c r="AB4" t="str"><f>A1</f><v>x</v></c></row>'
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Title</t></si><si><r><t>Ye</t></r><r><t>ar</t></r><rPh><t>no</t></rPh></si></sst>'
    got = list(workbooks.sheet_rows(changed([["x"]], sheet, strings)))
    assert got[0] == ["Title", "", "Year"] and got[1] == ["", "", "2001"] and got[2][26:] == ["1", "x"]


def test_a_folder_of_workbooks(spark, tmp_path):
    for i in range(6):
        header = ["Title", "Year"] if i % 2 else ["year", "TITLE ", "Other"]
        rows = [[f"t{i}-{j}", "2001"] if i % 2 else ["2001", f"t{i}-{j}"] for j in range(30)]
        (tmp_path / f"{i}.xlsx").write_bytes(workbooks.workbook([header, *rows]))
    (tmp_path / "7.xlsx").write_bytes(b"PK broken")
    got = workbooks.read_workbooks(spark, str(tmp_path), ["Title", "Year", "DOI"])
    assert sorted(r["Title"] for r in got.collect()) == sorted(f"t{i}-{j}" for i in range(6) for j in range(30))
    assert {(r["Year"], r["DOI"]) for r in got.collect()} == {("2001", "")}
    bad = workbooks.parse_workbooks(spark.read.format("binaryFile").load(str(tmp_path))).where("error is not null").collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("7.xlsx") and bad[0]["error"].startswith("BadZipFile")
    assert workbooks.named_rows(workbooks.parse_workbooks(spark.read.format("binaryFile").load(str(tmp_path)).where(F.lit(False))), ["a"]).count() == 0


def test_merging_a_workbook_with_csv(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbooks.workbook([["Title", "Abstract", "DOI", "Year"], ["One", "long\ntext", "10.1/a", "2001"], ["Two", "", "", "0"]]))
    (tmp_path / "b.csv").write_text('Title,Abstract,DOI,Year\nThree,"x\ny",,2002\n')
    rows = ingest.merge_exports(spark, [str(tmp_path / "a.xlsx"), str(tmp_path / "b.csv")]).orderBy("file_idx", "row_idx").collect()
    assert [(r["file_idx"], r["Title"], r["Abstract"], r["Year"], r["Link"]) for r in rows] == [(0, "One", "long\ntext", "2001", "https://doi.org/10.1/a"), (0, "Two", "", "0", ""), (1, "Three", "x\ny", "2002", "")]
    (tmp_path / "c.xlsx").write_bytes(b"PK")
    with pytest.raises(ValueError, match="no readable workbook"):
        ingest.read_workbook(spark, str(tmp_path / "c.xlsx"))
