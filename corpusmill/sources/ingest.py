"""Reading database exports and mapping them to one schema.

Header analysis is metadata work on the driver; rows are only touched by column
expressions. Everything is read as text, so ``0`` never becomes ``0.0``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import has_value, stripped, text
from corpusmill.sources import csv_records, workbooks

#: The canonical columns, in order.
CANONICAL = ("Authors", "Title", "Year", "Source title", "Cited by", "DOI", "Link", "Abstract")
KEYWORDS = ("Keywords", "Author Keywords", "Index Keywords", "IEEE Terms")
#: Headers that hold each canonical field, by source format.
ALIASES = {
    "IEEE": {"Authors": ("Authors",), "Title": ("Document Title",), "Year": ("Publication Year",), "Source title": ("Publication Title",), "Cited by": ("Article Citation Count",), "DOI": ("DOI",), "Link": ("PDF Link", "Link"), "Abstract": ("Abstract",)},
    "Scopus": {"Authors": ("Authors",), "Title": ("Title",), "Year": ("Year", "Publication Year"), "Source title": ("Source title", "Source Title"), "Cited by": ("Cited by", "Article Citation Count"), "DOI": ("DOI",), "Link": ("Link", "URL"), "Abstract": ("Abstract",)},
    "WOS": {"Authors": ("Authors",), "Title": ("Article Title",), "Year": ("Publication Year",), "Source title": ("Source Title",), "Cited by": ("Times Cited, All Databases",), "DOI": ("DOI",), "Link": ("DOI Link", "Link", "URL"), "Abstract": ("Abstract",)},
    "PubMed": {"Authors": ("Authors", "Author"), "Title": ("Title", "Article Title"), "Year": ("Year", "Publication Year"), "Source title": ("Journal", "Source Title"), "Cited by": ("Cited by", "Citations"), "DOI": ("DOI",), "Link": ("URL", "Link"), "Abstract": ("Abstract",)},
    "GoogleScholar": {"Authors": ("Authors", "Author"), "Title": ("Title", "Article Title"), "Year": ("Year", "Publication Year"), "Source title": ("Publication", "Journal", "Source title"), "Cited by": ("Citations", "Cited by"), "DOI": ("DOI",), "Link": ("URL", "Link"), "Abstract": ("Abstract",)},
    "Fallback": {"Authors": ("Authors", "Author"), "Title": ("Title", "Article Title", "Document Title"), "Year": ("Year", "Publication Year"), "Source title": ("Source title", "Source Title", "Publication Title"), "Cited by": ("Cited by", "Times Cited", "Times Cited, All Databases"), "DOI": ("DOI",), "Link": ("Link", "URL"), "Abstract": ("Abstract",)},
}
#: Texts that a spreadsheet reader takes for missing.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def classify(columns: list[str]) -> str:
    """Source format of a header; the first rule that holds decides."""
    have = {c.strip().lower() for c in columns}
    rules = (
        ("IEEE", ({"document title"}, {"article citation count"})),
        ("WOS", ({"ut (unique wos id)"}, {"times cited, all databases"}, {"article title"})),
        ("Scopus", ({"eid"}, {"title", "source title"})),
        ("PubMed", ({"pmid"}, {"pubmed id"}, {"journal"})),
        ("GoogleScholar", ({"citations"}, {"authors", "title", "year"})),
    )
    return next((name for name, options in rules if any(o <= have for o in options)), "Fallback")


def find_column(columns: list[str], candidates: list[str]) -> str | None:
    """First candidate that is a column, whatever its case."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    return next((low[x.lower()] for x in candidates if x.lower() in low), None)


def alias_columns(columns: list[str], aliases: list[str]) -> list[str]:
    """Columns that equal an alias in letters and digits, by order of the aliases."""
    plain = lambda x: re.sub(r"[^a-z0-9]+", "", x.lower())
    return list(dict.fromkeys(c for a in aliases for c in columns if plain(c) == plain(a)))


def _first(columns: list[str], names: tuple[str, ...], exact: bool) -> Column | None:
    found = [c for n in names for c in columns if (c == n if exact else c.strip().lower() == n.lower())]
    if not found:
        return None
    return F.coalesce(*[F.when(has_value(f"`{c}`"), text(F.col(f"`{c}`"))) for c in dict.fromkeys(found)], F.lit(""))


def harmonise(df: DataFrame, exact_headers: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The canonical columns of one export (and Keywords if the header has any).

    A missing link is made from the DOI. ``exact_headers`` looks values up with the
    case of the alias table; the default ignores case. ``carry`` columns stay.
    """
    own = [c for c in df.columns if c not in carry]
    table = ALIASES[classify(own)]
    out = {f: _first(own, table[f], exact_headers) for f in CANONICAL}
    out = {f: F.lit("") if v is None else v for f, v in out.items()}
    doi = stripped(out["DOI"])
    made = F.when(doi == "", F.lit("")).when(F.lower(doi).startswith("http"), doi).otherwise(F.concat(F.lit("https://doi.org/"), doi))
    out["Link"] = F.when(has_value(out["Link"]), out["Link"]).otherwise(made)
    keywords = _first(own, KEYWORDS, exact_headers)
    if keywords is not None:
        out["Keywords"] = keywords
    return df.select(*carry, *[v.alias(k) for k, v in out.items()])


def read_csv(spark: SparkSession, path: str | list[str], na_as_blank: bool = False, place: str | None = None) -> DataFrame:
    """All columns as text, embedded newlines and a byte order mark included; blank for missing.

    Many tasks read a file, line feeds in cells or not (:mod:`csv_records`). ``place``
    names a column that orders the rows as the files have them.
    """
    df = csv_records.read_table(spark, path, place)
    names = [c for c in df.columns if c != place]
    value = lambda c: F.when(F.col(f"`{c}`").isin(*NA_TEXTS), F.lit("")).otherwise(text(F.col(f"`{c}`"))) if na_as_blank else text(F.col(f"`{c}`"))
    df = df.select(*([place] if place else []), *[value(c).alias(c) for c in names])
    return df.where(reduce(lambda a, b: a | b, [stripped(F.col(f"`{c}`")) != "" for c in names])) if names else df


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of a workbook of any age as text; the file is read on the driver (its library is optional)."""
    import pandas as pd

    try:
        engine = "xlrd" if path.lower().endswith(".xls") else "openpyxl"
        table = pd.read_excel(path, sheet_name=0, dtype=str, keep_default_na=False, engine=engine)
    except ImportError as e:
        raise RuntimeError("reading workbooks needs the optional openpyxl or xlrd") from e
    return spark.createDataFrame(table.astype(str))


def read_workbook(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """First sheet of an .xlsx workbook as text under its header; ``place`` names a column of the rows' order. No other library is needed."""
    parsed = workbooks.parse_workbooks(spark.read.format("binaryFile").load(path))
    head = parsed.where("row = 0 or error is not null").limit(1).collect()
    if head and head[0]["error"]:
        raise ValueError(f"{path} is no readable workbook: {head[0]['error']}")
    if not head:
        return spark.createDataFrame([], f"`{place}` long" if place else "")
    names = csv_records.safe_names([c.strip() for c in head[0]["cells"]])
    rows = parsed.where("row > 0")
    return rows.select(*([F.col("row").alias(place)] if place else []), *[text(F.get("cells", F.lit(k))).alias(n) for k, n in enumerate(names)])


def read_json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row; missing or broken files give a row of nulls."""
    try:
        raw = spark.read.text(path, wholetext=True)
        raw.schema and raw.limit(1).count()
    except Exception:  # a missing file is an empty document
        raw = spark.createDataFrame([("{}",)], "value string")
    return raw.select(F.from_json("value", schema).alias("d")).select("d.*")


def merge_exports(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All known files in order, harmonised, with file_idx and row_idx; others are skipped."""
    parts = []
    for i, path in enumerate(paths):
        low = path.lower()
        if low.endswith(".csv"):
            raw = read_csv(spark, path, na_as_blank=True, place="row_idx")
        elif low.endswith(".xlsx"):
            raw = read_workbook(spark, path, place="row_idx")
        elif low.endswith(".xls"):
            raw = read_excel(spark, path).withColumn("row_idx", F.monotonically_increasing_id())
        else:
            continue
        if len(raw.columns) > 1:
            parts.append(harmonise(raw.withColumn("file_idx", F.lit(i)), carry=("file_idx", "row_idx")))
    if not parts:
        schema = ", ".join(f"`{c}` string" for c in CANONICAL) + ", file_idx int, row_idx long"
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


JOB_ID = re.compile(r"[A-Za-z0-9._-]{1,128}\Z")


def read_run(spark: SparkSession, root: str, job_id: str) -> DataFrame:
    """Rows of one persisted run: only its partition is read. The id cannot leave the folder."""
    if not JOB_ID.match(job_id) or job_id in (".", ".."):
        raise ValueError("invalid job id")
    return spark.read.parquet(root).where(F.col("job_id") == job_id)


def reported_total(c: Column | str) -> Column:
    """Number before "results", whatever separates its digits; null if there is none."""
    found = F.regexp_extract(text(c), r"(?i)([0-9][0-9\s,.'’  ]*)\s+results?\b", 1)
    return F.regexp_replace(found, r"\D", "").try_cast("bigint")


def shown_range(c: Column | str) -> Column:
    """struct<first,last,total> of "Showing a-b of n results"; null unless it makes sense."""
    rule = r"(?i)Showing\s+([\d,]+)\s*[-–]\s*([\d,]+)\s+of\s+([\d,]+)\s+results"
    part = lambda i: F.replace(F.regexp_extract(text(c), rule, i), F.lit(","), F.lit("")).try_cast("bigint")
    one = text(c).rlike(r"(?i)Showing\s+1\s+of\s+1\s+result\b")
    first, last, total = (F.when(one & part(i).isNull(), F.lit(1)).otherwise(part(i)) for i in (1, 2, 3))
    return F.when((first > 0) & (last >= first) & (total >= last), F.struct(first.alias("first"), last.alias("last"), total.alias("total")))


def result_count(c: Column | str) -> Column:
    """Number of a text that is only "n results"."""
    return F.replace(F.regexp_extract(stripped(c), r"(?i)^([\d,]+)\s+results?$", 1), F.lit(","), F.lit("")).try_cast("bigint")


def query_parameter(url: Column | str, name: str) -> Column:
    return F.try_parse_url(text(url), F.lit("QUERY"), F.lit(name))


def start_offset(url: Column | str) -> Column:
    """The start parameter as a whole number; 0 if it is missing or none."""
    n = query_parameter(url, "start").try_cast("bigint")
    return F.when(n >= 0, n).otherwise(F.lit(0)).cast("bigint")


def same_query(url: Column | str, name: str, query: Column | str) -> Column:
    """Whether a parameter is the query, bare or in one pair of brackets."""
    value = F.url_decode(query_parameter(url, name))
    return F.coalesce((value == text(query)) | (value == F.concat(F.lit("("), text(query), F.lit(")"))), F.lit(False))


def inspect_csv(spark: SparkSession, path: str, expected_rows: int | None = None, required: tuple[str, ...] = ("authors", "title", "year")) -> dict:
    """Quality of an exported CSV: kind, header, row count, row widths.

    Rows of blank cells only are no rows.
    """
    out: dict = {"ok": False, "bibtex_like": False, "row_count": 0, "header": [], "errors": []}
    found = csv_records.records(spark, path)
    first = found.where("first").orderBy("place").limit(1).collect()  # the header of the first file
    head = first[0]["record"].lstrip("\ufeff") if first else ""
    if not head.strip():
        return out | {"errors": ["CSV body is empty"]}
    if re.match(r"(?i)^@[a-z][a-z0-9_-]*\s*\{", head.strip()):
        return out | {"bibtex_like": True, "errors": ["export body is BibTeX, not CSV"]}
    cells = csv_records.header_of(found)
    width = len(cells)
    header = [" ".join(v.lstrip("\ufeff").split()) for v in cells]
    names = [f"c{i}" for i in range(width)]
    # a record with another number of cells than the header counts as broken; every file repeats the header
    table = found.where(~F.col("first")).select(csv_records.cells(F.col("record"), names, broken="broken").alias("r")).select("r.*")
    some = reduce(lambda a, b: a | b, [stripped(F.col(n)) != "" for n in names])
    bad = F.col("broken").isNotNull()
    count = table.where(some).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    rows = count["n"]
    missing = [r for r in required if r not in [h.lower() for h in header]]
    errors = [f"CSV header is missing: {', '.join(missing)}"] * bool(missing)
    errors += [f"{count['bad']} CSV row(s) do not match the header column count"] * bool(count["bad"])
    errors += [f"CSV row count {rows} does not match expected {expected_rows}"] * (expected_rows is not None and rows != expected_rows)
    return out | {"header": header, "row_count": rows, "errors": errors, "ok": not errors and width >= 3}
