"""Survivorship and grouping on hand-made records."""

import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusmill.operators.dedup import consolidate
from corpusmill.sources.ingest import classify, harmonise, merge_exports

FIELDS = ["Title", "DOI", "Abstract", "Authors", "Keywords", "Year"]
SCHEMA = "ord long, " + ", ".join(f"`{f}` string" for f in FIELDS)


def fold(spark, rows, **options):
    data = [(i, *[r.get(f) for f in FIELDS]) for i, r in enumerate(rows)]
    out = consolidate(spark.createDataFrame(data, SCHEMA), ["ord"], **options).orderBy("ord").collect()
    return [r.asDict() for r in out]


@pytest.mark.parametrize("blank", ["", "  \t", None])
def test_blank_never_overwrites(spark, blank):
    full = {"Title": "T", "DOI": "10.1/x", "Abstract": "long text", "Authors": "A", "Year": "2020"}
    for rows in ([full, full | {"Abstract": blank, "Authors": blank}], [full | {"Abstract": blank, "Authors": blank}, full]):
        got = fold(spark, rows)
        assert len(got) == 1 and got[0]["Abstract"] == "long text" and got[0]["Authors"] == "A" and got[0]["group_size"] == 2


def test_richest_base_and_safe_extension(spark):
    rows = [
        {"Title": "T", "DOI": "10.1/x", "Abstract": "we study…", "Year": "2020"},
        {"Title": "Other", "DOI": "10.1/X ", "Abstract": "We  study cells in mice", "Authors": "A"},
        {"Title": "T", "DOI": "10.1/x", "Authors": "A; B"},
    ]
    (got,) = fold(spark, rows)
    assert got["Title"] == "Other" or got["Title"] == "T"
    assert got["Abstract"] == "We  study cells in mice" and got["Authors"] == "A; B" and got["Year"] == "2020"


def test_conflict_of_equals_keeps_the_first(spark):
    (got,) = fold(spark, [{"DOI": "d", "Title": "one", "Abstract": "x y"}, {"DOI": "d", "Title": "two", "Abstract": "z"}])
    assert got["Title"] == "one" and got["Abstract"] == "x y"


def test_doi_and_title_groups_stay_apart(spark):
    rows = [{"Title": "Same", "DOI": "10.1/a"}, {"Title": "Same"}, {"Title": " same "}, {"Title": ""}, {"Title": None}, {"Title": "Same", "DOI": "https://doi.org/10.1/a"}]
    got = fold(spark, rows)
    assert [r["group_size"] for r in got] == [1, 2, 1, 1, 1]
    assert [r["group_size"] for r in fold(spark, rows, unify_doi=True)] == [2, 2, 1, 1]


def test_empty(spark):
    assert fold(spark, []) == []


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["", "a", "b"]), st.sampled_from(["", "t", "T ", "u"])), max_size=6))
def test_idempotent_and_conserving(spark, pairs):
    once = fold(spark, [{"DOI": d, "Title": t} for d, t in pairs])
    assert sum(r["group_size"] for r in once) == len(pairs)
    again = fold(spark, [{f: r[f] for f in FIELDS} for r in once])
    assert [[r[f] for f in FIELDS] for r in again] == [[r[f] for f in FIELDS] for r in once]


@pytest.mark.parametrize(
    ("header", "kind"),
    [
        (["Document Title"], "IEEE"), (["article citation count", "Title"], "IEEE"), (["Article Title"], "WOS"), (["EID"], "Scopus"), (["Title", "Source title"], "Scopus"),
        (["PMID"], "PubMed"), (["Journal", "Citations"], "PubMed"), (["Citations"], "GoogleScholar"), (["Authors", "Title", "Year"], "GoogleScholar"), (["Title"], "Fallback"), ([], "Fallback"),
    ],
)
def test_header_rules(header, kind):
    assert classify(header) == kind


def test_both_file_orders(spark, tmp_path):
    ieee, scholar = tmp_path / "ieee.csv", tmp_path / "scholar.csv"
    ieee.write_text('﻿Document Title,Authors,Publication Title,DOI,PDF Link,Link,Abstract,Author Keywords\n"A, b",,Venue,10.1/x,,,"Rich abstract\nof two lines","k1; k2"\n,,,,,,,\n', encoding="utf-8")
    scholar.write_text("Title,Authors,Publication,Year,Citations,DOI,URL,Abstract\nA b,Ann,Venue,2020,0,10.1/X,http://s,Rich\n", encoding="utf-8")
    for order in itertools.permutations([str(ieee), str(scholar)]):
        merged = merge_exports(spark, [*order, str(tmp_path / "notes.txt")])
        rows = consolidate(merged, ["file_idx", "row_idx"]).collect()
        assert merged.count() == 2 and len(rows) == 1 and rows[0]["group_size"] == 2
        assert rows[0]["Abstract"] == "Rich abstract\nof two lines" and rows[0]["Authors"] == "Ann" and rows[0]["Cited by"] == "0" and rows[0]["Keywords"] == "k1; k2"
        assert rows[0]["Link"] in ("http://s", "https://doi.org/10.1/x")


def test_case_of_headers(spark):
    df = spark.createDataFrame([("x",)], "`title` string")
    assert harmonise(df).first()["Title"] == "x"
    assert harmonise(df, exact_headers=True).first()["Title"] == ""


def _mixed_records(spark, n):
    """One group of many records, some of which extend each other in steps, and small groups."""
    import random

    draw = random.Random(4)
    rows = []
    for i in range(n):
        hot = draw.random() < 0.9
        title = "Hot title" if hot else f"Title {draw.randint(0, 9)}"
        length = draw.choice([0, 1, 2, 3, 5, 9])
        abstract = draw.choice(["Results " + "and more " * length + draw.choice(["", "...", f"end {i}"]), "", "unrelated text " + str(i), "see also: Results and more and more of it" + " x" * length])
        rows.append((i, title, draw.choice(["", "A. Author", "A. Author; B. Author", "C. Other", f"A. Author; n{i}"]), draw.choice(["", "nan", "2001", "2002"]), abstract, draw.choice(["", f"k{i}", "k"]), draw.choice(["", "10.1/x"]) if not hot else ""))
    return spark.createDataFrame(rows, "row_idx long, Title string, Authors string, Year string, Abstract string, Keywords string, DOI string")


def test_large_groups_fold_like_small_ones(spark):
    records = _mixed_records(spark, 400)
    whole = consolidate(records, ["row_idx"], in_one=10_000).orderBy("match_key").collect()
    apart = consolidate(records.repartition(7), ["row_idx"], in_one=5).orderBy("match_key").collect()
    assert [r.asDict() for r in whole] == [r.asDict() for r in apart]
    assert max(r["group_size"] for r in whole) > 300
    assert consolidate(records.limit(0), ["row_idx"], in_one=5).count() == 0


def test_an_extension_after_others(spark):
    """A chain of extensions is followed in the order of the fold, not to the longest text."""
    texts = ["alpha", "alpha beta", "gamma alpha", "alpha beta gamma", "alpha gamma delta epsilon zeta", "alpha beta gamma delta"]
    records = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "row_idx long, Title string, Abstract string")
    for size in (1, 2, 100):
        assert consolidate(records, ["row_idx"], in_one=size).first()["Abstract"] == "alpha beta gamma delta"
