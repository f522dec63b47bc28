"""Exact quotes by an automaton, against the rule for one quote."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import assessment as A
from corpusmill.operators import quotes


@pytest.mark.parametrize("chars", [1_000_000, 60])
def test_agrees_with_the_rule(spark, monkeypatch, chars):
    monkeypatch.setattr(quotes, "BLOCK_CHARS", chars)
    draw = random.Random(3)
    words = ["the", "of", "the", "a", "river", "Übung", "x" * 30]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    docs = spark.createDataFrame([(i, line(3), line(draw.randint(0, 40))) for i in range(60)] + [(60, None, None), (61, "", "say \"the river\" now"), (0, "the", "of")], "doc_id long, title string, abstract string")
    asked = spark.createDataFrame([(i, line(draw.randint(1, 4))) for i in range(40)] + [(50, None), (51, ""), (52, "the ... river"), (53, '"the river"'), (54, "the"), (55, "the")], "q long, quote string").withColumn("source", F.lit("x"))
    got = quotes.find_quotes(docs, asked, "doc_id", ["title", "abstract"], "q", "quote")
    rule = A.check_quote("quote", F.col("title"), F.col("abstract"))
    expected = docs.crossJoin(asked.drop("source")).select("doc_id", "q", rule["valid"].alias("ok"), rule["source"].alias("source")).where("ok").drop("ok")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_without_the_automaton_library(monkeypatch):
    strings = ["ab", "b", "abc", "zz"]
    fast = quotes.searcher(strings)
    monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    slow = quotes.searcher(strings)
    assert all(fast(t) == slow(t) for t in ("", "abcb", "zzz", "none"))
    assert quotes.searcher([])("abc") == set()
