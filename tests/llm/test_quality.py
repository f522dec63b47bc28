"""Statistics, trees, the additive model: by brute force, and held-out accuracy on the driver's table."""

import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import quality_gam as gam
from corpusmill.llm import quality_gbt as gbt
from corpusmill.llm import stats

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", " \n\t", "one", "a b c a b c x", "x\nx\n\nx y", "é ü #|<", "tick " * 60, "w%d " * 3, "\r\n\x0b\x0c a", "a b c"]


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")) if words else 0, sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    assert stats.describe(text)[0] == brute(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\té ", max_size=60))
def test_statistics_random(text):
    assert stats.describe(text)[0] == brute(text)


def test_repeated_words_with_many_distinct():
    ids = np.array([1, 2, 3, 9, 1, 2, 3], dtype=np.int64)
    assert stats.repeated_words(ids, 10) == stats.repeated_words(ids, 3_000_000) == 6


def toy(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float), x[:, 0] + 0.1 * rng.normal(size=n)


def test_forest_walk_equals_recursion_and_is_monotone():
    x, y, z = toy()
    forest = gbt.fit(x, (z > 0).astype(float), names=("a", "b", "c"), monotone={"a": 1, "b": -1})

    def walk(tree, row):
        at = 0
        for _ in range(forest.depth):
            at = forest.left[tree, at] if row[forest.feature[tree, at]] <= forest.threshold[tree, at] else forest.right[tree, at]
        return forest.value[tree, at]

    slow = [forest.base + sum(walk(t, r) for t in range(len(forest.value))) for r in x[:40]]
    assert np.allclose(forest.raw(x[:40]), slow)
    for j, sign in ((0, 1), (1, -1)):
        grid = np.tile(x[:20], (50, 1))
        grid[:, j] = np.repeat(np.linspace(-3, 3, 50), 20)
        steps = np.diff(forest.raw(grid).reshape(50, 20), axis=0) * sign
        assert (steps >= -1e-9).all()
    assert ((forest.score(x) >= 0.5) == (z > 0)).mean() > 0.95


def test_pairs_learn_what_single_features_cannot():
    x, y, _ = toy()
    model = gam.fit(x, y)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9
    model.pairs = []
    assert ((model.score(x) >= 0.5) == y).mean() < 0.7


@pytest.mark.parametrize("fit", [gbt.fit, gam.fit])
def test_fit_without_both_classes(fit):
    empty = np.zeros((0, len(stats.FEATURES)))
    some = np.ones((4, len(stats.FEATURES)))
    assert np.isfinite(fit(empty, np.zeros(0)).score(some)).all()
    assert (fit(some, np.ones(4)).score(some) > 0.9).all()


def test_operators_on_edges(frame):
    words = " ".join(f"w{i} of" for i in range(60))
    rows = [(1, words, 1), (1, words, 1), (2, None, 2), (None, "x", 3), (3, "a b c " * 50, 4), (4, "", 5)]
    docs = frame(rows, "doc_id long, text string, score int")
    labels = frame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    out = gbt.quality_rules(docs, labels).collect()
    assert len(out) == 6 and [r["kept"] for r in out if r["doc_id"] == 1] == [True, True]
    assert all(not r["kept"] and r["base_failed"] for r in out if r["doc_id"] != 1)
    assert gbt.quality_rules(docs.limit(0), labels).count() == 0
    assert gbt.quality_rules(docs, labels.limit(0)).where("doc_id = 1 and kept").count() == 2
    scores = gam.quality_scores(docs, labels).collect()
    assert len(scores) == 6 and all(0 <= r["score"] <= 1 for r in scores)
    assert all(r["score"] == 0.5 for r in gam.quality_scores(docs, labels.limit(0)).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = gam.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(out) > 50 and (out["predicted"] == out["quality"]).mean() > 0.97
    # other labels in the held-out fold change nothing
    from pyspark.sql import functions as F

    from corpusmill.llm.common import id_remainder

    lied = labels.withColumn("quality", F.when(id_remainder("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = gam.quality_scores(docs, lied).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert np.array_equal(again, gam.quality_scores(docs, labels).toPandas().sort_values("doc_id")["score"].to_numpy())
