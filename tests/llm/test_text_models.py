"""Toxic segments and language models."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import language_id as lang
from corpusmill.llm import toxicity as tox

SF = "/root/testdata/sf0.01"


def brute_segments(scores):
    """Maximal segments by definition: the best one, then both sides of it; the shortest of equals."""
    if not len(scores):
        return []
    sums = np.concatenate([[0], np.cumsum(scores)])
    best = max(((sums[b] - sums[a], a - b, -a), (a, b)) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    value, (a, b) = best[0][0], best[1]
    if value <= 0:
        return []
    left = brute_segments(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in brute_segments(scores[b:])]
    return [*left, (a, b, value), *right]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([-3.0, -1.0, 2.0, 5.0, -2.5, 0.75]), max_size=14))
def test_maximal_segments(scores):
    got = tox.maximal_segments(np.array(scores, dtype=float))
    want = brute_segments(np.array(scores, dtype=float))
    assert [round(s, 6) for *_, s in got] == [round(s, 6) for *_, s in want] or sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
    assert all(b1 <= a2 for (_, b1, _), (a2, _, _) in zip(got, got[1:], strict=False))
    assert max([s for *_, s in got], default=0) == pytest.approx(max([s for *_, s in want], default=0))


def test_stems_stand_in_for_unseen_words():
    cache = tox.WordScores(tox.Model(scores={"vile": 5.0, "vilex\x01": 4.0, "nast\x01": 3.0}, neutral=-0.1))
    assert [cache[w] for w in ("vile", "vilexes", "nasty", "kind")] == [5.0, 4.0, 3.0, -0.1]


def test_toxicity_on_edges(frame):
    clean = "the river runs past the old mill and over the weir"
    rows = [(i, f"{clean} {i}" + (" scum vermin" if i % 2 else "")) for i in range(80)]
    rows += [(100, None), (101, ""), (None, "scum"), (102, "...")]
    docs = frame(rows, "doc_id long, text string")
    labels = frame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in tox.toxicity_scores(docs, labels).collect()}
    assert all(out[i]["predicted"] == i % 2 for i in range(80))
    assert out[100]["predicted"] == out[101]["predicted"] == out[102]["predicted"] == 0 and out[100]["score"] == out[101]["score"]
    assert out[1]["passages"][-1]["end_word"] == 14
    assert tox.toxicity_scores(docs.limit(0), labels).count() == 0
    assert max(r["score"] for r in tox.toxicity_scores(docs, labels.where("toxic = 0")).collect()) < 1e-6
    wide = docs.selectExpr("*", "1 as score", "'x' as predicted", "2 as label")
    kept = tox.without_toxic(wide, labels)
    assert kept.columns == wide.columns and {(r["score"], r["predicted"], r["label"]) for r in kept.collect()} == {(1, "x", 2)}
    assert {r["doc_id"] for r in kept.collect()} - {None} == {i for i in range(80) if i % 2 == 0} | {100, 101, 102}
    assert tox.without_toxic(wide.limit(0), labels).count() == 0
    again = tox.toxicity_scores(docs.union(docs).union(docs), labels.union(labels)).where("doc_id < 80").collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in again)
    long = frame([(1, "scum " * 400_000), (2, "mill " * 400_000)], "doc_id long, text string").union(docs.where("doc_id between 3 and 79"))
    assert [r["predicted"] for r in tox.toxicity_scores(long, labels.where("doc_id > 2")).where("doc_id < 3").orderBy("doc_id").collect()] == [1, 0]


def test_extreme_values_of_a_known_tail():
    rng = np.random.default_rng(2)
    scale, log_k = tox.extreme_values(rng.exponential(1 / 1.7, 4_000), 100_000)
    assert abs(scale - 1.7) < 0.15 and abs(log_k - np.log(4_000 / 100_000)) < 0.15
    assert tox.extreme_values(np.zeros(3), 10) == (1.0, -2.0)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_significance_holds_on_clean_held_out_texts(spark):
    """Of clean documents that the model has not seen, no more have a passage than the level says."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = tox.toxicity_scores(docs, labels).join(labels.where("toxic = 0"), "doc_id").where("held_out").toPandas()
    assert (out["passages"].map(len) > 0).mean() <= 2 * tox.MAX_EXPECTED


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = tox.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out["held_out"]]
    assert (held["predicted"] == held["toxic"]).mean() > 0.97
    assert out[(out["toxic"] == 0)]["predicted"].mean() < 0.01


def kneser_ney(words, order, discount):
    """Probability of a character after a context by the textbook recursion, from plain strings."""
    counts = [Counter() for _ in range(order + 1)]
    for w, n in words.items():
        s = "\x00" * (order - 1) + w + "\x01"
        for i in range(order - 1, len(s)):
            counts[order][s[i - order + 1 : i + 1]] += n
    for n in range(order - 1, 0, -1):
        for g in counts[n + 1]:
            counts[n][g[1:]] += 1
    total, kinds = [defaultdict(int) for _ in range(order + 1)], [defaultdict(int) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(g):
        n = len(g)
        if n == 1 and not counts[1][g]:
            return lang.FLOOR
        if n == 1:
            return counts[1][g] / total[1][""] * 0.999 + 0.001 / (len(counts[1]) + 1000)
        c = g[:-1]
        if not total[n][c]:
            return p(g[1:])
        return max(0, counts[n][g] - discount) / total[n][c] + discount * kinds[n][c] / total[n][c] * p(g[1:])

    return lambda w: sum(np.log(p(s[i - order + 1 : i + 1])) for s in ["\x00" * (order - 1) + w + "\x01"] for i in range(order - 1, len(s)))


def trained(spark, words):
    return lang.build(spark.createDataFrame(lang.ngram_counts(words).assign(lang="x")).withColumn("n0", F.col("n")))


def test_word_scores_are_kneser_ney(spark):
    words = Counter({"abra": 3, "cadabra": 1, "barca": 2, "éa": 1})
    models = trained(spark, words)
    score = kneser_ney(words, lang.ORDER, lang.DISCOUNT)
    asked = ["abra", "cab", "barca", "aaé", "éa"]
    for which in (0, 1):
        got = lang.WordModel(models, which).word_scores(asked)[:, 0]
        assert np.allclose(got, [score(w) for w in asked], rtol=1e-4)


def test_leaves_change_nothing(spark, monkeypatch):
    """Many leaves, one held at a time, and steps of one character give the scores of one leaf."""
    rng = np.random.default_rng(1)
    words = Counter("".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(3_000))
    asked = ["abcd", "jihg", "a", "ccccccccc", "xyz"]
    whole = trained(spark, words)
    one = lang.WordModel(whole, 1).word_scores(asked)
    monkeypatch.setattr(lang, "LEAF_ENTRIES", 500)
    monkeypatch.setattr(lang, "HELD_BYTES", 1)
    monkeypatch.setattr(lang, "BLOCK_CELLS", 1)
    monkeypatch.setattr(lang, "_leaves", lang.Leaves())
    split = trained(spark, words)
    assert whole.leaves == 1 and split.leaves >= 16
    assert np.allclose(lang.WordModel(split, 1).word_scores(asked), one, rtol=1e-6)
    assert len(lang._leaves.held) == 1


def test_every_prediction_and_score(spark, frame):
    """Sixty-four made languages: the whole result against plain dictionaries, and its accuracy."""
    rng = np.random.default_rng(11)
    names = [f"l{i:02d}" for i in range(64)]
    sounds = {n: ["".join(rng.choice(list("abcdefghijklmnoprstuvz"), rng.integers(2, 4))) for _ in range(14)] for n in names}
    rows = []
    for i in range(64 * 14):
        own = names[i % 64]
        text = " ".join("".join(rng.choice(sounds[own], rng.integers(1, 4))) for _ in range(rng.integers(1, 25)))
        rows.append((i, text if i % 97 else None, own if i % 31 else None))
    docs = frame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    part = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(lang.CALIBRATION))).collect()}
    known = [(i, t, n) for i, t, n in rows if not held(i) and n is not None]
    scorers = []
    for used in ([r for r in known if part[r[0]]], known):
        words = {n: Counter(w for _, t, m in used if m == n for w in (t or "").split()) for n in names}
        scorers.append([kneser_ney(words[n], lang.ORDER, lang.DISCOUNT) if words[n] else None for n in names])
    floor = np.log(lang.FLOOR)

    def entropies(text, scorer):
        size = sum(len(w) + 1 for w in text.split())
        return np.array([-sum(s(w) if s else (len(w) + 1) * floor for w in text.split()) / size for s in scorer])

    margins = []
    for i, t, n in known:
        if not part[i] and t:
            e = np.sort(x := entropies(t, scorers[0]))
            margins.append((np.floor((e[1] - e[0]) * 100 + 0.5) / 100, float(names[x.argmin()] == n)))
    margins = np.array(sorted(margins))
    a, b = lang._curve(margins[:, 0], margins[:, 1])
    got = {r["doc_id"]: r for r in lang.identify(docs).collect()}
    right = []
    for i, t, n in rows:
        if not t:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        e = entropies(t, scorers[1])
        two = np.sort(e)[:2]
        assert got[i]["held_out"] == held(i) and abs(got[i]["score"] - 1 / (1 + np.exp(-(a + b * (two[1] - two[0]))))) < 0.01
        assert got[i]["lang_pred"] == names[e.argmin()] or two[1] - two[0] < 1e-4
        if held(i) and n:
            right.append(got[i]["lang_pred"] == n)
    assert np.mean(right) > 0.9


def test_languages_of_many_signs(frame):
    """Thousands of characters and mostly new n-grams in every text."""
    rng = np.random.default_rng(3)
    text = lambda base: "".join(chr(base + int(x)) for x in rng.zipf(1.3, 400) % 2_500)
    docs = frame([(i, text(0x4E00 if i % 2 else 0xAC00), "zh" if i % 2 else "ko") for i in range(120)], "doc_id long, text string, lang string")
    out = lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in out)


def test_language_edges(frame):
    rows = [(i, "the cat and the hat" if i % 2 else "die katze und der hut", "en" if i % 2 else "de") for i in range(30)]
    rows += [(100, None, "en"), (101, "123 ... 45 ²", None), (102, "THE HAT", None), (None, "und die katze", None)]
    docs = frame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in lang.identify(docs).collect()}
    assert out[100]["lang_pred"] == out[101]["lang_pred"] == "und" and out[100]["score"] == 0
    assert out[102]["lang_pred"] == "en" and out[None]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in out.values())
    assert {r["lang_pred"] for r in lang.identify(docs, reject_below=1.1).collect()} == {"und"}
    assert {r["lang_pred"] for r in lang.identify(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert lang.identify(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out["lang_pred"] == out["lang"]).mean() > 0.99
    assert abs(out["score"].mean() - (out["lang_pred"] == out["lang"]).mean()) < 0.02  # the score says how often it is right
