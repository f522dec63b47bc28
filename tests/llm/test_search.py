"""Source divergence, exact top-k and ranked search against brute force, and their edges."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import divergence, ranked, topk

LETTERS, WORDS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DIVERGENCE = "lang string, source string, text string"


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def divergence_of(rows, min_docs, top):
    docs = [(lang or "", source or "", LETTERS.findall(lower(text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for *_, ts in own for t in set(ts))
        kept = sorted((t for t in df if df[t] >= min_docs), key=lambda t: t.encode())
        n = defaultdict(Counter)
        for _, source, ts in own:
            n[source].update(t for t in ts if df[t] >= min_docs)
        whole = sum(n.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in (*((s, n[s]) for s in {d[1] for d in own}), (None, whole))}
        for s in p:
            if s is None:
                continue
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in p if o not in (s, None)))
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > p[None][t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms[:top])}
    return out


@pytest.mark.parametrize("bits", [64, 6])
def test_divergence_is_exact_with_and_without_collisions(spark, frame, bits):
    draw = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "ÄRGER", "ärger", "ünter", "x1y", "delta", "Epsilon", "zeta", "日本", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(20))]
    rows = [(draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "é", None]), " ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60)))) for _ in range(300)]
    rows += [("en", "a", None), ("only", "lonely", "x"), ("two", "p", "x"), ("two", "q", ""), (None, None, None)]
    rows += [("en", "hot", "alpha alpha zeta")] * 200
    got = divergence.source_divergence(frame(rows, DIVERGENCE).repartition(5), min_docs=8, top_terms=6, bits=bits).collect()
    assert {tuple(r) for r in got} == divergence_of(rows, 8, 6)
    assert len(got) == len({tuple(r) for r in got})


def test_divergence_flushes_and_blocks(spark, frame, monkeypatch):
    for name, value in (("TASK_WORDS", 20), ("TASK_COUNTS", 40), ("BLOCK_ROWS", 15), ("BLOCK_PAIRS", 7)):
        monkeypatch.setattr(divergence, name, value)
    draw = random.Random(9)
    rows = [("en", f"s{draw.randint(0, 5)}", " ".join(f"t{chr(97 + draw.randint(0, 25))}" for _ in range(30))) for _ in range(80)]
    got = divergence.source_divergence(frame(rows, DIVERGENCE), min_docs=5, top_terms=4).collect()
    assert {tuple(r) for r in got} == divergence_of(rows, 5, 4)


def test_divergence_edges(spark, frame):
    empty = frame([], DIVERGENCE)
    assert divergence.source_divergence(empty).count() == 0
    long = "word " * 200_000
    rows = frame([("en", "a", long), ("en", "b", "")], DIVERGENCE).selectExpr("*", "1 as digest", "2 as n", "'t' as term", "3 as df", "4 as rank", "5 as p", "6 as doc_id")
    got = {tuple(r) for r in divergence.source_divergence(rows, min_docs=1).collect()}
    assert got == divergence_of([("en", "a", long), ("en", "b", "")], 1, 50)


def top_of(vectors, k):
    ints = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = max(ints.get(i, []), [math.floor(64.0 * x) for x in v])
    out = set()
    for q in ints:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q)[:k]
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores)}
    return out


@pytest.mark.parametrize("block", [4_096, 16])
def test_top_k_is_exact(spark, frame, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 7)
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(4, 12))
    vectors = [(i, (centres[i % 4] * (i % 3 > 0) + random_.normal(size=12) * 0.3).tolist()) for i in range(400)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(60)]  # copies of a query, some of them queries
    vectors += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (2004, []), (2020, []), (2005, [0.5] * 3), (None, [1.0] * 12), (7, vectors[7][1]), (8, [9.0] * 12)]
    table = frame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as d", "3 as block", "4 as score")
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == top_of(vectors, 20)


def test_queries_that_no_other_block_can_serve(spark, frame, monkeypatch):
    """Two far groups, each in blocks of its own: the bounds leave nothing to send."""
    monkeypatch.setattr(topk, "BLOCK", 1_000)
    vectors = [(i, [1.0, 0.001 * i] if i < 100 else [0.001 * i, -9.0]) for i in range(200)]
    table = frame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 20 == 0, k=5).collect()} == top_of(vectors, 5)


def test_top_k_of_few_and_of_huge_vectors(spark, frame):
    schema = "vec_id long, embedding array<double>"
    empty = frame([], schema)
    assert topk.top_k(empty, F.col("vec_id") % 20 == 0).count() == 0
    big = [(0, [2.0**40, 1.0, -(2.0**35)]), (1, [2.0**10, 3.0, 1.0]), (2, [2.0**10, 3.0, 2.0]), (20, [-(2.0**9), 1e300, 0.0])]
    table = frame(big, schema)
    got = {(r["query_id"], r["rank"], r["vec_id"]): r["score"] for r in topk.top_k(table, F.col("vec_id") % 20 == 0).collect()}
    assert got[0, 2, 1] == 2**46 * 2**16 + 64 * 192 - 2**41 * 64 and got[0, 3, 2] == got[0, 2, 1] - 2**47
    assert got[0, 1, 20] == 2**63 - 1


def ranking_of(docs, items, k):
    terms = [(d, WORDS.findall(lower(t or ""))) for d, t in docs]
    sound = [(d, ts) for d, ts in terms if ts]
    n_docs, total = len(sound), sum(len(ts) for _, ts in sound)
    df = Counter(t for _, ts in sound for t in set(ts))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(WORDS.findall(lower(t or "")))
    out = []
    for i, ts in asked.items():
        rows = []
        for d, held in sound:
            tf, m = Counter(held), 10 + 90 * len(held) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in ts if tf[t])
            if score > 0:
                rows.append((-score, d is not None, d or 0, d))
        out += [(i, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(rows)[:k])]
    return Counter(out)


@pytest.mark.parametrize(("window", "terms"), [(8_192, 500_000), (5, 30)])
def test_ranked_search_is_exact(spark, frame, monkeypatch, window, terms):
    monkeypatch.setattr(ranked, "WINDOW", window)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", terms)
    monkeypatch.setattr(ranked, "STEP", 1)
    draw = random.Random(11)
    vocabulary = [f"Term{i}" for i in range(60)] + ["the"] * 30 + ["of"] * 15
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 80)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "-- !"), (3, docs[3][1]), (None, docs[4][1]), *[(300 + i, "the of the term1") for i in range(40)], (400, "the term1 " * 20_000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(1, 9)))) for i in range(12)]
    items += [(20, " ".join(vocabulary) + " " + " ".join(f"more{i}" for i in range(100))), (21, None), (22, ""), (23, "unknown"), (1, "term5"), (None, "term7 the")]
    table = frame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as terms", "3 as tf", "4 as item_id", "5 as rank")
    got = ranked.ranked_search(table.repartition(3), frame(items, "item_id long, text string").selectExpr("*", "1 as term", "2 as t"))
    assert Counter(tuple(r) for r in got.collect()) == ranking_of(docs, items, 10)


def test_ranked_search_of_nothing(spark, frame):
    docs, items = frame([(1, "a b")], "doc_id long, text string"), frame([(1, "a")], "item_id long, text string")
    assert ranked.ranked_search(docs.limit(0), items).count() == 0
    assert ranked.ranked_search(docs, items.limit(0)).count() == 0


def test_masks_spare_evaluations():
    """Documents whose mask cannot reach the tenth best are not evaluated."""
    weights = np.array([5000, 10], dtype=np.int64)
    n = 1000
    lengths = np.array([2] * 20 + [1] * (n - 20))
    terms = np.concatenate([np.tile([0, 1], 20), np.ones(n - 20, dtype=np.int64)])
    window = ranked.DocumentWindow(np.arange(n), np.zeros(n, dtype=bool), np.full(n, 10), lengths, terms, np.ones(len(terms), dtype=np.int64), weights, n, 10 * n)
    best = ranked.Best(10)
    ranked.STEP, before = 1, ranked.STEP
    try:
        assert window.search(np.array([0, 1]), np.array([True, True]), best) == 20
    finally:
        ranked.STEP = before
    assert best.ids.tolist() == list(range(10))
