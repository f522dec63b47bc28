"""Every operator on very long texts, ties, repeats, nulls, empty tables and clashing columns; whole scores by brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id, near_dup, quality_gam, quality_gbt, stats, toxicity, warc
from corpusmill.llm import decontamination as dec
from corpusmill.llm.common import with_facts
from corpusmill.llm.line_dedup import dedup_lines
from corpusmill.llm.packing import pack

ITEM = "one two three four five six seven eight nine ten"
LONG = "long words of one text " * 100_000
ROWS = [(1, LONG + ITEM), (2, LONG + ITEM), (3, "x" * 2_000_000), (4, None), (5, ""), (5, ""), (None, "no id " * 9), (6, "a\n" * 200_000), (7, "short text about the river")]
CLASHES = "'en' as lang, 1 as label, 'k' as kept, 2 as score, 3 as n_words, 'h' as h, 4 as row, 5 as rep, 6 as keys, 7 as set_id, 8 as component_id, 9 as start, 10 as total, 11 as tail, 12 as d, 13 as th, 14 as t1, 15 as lines, 16 as gone, 17 as held_out, 18 as x, 19 as part, 20 as n"


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", *CLASHES.split(", ")).cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 1), (7, 1, 0), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def bench(spark):
    return spark.createDataFrame([(10, ITEM), (None, None)], "item_id long, text string")


OPERATORS = {
    "op1": lambda s, d, m: quality_gbt.quality_rules(d, m),
    "op2": lambda s, d, m: pack(d),
    "op3": lambda s, d, m: dec.contaminated_pairs(d, bench(s)),
    "op5": lambda s, d, m: toxicity.toxicity_scores(d, m),
    "op6": lambda s, d, m: near_dup.near_duplicates(d, 2),
    "op8": lambda s, d, m: dedup_lines(d),
    "op9": lambda s, d, m: quality_gam.quality_scores(d, m),
    "op10": lambda s, d, m: language_id.identify(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, wide, marks, name):
    run = OPERATORS[name]
    out = run(spark, wide, marks).collect()
    ids = Counter(r["doc_id"] for r in out)
    if name == "op3":
        assert ids == {1: 1, 2: 1} and all(r["coverage"] == 1.0 for r in out)
    elif name == "op2":
        assert set(ids) == {r[0] for r in ROWS} and sum(r["length"] for r in out) == sum(r["doc_tokens"] for r in out if r["start"] == 0)
    else:
        assert ids == Counter(r[0] for r in ROWS)
    if name == "op6":
        assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"]} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    assert run(spark, wide.limit(0), marks).count() == 0
    assert sorted(map(str, run(spark, wide.repartition(3, "text"), marks).drop("sequence_id", "offset", "start", "length", "ids_crc32").collect())) == sorted(map(str, run(spark, wide, marks).drop("sequence_id", "offset", "start", "length", "ids_crc32").collect())) or name == "op2"


def test_very_long_pages(spark):
    pages = spark.createDataFrame([(1, "u", LONG), (2, "v", LONG), (3, None, None)], "page_id long, url string, html string").selectExpr("*", "'s' as sha", "1 as first", "2 as n", "'p' as payload")
    out = {r["record_id"]: (r["record_type"], r["payload_bytes"]) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert out == {"<urn:page:1>": ("revisit", len(LONG)), "<urn:page:2>": ("response", len(LONG)), "<urn:page:3>": ("response", 0)}


def test_a_bomb_is_quarantined(monkeypatch):
    import io

    monkeypatch.setattr(warc, "MAX_HEADER", 1 << 20)
    good = warc.member(warc.record_bytes(1, "u", b"x", warc.base32_sha1(b"x"), None))
    got = [(x["kind"], x.get("record_id")) for x in warc.salvage(io.BytesIO(warc.member(b"\0" * (1 << 24)) + good))]
    assert got == [("gap", None), ("record", "<urn:page:1>")]
    # a header that declares less than the member inflates to
    forged = warc.record_bytes(2, "u", b"y", warc.base32_sha1(b"y"), None) + b"\0" * (1 << 24)
    unpacked = []
    real = warc.zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.own = real(bits)

        def decompress(self, *a):
            unpacked.append(len(out := self.own.decompress(*a)))
            return out

        def __getattr__(self, name):
            return getattr(self.own, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    got = [(x["kind"], x.get("reason")) for x in warc.salvage(io.BytesIO(warc.member(forged)))]
    assert got == [("gap", "a member larger than its record")] and sum(unpacked) <= 3 * warc.CHUNK
    # and a large record is read whole
    big = bytes(range(256)) * (1 << 16)
    got = list(warc.salvage(io.BytesIO(warc.member(warc.record_bytes(3, "u", big, warc.base32_sha1(big), None)))))
    assert [(x["kind"], x["payload_bytes"]) for x in got] == [("record", 1 << 24)]


def test_facts_of_hot_keys(spark):
    rows = spark.range(5_000).select(F.when(F.col("id") < 3_000, 0).when(F.col("id") < 4_990, F.col("id")).alias("k"), "id")
    facts = rows.where("k is not null and k % 2 = 0").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") + 1)
    got = with_facts(rows, facts.cache(), ["k"], "n")
    assert got.columns == ["k", "id", "n", "v"] and got.count() == 5_000
    assert got.where("v is not null and v <> k + 1 or (k % 2 = 0) <> (v is not null)").count() == 0


# --- whole scores by brute force


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words) < 50 or 100 * len(hit) > 50 * len(words)


def some_docs(n=120):
    rng = np.random.default_rng(8)
    good, bad = [f"word{k}" for k in range(300)], ["#$%", "buy", "BUY", "now!!", "99"]
    return [(i, " ".join(rng.choice(good if i % 3 else bad + good[:20], rng.integers(30, 140)))) for i in range(n)]


def test_quality_scores_by_brute_force(spark):
    docs = some_docs()
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in docs], "doc_id long, quality int")
    forest = quality_gbt.fit(*quality_gbt.sample_features(frame, labels, "quality", 1_000))
    got = {r["doc_id"]: r for r in quality_gbt.quality_rules(frame, labels).collect()}
    for i, text in docs:
        x, total = stats.describe(text)[1], forest.base
        for t in range(len(forest.value)):
            at = 0
            while forest.left[t, at] != at:
                at = forest.left[t, at] if x[forest.feature[t, at]] <= forest.threshold[t, at] else forest.right[t, at]
            total += forest.value[t, at]
        score = 1 / (1 + np.exp(-total))
        assert got[i]["score"] == pytest.approx(score) and got[i]["base_failed"] == base(text) and got[i]["kept"] == (not base(text) and score >= 0.5)

    import zlib

    seen = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = quality_gam.fit(*quality_gbt.sample_features(frame, seen, "quality", 1_000))
    for r in quality_gam.quality_scores(frame, labels).collect():
        x = stats.describe(dict(docs)[r["doc_id"]])[1]
        total = model.base + sum(t[sum(v > e for e in edges)] for v, edges, t in zip(x, model.edges, model.tables, strict=True))
        total += sum(t[sum(x[i] > e for e in ei), sum(x[j] > e for e in ej)] for i, j, ei, ej, t in model.pairs)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total))) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_pair_trees_are_the_best_of_their_kind():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=(5, 6)), rng.random((5, 6)) + 0.1
    leaf = lambda a, b: (a.sum() ** 2 / (b.sum() + 1.0), -a.sum() / (b.sum() + 1.0))
    best = 0.0
    for x, y in ((g, h), (g.T, h.T)):
        for k in range(1, len(x)):
            gain = 0.0
            for a, b in ((x[:k], y[:k]), (x[k:], y[k:])):
                gain += max(leaf(a[:, :m], b[:, :m])[0] + leaf(a[:, m:], b[:, m:])[0] for m in range(1, a.shape[1]))
            best = max(best, gain)
    value = quality_gam._shallow_pair(g, h, 1.0)
    reached = sum(g[value == v].sum() ** 2 / (h[value == v].sum() + 1.0) for v in np.unique(value))
    assert len(np.unique(value)) <= 4 and reached == pytest.approx(best)
    assert all(v == pytest.approx(leaf(g[value == v], h[value == v])[1]) for v in np.unique(value))


def brute_toxicity(text, model):
    words = re.findall(r"\w+", (text or "").lower())
    scores = []
    for w in words:
        tries = [w] + [w[:k] + "\x01" for k in (5, 4) if len(w) >= k]
        scores.append(next((model.scores[t] for t in tries if t in model.scores), model.neutral))

    def segments(a, b):
        """The best segment of words a to b (the shortest of equals), then both sides of it."""
        sums = np.concatenate([[0], np.cumsum(scores[a:b])])
        options = [(round(sums[y] - sums[x], 9), x - y, -x, x, y) for x in range(b - a) for y in range(x + 1, b - a + 1)]
        if not options or max(options)[0] <= 0:
            return []
        value, *_, x, y = max(options)
        return [*segments(a, a + x), value, *segments(a + y, b)]

    found = [model.scale * s - model.log_k - np.log(len(words)) for s in segments(0, len(words))]
    x = (float(np.clip(max(found), 0, 60)), np.log1p(sum(v for v in found if np.exp(-v) < toxicity.MAX_EXPECTED))) if found else (0.0, 0.0)
    return 1 / (1 + np.exp(-np.clip(model.weights[0] + x[0] * model.weights[1] + x[1] * model.weights[2], -40, 40)))


def test_toxicity_scores_by_brute_force(spark):
    rng = np.random.default_rng(5)
    plain, vile = [f"word{k}" for k in range(60)], ["scum", "vermin", "filthy", "vile"]
    docs = []
    for i in range(150):
        words = list(rng.choice(plain, rng.integers(8, 30)))
        for _ in range(rng.integers(1, 5) if i % 3 == 0 else 0):
            words.insert(rng.integers(0, len(words)), str(rng.choice(vile)))
        docs.append((i, " ".join(words)))
    docs.append((900, None))
    frame, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    assert model.scores
    for r in toxicity.toxicity_scores(frame, labels).collect():
        assert r["score"] == pytest.approx(brute_toxicity(dict(docs)[r["doc_id"]], model), abs=1e-6)
