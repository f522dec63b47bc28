"""Packing, decontamination, chat, line dedup, near-duplicates, archives and the pipeline against brute force."""

import gzip
import hashlib
import io
import json
import os
import random
import re
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import chat, near_dup, packing, warc
from corpusmill.llm import decontamination as dec
from corpusmill.llm.line_dedup import dedup_lines

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


# --- packing


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, x in texts.items()}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans, whole in [(by_doc[i], len(x)) for i, x in ids.items()] + [(w, sum(n for _, n in w)) for w in by_window.values()]:
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == whole
    sizes = [sum(n for _, n in w) for w in by_window.values()]
    assert max(sizes) <= 1024
    return sum(1024 - n for n in sizes if n & (n - 1))


def test_packing_edges(frame):
    texts = {1: None, 2: "", 3: "a <|endoftext|> b", 4: "word " * 5000, 5: "é" * 100, 6: "x"}
    docs = frame([(i, t, 0, "t") for i, t in texts.items()], "doc_id long, text string, length int, tail string").repartition(2)
    assert check_pieces(packing.pack(docs).collect(), texts) == 0
    assert packing.pack(docs.limit(0)).count() == 0
    with_ids = packing.pack(docs, with_ids=True).where("doc_id = 4").orderBy("start").collect()
    assert np.array_equal(np.frombuffer(b"".join(bytes(r["ids"]) for r in with_ids), "<u4"), packing.encoder(packing.TOKENIZER)("word " * 5000))
    assert packing.pack(frame([(7, "a"), (7, "a"), (None, "b")], "doc_id long, text string")).count() >= 3


def test_packing_long_runs(frame):
    texts = {1: " " * 2_000_000, 2: "\n" * 2_000_000, 3: "a" * 2_000_000}
    assert check_pieces(packing.pack(frame(sorted(texts.items()), "doc_id long, text string")).collect(), texts) == 0


@needs_data
@pytest.mark.parametrize("shard_docs", [64, 4096])
def test_packing_table(spark, shard_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check_pieces(packing.pack(docs, shard_docs=shard_docs).collect(), texts) == 0


def random_tails(n, rng, top):
    return [packing.Tail.of(i, np.array([min(int(rng.expovariate(4 / top)), top) for _ in range(rng.randrange(5, 90))], dtype="<u4")) for i in range(n)]


def bm25(seed, tails, everything):
    """Scores by the formula, with the statistics of all of ``everything``."""
    n, mean, out = len(everything), np.mean([t.total for t in everything]), []
    for d in tails:
        s = 0.0
        for term in seed.terms:
            df = sum(term in t.terms for t in everything)
            tf = int((np.repeat(d.terms, d.counts) == term).sum())
            s += max(0.0, np.log((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d.total / mean))
        out.append(s)
    return out


def table_statistics(tails):
    terms, df = np.unique(np.concatenate([t.terms for t in tails]), return_counts=True)
    return packing.Statistics(len(tails), np.mean([t.total for t in tails]), terms, df)


def test_shards_score_with_the_statistics_of_the_table():
    tails = random_tails(120, random.Random(4), 400)
    s = table_statistics(tails)
    assert s.width and (s.column[np.concatenate([t.terms for t in tails])] < 0).any()
    part = tails[10:60]
    assert np.allclose(packing.Shard(part, s).scores(tails[:5]), [bm25(t, part, tails) for t in tails[:5]], atol=1e-3)


def test_fill_takes_the_best_unused():
    """Against a plain greedy over brute-force scores."""
    tails = random_tails(90, random.Random(7), 300)
    s = table_statistics(tails)
    left = {t.doc_id: t.left for t in tails}
    order = sorted(tails, key=lambda t: (-t.left, t.doc_id))
    windows = sum(left.values()) // packing.WINDOW
    assert windows >= 3
    others, want = [t for t in tails if t in order[windows:]], []
    for seed in order[:windows]:
        scores = dict(zip([t.doc_id for t in others], np.round(bm25(seed, others, tails), 4), strict=True))
        room, got = packing.WINDOW - seed.left, [(seed.doc_id, seed.left)]
        while room:
            ranked = sorted((i for i in scores if left[i]), key=lambda i: -scores[i])[: packing.NEIGHBOURS]
            taken = []
            for i in ranked:
                if left[i] <= room - sum(n for _, n in taken):
                    taken.append((i, left[i]))
            over = room - sum(n for _, n in taken)
            if over and len(taken) < len(ranked):
                taken.append((next(i for i in ranked if i not in dict(taken)), over))
            for i, n in taken:
                left[i] -= n
                room -= n
            got += taken
        want.append(got)
    found = defaultdict(list)
    for window, _, (doc_id, _, n, *_) in packing.fill(list(tails), s):
        found[window].append((doc_id, n))
    assert [found[w] for w in range(windows)] == want


def test_packing_shards_of_long_documents_stay_small():
    rng = np.random.default_rng(5)
    # 1,500 terms a document, each too rare for a dense column and in some 90 of the shard's documents
    tails = [packing.Tail.of(i, rng.integers(1, 25_000, 1_500).astype("<u4")) for i in range(1_500)]
    terms, df = np.unique(np.concatenate([t.terms for t in tails]), return_counts=True)
    s = packing.Statistics(100 * len(tails), 1_500.0, terms, df)
    tracemalloc.start()
    assert sum(n for _, _, (_, _, n, *_) in packing.fill(tails, s)) // packing.WINDOW == 1_500 * 476 // packing.WINDOW
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20


def test_packing_finds_neighbours_in_other_splits(frame):
    rng, topics = random.Random(5), 24
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(16)] for _ in range(topics)]
    encode = packing.encoder(packing.TOKENIZER)

    def text(t, tokens):
        out = rng.choice(words[t])
        while len(encode(out)) < tokens:
            out += " " + rng.choice(words[t])
        return out

    texts = {k * topics + t: text(t, (680, 290)[k]) for k in (0, 1) for t in range(topics)}
    docs = frame(sorted(texts.items()), "doc_id long, text string").repartition(topics, "doc_id")
    rows = packing.pack(docs).collect()
    assert check_pieces(rows, texts) == 0
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["doc_id"]))
    seeded = [[i for _, i in sorted(w)] for w in windows.values() if len(w) > 1 and min(w)[1] < topics]
    assert len(seeded) >= topics // 2
    assert sum(w[1] % topics == w[0] for w in seeded) >= 0.8 * len(seeded)


# --- decontamination


def brute_tiles(doc, item, width):
    """Greedy string tiling as published: all longest matches of unmarked tokens, again and again."""
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = width, []
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and not a[p + n] and not b[q + n]:
                    n += 1
                if n > best:
                    best, found = n, [(p, q)]
                elif n == best:
                    found.append((p, q))
        if not found:
            return out
        for p, q in found:
            if not any(a[p : p + best]) and not any(b[q : q + best]):
                out.append((p, q, best))
                a[p : p + best], b[q : q + best] = [True] * best, [True] * best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=14))
def test_tiling(doc, item):
    width = 2
    cache = dec.TokenHashes()
    a, b = (dec.tokens_of(" ".join(map(str, x)), cache) for x in (doc, item))
    want = sorted(brute_tiles(doc, item, width))
    assert sorted(dec.tiles(a, b, width)) == want
    with pytest.MonkeyPatch.context() as m:  # the way of repetitive texts, in small blocks
        m.setattr(dec, "LISTED", 0)
        m.setattr(dec, "CELLS", 40)
        assert sorted(dec.tiles(a, b, width)) == want


def test_tiling_of_repetitive_texts_is_quick():
    cache, began = dec.TokenHashes(), time.monotonic()
    doc, item = (dec.tokens_of("tick tock " * n, cache) for n in (20_000, 400))
    assert sum(n for *_, n in dec.tiles(doc, item, 5)) == 800
    item = dec.tokens_of("tick tock " * 399 + "boom", cache)
    assert sum(n for *_, n in dec.tiles(doc, item, 5)) == 798 and time.monotonic() - began < 20


def test_decontamination_edges(frame):
    item = "the quick brown fox jumps over the lazy dog while seven grey geese look on in silence"
    swapped = "x y z " + " ".join(item.split()[8:]) + " and then " + " ".join(item.split()[:8]).upper() + " !"
    docs = frame([(1, item), (2, swapped), (3, "the quick brown fox jumps high"), (4, None), (5, ""), (2, swapped), (None, item)], "doc_id long, text string")
    bench = frame([(10, item), (11, "too short item"), (12, None), (10, "other words of no text at all")], "item_id long, text string")
    got = sorted((r["doc_id"] or -1, r["item_id"], r["coverage"], r["n_tiles"]) for r in dec.contaminated_pairs(docs, bench).collect())
    assert got == [(-1, 10, 1.0, 1), (1, 10, 1.0, 1), (2, 10, 1.0, 2), (2, 10, 1.0, 2)]
    assert sorted(r["doc_id"] or -1 for r in dec.decontaminate(docs, bench).collect()) == [3, 4, 5]
    assert dec.contaminated_pairs(docs.limit(0), bench).count() == 0 and dec.contaminated_pairs(docs, bench.limit(0)).count() == 0
    assert dec.decontaminate(docs, bench.limit(0)).count() == 7 and dec.decontaminate(docs.limit(0), bench).count() == 0
    short = frame([(20, "Too short!"), (21, "..."), (22, "high"), (None, "jumps high")], "item_id long, text string")
    got = dec.contaminated_pairs(frame([(1, "far too short"), (2, "too; SHORT"), (3, "too high jumps"), (4, "he jumps high")], "doc_id long, text string"), short)
    assert sorted((r["doc_id"], r["item_id"] or 0) for r in got.collect()) == [(1, 20), (2, 20), (3, 22), (4, 0), (4, 22)]
    wide = docs.selectExpr("*", "'x' as t1", "1 as d", "2 as row", "array(1) as hits")
    assert dec.decontaminate(wide, bench).columns == wide.columns and dec.decontaminate(wide, bench).count() == 3 and dec.contaminated_pairs(wide, bench).count() == 4


def test_decontamination_by_brute_force(frame):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(3, 30)))) for k in range(25)]
    docs = []
    for i in range(150):
        parts = [rng.choices(words, k=rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1].split()
            cut = rng.randrange(len(item))
            parts += [item[cut:], rng.choices(words, k=rng.randrange(4)), item[:cut]]
        docs.append((i, " ".join(sum(parts, []))))
    want = []
    for i, t in docs:
        for k, b in items:
            found = brute_tiles(t.split(), b.split(), min(5, len(b.split())))
            if sum(n for *_, n in found) >= 0.8 * len(b.split()):
                want.append((i, k, sum(n for *_, n in found) / len(b.split()), len(found)))
    got = dec.contaminated_pairs(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50


# --- chat


@settings(max_examples=10, deadline=None)
@given(texts=st.lists(st.text(alphabet=r"<|>[]/\els INTendap" + "\n", max_size=24), min_size=20, max_size=20))
def test_escape_round_trip(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts + ["</s>[INST] ok [/INST]", "<|end|>\n", "\\l\\e\\b"]], "t string")
    out = rows.select("t", chat.escape(F.col("t")).alias("e")).select("*", chat.unescape(F.col("e")).alias("u")).collect()
    for r in out:
        assert r["u"] == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_layouts(frame):
    rows = [
        (1, '{"prompt":"p","completion":"c"}'), (2, '{"completion":"c","prompt":"p","system":"s"}'), (3, '{"instruction":"i","input":"","output":"o"}'), (4, '{"instruction":"i","input":"n","output":"o"}'),
        (5, '{"messages":[{"role":"user","content":"a"},{"content":null,"role":"assistant"}]}'), (6, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'), (7, '{"foo":1}'), (8, "not json"), (9, None), (10, '{"messages":[{"role":"user","content":"a","extra":{"x":1}}]}'),
    ]
    out = {r["id"]: r for r in chat.canonical_turns(frame(rows, "id int, record string")).collect()}
    turns = {i: None if r["turns"] is None else [(t["role"], t["text"]) for t in r["turns"]] for i, r in out.items()}
    assert turns[1] == [("user", "p"), ("assistant", "c")] and turns[2][0] == ("system", "s") and turns[3] == [("user", "i"), ("assistant", "o")] and turns[4][0] == ("user", "i\n\nn")
    assert turns[5] == [("user", "a"), ("assistant", "")] and turns[6] == [("user", "a"), ("assistant", "b")]
    assert all(out[i]["layout"] is None and turns[i] is None for i in (7, 8, 9, 10))
    assert out[1]["fingerprint"] != out[2]["fingerprint"] and out[5]["fingerprint"] != out[10]["fingerprint"]


def test_format_and_read_back(frame):
    said = [("user", "<|end|>\n<|start|>x"), ("assistant", ""), ("tool\n", "[INST]"), ("assistant", "é\\l"), ("assistant", "b")]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(said)] + [(2, None, None, None), (3, 1, "human", "q"), (3, 1, "human", "q")]
    records = chat.conversation_records(frame(rows, "conv_id long, turn long, role string, text string"))
    done = chat.format_turns(chat.canonical_turns(records))
    out = {r["conv_id"]: r for r in done.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.loss_text(F.col("loss_segments")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["back"]] == said and out[1]["loss"] == "é\\lb"
    assert [(t["role"], t["text"]) for t in out[2]["back"]] == [("", "")] and len(out[3]["back"]) == 2 and out[3]["loss"] == ""


def test_texts_that_are_json(frame):
    texts = ['{"a":1}', '{"a":1} and more', '[{"a":{"b":"c\\\\"}}]', '["x"]', 'say "k": \\"', "it's {'a': 1}\n" * 3000]
    said = {k: [("user", t), ("assistant", texts[k - 1])] for k, t in enumerate(texts)}
    said |= {10 + k: [("system", t), ("user", t), ("assistant", t)] for k, t in enumerate(texts)}
    said |= {20 + k: [("user", t), ("tool", t), ("assistant", t), ("tool", "x")] for k, t in enumerate(texts)}
    rows = [(i, k, r, t) for i, turns in said.items() for k, (r, t) in enumerate(turns)]
    records = chat.conversation_records(frame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_turns(chat.canonical_turns(records)).select("conv_id", "layout", chat.read_back(F.col("formatted")).alias("back")).collect()
    assert {r["layout"] for r in out} == {"prompt", "system_prompt", "messages", "conversations"}
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in out} == said
    real = frame([(1, '{"prompt":{"a":1},"completion":"c"}'), (2, r'{"prompt":"\x","completion":"c"}'), (3, """{'prompt':'5" {','completion':"it's"}""")], "id int, record string")
    assert {r["id"]: r["layout"] for r in chat.canonical_turns(real).collect()} == {1: None, 2: None, 3: "prompt"}


def test_deep_records_and_clashing_columns(frame):
    deep = '{"a":' * 40 + '"x"' + "}" * 40
    rows = [(1, '{"prompt":{"a":{"b":{"c":1}}},"completion":"c"}'), (2, '{"prompt":{"a":{"b":{"d":1}}},"completion":"c"}'), (3, deep), (4, deep.replace('"x"', '{"y":1}')), (5, '{"prompt":null,"completion":"c"}'), (6, '{"messages":[{"role":"user","content":{"text":"a"}}]}'), (7, '{"STRING":1}'), (8, '{"VOID":1}')]
    wide = frame(rows, "id int, record string").selectExpr("*", "'f' as fingerprint", "'l' as layout", "0 as turns", "1 as formatted")
    out = {r["id"]: r for r in chat.format_turns(chat.canonical_turns(wide)).collect()}
    assert len({r["fingerprint"] for r in out.values()}) == 8 and None not in {r["fingerprint"] for r in out.values()}
    assert {i: r["layout"] for i, r in out.items() if r["layout"]} == {5: "prompt"} and [t["text"] for t in out[5]["turns"]] == ["", "c"]
    assert chat.conversation_records(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_very_long_chat_texts(frame):
    said = [("user", "[INST]<\\" * 300_000), ("assistant", '{"a": "' * 300_000)]
    records = chat.conversation_records(frame([(1, k, r, t) for k, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string"))
    back = chat.format_turns(chat.canonical_turns(records)).select(chat.read_back(F.col("formatted")).alias("back")).first()["back"]
    assert [(t["role"], t["text"]) for t in back] == said


# --- line dedup


def brute_lines(docs, n=3, least=20):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip("\t\n\x0b\x0c\r "))
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            held[key(x)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= least and len(v) >= n}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), i) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["SAME long line of Many words", " same long line of many words\r", "short", "", "ÉTÉ long line with words é", "été long line with words é", " same long line of many words"]), max_size=5), min_size=1, max_size=7))
def test_line_dedup(spark, many):
    docs = [(i, "\n".join(x)) for i, x in enumerate(many)] + [(50, None)]
    got = dedup_lines(spark.createDataFrame([(i, t, "k", 9) for i, t in docs], "doc_id long, text string, gone string, n_lines int"))
    assert set(got.columns) == {"doc_id", "text", "gone", "n_lines", "n_dropped"}
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == brute_lines(docs)


def test_line_dedup_shared_ids(frame):
    line = "a line that is long enough"
    docs = frame([(1, f"{line}\nx"), (1, f"y\n{line}"), (2, line), (3, line), (None, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in dedup_lines(docs).collect())
    assert got == [(0, line), (1, "x"), (1, "y"), (2, ""), (3, line)]
    assert dedup_lines(docs.limit(0)).count() == 0


# --- near-duplicates


def brute_components(docs, width, percent=80):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n, u = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if u and 100 * n >= percent * u and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed, groups, copies, words, change):
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        base = [f"w{rng.randrange(500)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for k in range(len(text)):
                if rng.random() < change:
                    text[k] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "groups", "copies", "words", "change", "width"), [(1, 12, 6, 80, 0.04, 5), (2, 1, 130, 70, 0.07, 2), (3, 2, 90, 40, 0.05, 2), (3, 2, 90, 40, 0.02, 5)])
def test_near_duplicates(spark, seed, groups, copies, words, change, width):
    docs = variants(seed, groups, copies, words, change)
    docs += [(1000, None), (1001, " \n"), (1002, "one"), (1003, "ONE"), (1004, docs[0][1]), (1005, docs[0][1].upper().replace("W", "w").replace("N", "n"))]
    want = brute_components(docs, width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


@pytest.mark.parametrize("small_key", [0, 10**9])
def test_both_ways_of_the_rest_round(spark, monkeypatch, small_key):
    """All pairs of small keys, or the exact join on rare shingles: the same links."""
    monkeypatch.setattr(near_dup, "SMALL_KEY", small_key)
    docs = variants(4, 2, 41, 60, 0.06)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in brute_components(docs, 2).items()} and 1 < len(set(got.values())) < 82


def test_texts_of_one_id_keep_their_links(frame):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    docs = frame([(5, a), (5, b), (7, a + " end"), (8, b + " end"), (9, "else")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, 2).collect()} == {5: 5, 7: 5, 8: 5, 9: 9}


def test_near_duplicate_edges(frame):
    docs = frame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, "a  B\tc")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near_dup.near_duplicates(docs, 2).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True), (3, 1, False)]
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


@needs_data
def test_near_duplicates_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_components([tuple(r) for r in docs.collect()], 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, 2).collect()} == want


# --- archives


def test_archive_round_trip(frame):
    pages = frame([(1, "http://a", "<p>x</p>", 0), (5, None, "<p>x</p>", 0), (3, "http://b c\n", None, 0), (4, "u", "", 0), (2, "u", "é", 0), (None, "u", "é", 0)], "page_id long, url string, html string, payload int")
    manifest = warc.write_archives(pages, file_bytes=300)
    out = warc.read_archives(manifest, payloads=True).collect()
    assert {r["kind"] for r in out} == {"record"} and len(out) == 6
    got = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in out}
    assert got == {
        "<urn:page:1>": ("revisit", "<urn:page:5>", 8), "<urn:page:5>": ("response", None, 8), "<urn:page:3>": ("revisit", "<urn:page:4>", 0), "<urn:page:4>": ("response", None, 0),
        "<urn:page:2>": ("response", None, 2), "<urn:page:None>": ("revisit", "<urn:page:2>", 2),
    }
    assert all(warc.base32_sha1(bytes(r["payload"])) == r["payload_digest"] for r in out if r["record_type"] == "response")
    assert {r["record_type"] for r in warc.read_archives(warc.write_archives(pages, min_bytes=100)).collect()} == {"response"}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    for r in manifest.collect():
        with gzip.open(r["path"].removeprefix("file://")) as f:  # any gzip reader sees one stream of records
            assert f.read().count(b"WARC/1.1\r\n") == r["records"]


def archive(n, plain=()):
    out = []
    for i in range(n):
        payload = f"page {i} ".encode() * (3 + i * 700)
        record = warc.record_bytes(i, "u", payload, warc.base32_sha1(payload), None)
        out.append(record if i in plain else warc.member(record))
    return out


def read(data):
    return [(x["kind"], x["offset"], x["length"], x.get("record_id")) for x in warc.salvage(io.BytesIO(data))]


@pytest.mark.parametrize("plain", [(), (0, 1, 2, 3, 4, 5), (1, 4)])
def test_salvage(plain):
    parts = archive(6, plain)
    whole = b"".join(parts)
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    records = [("record", starts[i], len(parts[i]), f"<urn:page:{i}>") for i in range(6)]
    assert read(whole) == records
    for i in range(6):
        hurt = bytearray(whole)
        at = starts[i] + len(parts[i]) - (12 if i not in plain else 20)
        hurt[at] ^= 0xFF
        assert read(bytes(hurt)) == records[:i] + [("gap", starts[i], len(parts[i]), None)] + records[i + 1 :]
    assert read(whole[: starts[5] + 9]) == [*records[:5], ("gap", starts[5], 9, None)]
    junk = b"\x1f\x8b\x08WARC/1.junk" * 3
    assert read(junk + whole) == [("gap", 0, len(junk), None)] + [(k, o + len(junk), n, r) for k, o, n, r in records]
    assert read(b"") == [] and read(b"zz") == [("gap", 0, 2, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 255), st.integers(1, 40))
def test_salvage_covers_every_byte(where, value, n):
    whole = bytearray(b"".join(archive(5, (2,))))
    at = where % len(whole)
    whole[at : at + n] = bytes([value]) * len(whole[at : at + n])
    got = read(bytes(whole))
    assert sum(x[2] for x in got) == len(whole) and [x[1] for x in got] == np.cumsum([0, *[x[2] for x in got]])[:-1].tolist()
    assert sum(x[0] == "record" for x in got) >= 3


def test_reader_takes_each_byte_few_times(monkeypatch):
    """Small members are unpacked from small pieces, not from a whole chunk each."""
    payloads = [f"page {i}".encode() for i in range(4_000)]
    data = b"".join(warc.member(warc.record_bytes(i, "u", p, warc.base32_sha1(p), None)) for i, p in enumerate(payloads))
    taken, get = [], warc._Window.get
    monkeypatch.setattr(warc._Window, "get", lambda self, at, n: taken.append(out := get(self, at, n)) or out)
    assert sum(x["kind"] == "record" for x in warc.salvage(io.BytesIO(data))) == 4_000
    assert sum(map(len, taken)) < 30 * len(data) and len(data) > 3 * warc.CHUNK


@pytest.mark.parametrize("n", [1, warc.CHUNK - 400, warc.CHUNK, warc.CHUNK + 1, 5 * warc.CHUNK])
def test_long_members_before_others(monkeypatch, n):
    """A member of several pieces ends where the next one begins."""
    payloads = [(b"<p>a page of many words</p>" * n)[:n], os.urandom(n), b"short", b"y" * n, b""]
    parts = [warc.member(warc.record_bytes(i, "u", p, warc.base32_sha1(p), None)) for i, p in enumerate(payloads)]
    calls, real = [], zlib.decompressobj

    class Counted:
        def __init__(self, *a):
            self.real = real(*a)

        def decompress(self, *a):
            calls.append(1)
            assert len(calls) < 200, "no end"
            return self.real.decompress(*a)

        def __getattr__(self, name):
            return getattr(self.real, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counted)
    got = list(warc.salvage(io.BytesIO(b"".join(parts))))
    assert [(x["kind"], x["length"], x.get("payload")) for x in got] == [("record", len(m), p) for m, p in zip(parts, payloads, strict=True)]


def test_only_repeated_digests_are_looked_up(frame, monkeypatch):
    """Pages of their own are written without their digests being kept or joined by a shuffle."""
    kept, keep = {}, warc.materialise
    monkeypatch.setattr(warc, "materialise", lambda df, name: kept.setdefault(name, (out := keep(df, name), out.count()))[0])
    pages = frame([(i, "u", f"page {i % 90}") for i in range(100)] + [(None, "u", None), (None, "u", "alone"), (None, "u", "")], "page_id long, url string, html string")
    out = {(r["record_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert kept["warc-digests"][1] == 11
    expected = {(f"<urn:page:{i}>", len(f"page {i % 90}"), "revisit" if i < 10 else "response", f"<urn:page:{i + 90}>" if i < 10 else None) for i in range(100)}
    assert out == expected | {("<urn:page:None>", 0, "response", None), ("<urn:page:None>", 5, "response", None)}


def test_rows_of_one_task_are_dealt_out(spark, monkeypatch):
    """A table that one task reads whole is written by several, repeated pages or not."""
    monkeypatch.setattr(warc, "TASK_ROWS", 100, raising=False)
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda k: F.sha2(F.concat_ws(" ", k, F.least("id", F.lit(3_000))), 256)), " ")
    pages = spark.range(4_000).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("html"))
    manifest = warc.write_archives(pages)
    out = warc.read_archives(manifest)
    assert manifest.where("records < 2500").count() == manifest.count() > 1
    assert out.count() == 4_000 and out.where("record_type = 'revisit' and refers_to = '<urn:page:3999>'").count() == 999
    assert warc.crowded(pages) and not warc.crowded(pages.repartition(4))


# --- pipeline


@needs_data
def test_pipeline(spark):
    import corpus_pipeline as cp

    from corpusmill.llm.common import materialise, read_table
    from corpusmill.llm.toxicity import toxicity_scores

    docs = read_table(spark, SF, "documents", "*")
    seen, frames = docs, [docs]
    for _, stage in cp.STAGES:
        seen = materialise(stage(spark, seen, SF), "test-stage")
        frames.append(seen)
    source = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in toxicity_scores(docs, read_table(spark, SF, "labels", "doc_id", "toxic")).where("predicted = 1").collect()}
    first = {r["doc_id"]: r["text"] for r in frames[1].collect()}
    assert set(first) == set(source) - toxic and all(source[i] == t for i, t in first.items())
    second = {r["doc_id"]: r["text"] for r in frames[2].collect()}
    assert sorted(second.items()) == [(i, t) for i, t, *_ in brute_lines(sorted(first.items()))]
    assert all(r["n_chars"] == len(r["text"]) for r in frames[2].collect())
    heads = {i for i, (_, c) in brute_components(sorted(second.items()), 2).items() if c == i}
    third = {r["doc_id"]: r["text"] for r in frames[3].collect()}
    assert set(third) == heads
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tokens = lambda t: re.findall(r"\w+", t.lower())
    leaks = {i for i, t in third.items() for _, b in bench if sum(n for *_, n in brute_tiles_fast(tokens(t), tokens(b))) >= 0.8 * len(tokens(b))}
    fourth = {r["doc_id"]: r["text"] for r in frames[4].collect()}
    assert set(fourth) == set(third) - leaks and frames[4].columns == docs.columns
    assert check_pieces(frames[5].collect(), fourth) == 0
    run = cp.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "start", "length", "ids_crc32").collect()))[0][0] == min(fourth) and run.agg(F.sum("length")).first()[0] == frames[5].agg(F.sum("length")).first()[0]


def brute_tiles_fast(doc, item):
    """Plain tiling, only for pairs with five words in a row in common."""
    grams = {tuple(item[k : k + 5]) for k in range(len(item) - 4)}
    return brute_tiles(doc, item, 5) if any(tuple(doc[k : k + 5]) in grams for k in range(len(doc) - 4)) else []


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted int, n_lines int, n_dropped int, kept string, gone_id int, d string, t1 int, th int"


def stage_rows():
    line, item = "a shared line of twenty signs and more", "one two three four five six seven eight nine ten"
    base = " ".join(f"word{k}" for k in range(60))
    texts = [(1, f"{line}\n{base} x"), (2, f"{line}\n{base} y"), (3, f"{line}\n{base} x"), (3, f"{line}\n{base} x"), (4, None), (4, None), (None, "no id"), (None, "no id"), (5, ""), (6, f"pre {item} post"), (6, "another text under the same id"), (7, "x" * 300_000 + " " + "y z " * 100_000)]
    return [(i, t, "en", "s", 3, "mine", 7, 8, 9, "k", 10, "d", 11, 12) for i, t in texts], item


@pytest.mark.parametrize("at", range(4))
def test_stages_on_edges(spark, frame, tmp_path, at):
    """Nulls, repeats, ties, empty and very long texts, empty tables and clashing columns."""
    import corpus_pipeline as cp

    rows, item = stage_rows()
    frame([(10, item), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame([(1, 0, 0), (2, 1, 0), (3, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int").where("doc_id <> 3").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(rows, SCHEMA)
    name, stage = cp.STAGES[at]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    got = out.collect()
    own = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    assert {tuple(r[c] for c in own) for r in got} == {tuple(dict(zip(docs.columns, rows[0], strict=True))[c] for c in own)}
    ids = sorted(r["doc_id"] or 0 for r in got)
    everything = sorted(r[0] or 0 for r in rows)
    if name == "toxicity":
        assert ids == everything
    elif name == "line_dedup":
        assert ids == everything and sorted(r["doc_id"] for r in got if (r["text"] or "").startswith("a shared")) == [3, 3]
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    elif name == "minhash_near_dup":
        assert ids == [0, 0, 1, 4, 5, 6, 6, 7]
    else:
        assert ids == sorted(r[0] or 0 for r in rows if item not in (r[1] or ""))


@needs_data
@pytest.mark.parametrize("name", ["op4_chat_format", "op6_minhash_near_dup", "op7_warc", "op8_line_dedup"])
def test_sql_agrees(spark, name):
    import duckdb

    from corpusmill.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = QUERIES[name](spark, SF)
    theirs = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in ours.collect()))) == sorted(map(str, theirs.fetchall()))


@needs_data
def test_warc_query(spark):
    from corpusmill.llm.queries import QUERIES

    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    largest = {}
    for i, p in pages.items():
        largest[p] = max(largest.get(p, i), i)
    out = QUERIES["op7_warc"](spark, SF).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out} == {i: (len(p), warc.base32_sha1(p), "response" if largest[p] == i else "revisit", None if largest[p] == i else largest[p]) for i, p in pages.items()}
    assert hashlib.sha1(b"").digest() and len(out) == len(pages)


def test_a_common_phrase_makes_no_pairs(spark, frame, monkeypatch):
    """Items and documents that share an opening meet only where more of the item follows."""
    import random

    opening, draw = "what is the answer to", random.Random(2)
    words = lambda tag, k, n: " ".join(f"{tag}{k}w{i}" for i in range(n))
    items = [(k, f"{opening} {words('q', k, 20)}") for k in range(60)]
    docs = [(d, f"{words('d', d, 9)} {opening} {words('e', d, 9)}") for d in range(200)]
    for k in draw.sample(range(60), 12):  # reordered halves of some items
        body = items[k][1].split()
        docs.append((1000 + k, " ".join([*body[13:], "x", *body[:13]])))
    seen = []
    real = dec.with_facts
    monkeypatch.setattr(dec, "with_facts", lambda rows, facts, keys, size: seen.append(sum(len(r["of"]) * r["df"] for r in facts.collect())) or real(rows, facts, keys, size))
    got = dec.contaminated_pairs(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in docs if d >= 1000) and all(r["item_id"] == r["doc_id"] - 1000 and r["coverage"] == 1.0 for r in got)
    assert seen[0] < 25 * len(docs)  # 200 x 60 pairs share the opening


def test_long_records_have_the_paths_of_short_ones(spark, frame, monkeypatch):
    """Beyond WHOLE_CHARS the texts are left out of the fingerprint: same layouts, whole turns."""
    hard = 'a "b": {\\"c\\": [1]} \\\\ \n , "d"'
    rows = [{"prompt": hard, "completion": ""}, {"system": "", "prompt": hard * 3, "completion": hard}, {"messages": [{"role": "user", "content": hard}, {"role": "assistant", "content": ""}]}, {"conversations": []}, {"prompt": hard, "completion": 5}, {'pro"mpt': "x", "completion": hard}]
    records = [(k, json.dumps(r)) for k, r in enumerate(rows)] + [(90, '{"prompt": "a" "completion": "b"}'), (91, None), (92, '["x", "y"]'), (93, '{"prompt": "a", "prompt": "b"}')]
    table = frame(records, "k long, record string")
    read = lambda: [r.asDict(True) for r in chat.format_turns(chat.canonical_turns(table)).orderBy("k").collect()]
    short = read()
    monkeypatch.setattr(chat, "WHOLE_CHARS", 0)
    assert read() == short and [r["layout"] for r in short][:3] == ["prompt", "system_prompt", "messages"]


def test_conversations_beyond_the_variant(spark, frame):
    """17 million characters in one text go the way of the longest ones."""
    n = chat.WHOLE_CHARS + 1_000_000
    turns = spark.range(2).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit('"</s>\n'), F.when(F.col("id") == 0, n // 6).otherwise(1).cast("int")).alias("text"))
    done = chat.format_turns(chat.canonical_turns(chat.conversation_records(turns)))
    out = done.select("layout", F.size("turns").alias("n"), F.length(F.col("turns")[0]["text"]).alias("chars"), F.length("formatted").alias("formatted")).first()
    assert out["layout"] == "prompt" and out["n"] == 2 and out["chars"] == n // 6 * 6 and out["formatted"] == 2 * 24 + 13 + (n // 6 + 1) * 7


def test_no_conversations(spark, frame):
    none = frame([], "conv_id long, turn long, role string, text string")
    assert chat.format_turns(chat.canonical_turns(chat.conversation_records(none))).count() == 0
