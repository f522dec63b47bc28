"""Lexical retrieval packing of whole documents into windows of 1024 tokens.

A document fills windows of its own as long as it can; what is left is its tail.
Tails are packed by BM25 over the token ids of whole documents, with the document
frequencies and the mean length of the whole table:

1. Every document becomes the counts of its token ids. Document frequencies are
   summed by Spark over all rows; the vocabulary bounds what reaches the driver.
2. The inverted index is sharded by content. A tail's key is the nearest of ``TOPICS``
   centroids, fitted on ``SAMPLE_DOCS`` documents in hash order, and then the terms that
   weigh the most in its document among those that others share. Tails are dealt by
   ranges of this key and sorted, and each run of ``shard_docs`` tails is one shard, so
   documents on one topic with the same weighty terms lie in one shard wherever they
   were stored, and a hot key is cut into many shards. Every document is indexed, and
   work is linear in the documents.
3. In a shard the longest tails are the seeds of as many windows as all tails fill,
   the others its neighbours to be. The index returns each seed's unused neighbours,
   best first. They fill the window whole while they fit; the best one that does not
   fit is cut, and its remainder stays unused. What fills no window goes to the next
   shard; at the end of a range it is cut into sequences whose lengths are powers of
   two, so nothing is padded.

Terms in more than half of the documents have no positive BM25 weight and are left
out, which changes no result.

Defined cases: a null text is empty and has only the closing id; ties have a fixed
order (score, then key and place in the table); repeated rows are packed one by one;
a text of any length is taken whole (a run of a million equal characters as well);
an empty table gives no rows; extra columns are ignored, whatever their names; a null
doc_id stays null.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialise, ship

WINDOW = 1024
#: Tails of an index shard; seeds scored at a time; neighbours looked at first.
SHARD_DOCS, SEED_BLOCK, NEIGHBOURS = 4096, 512, 64
#: Documents that a task turns into rows or index entries at a time, and postings that it adds up at a time.
PART_DOCS, POSTINGS = 256, 500_000
#: Terms of a key, and shards of a range at most.
KEY_TERMS, RANGE_SHARDS = 4, 64
#: Centroids of the content key, the documents that they are fitted on, and the steps of the fit.
TOPICS, SAMPLE_DOCS, STEPS = 16, 4096, 8
K1, B = 1.2, 0.75
CLOSING = 0
TOKENIZER = "byte_bpe_50k.json"
#: The same vocabulary as ranks, for the library that is four times as fast; the ids are equal.
RANKS = {"byte_bpe_50k.json": "byte_bpe_50k.tiktoken"}
#: What the fast library's pattern says of white space before white space; without it, matching takes half the time.
BEFORE_SPACE = r"\s+(?!\S)|"
#: Where that matters, and where the pattern could run out of stack.
RUN, LONG_RUN = re.compile(r"\s\s"), re.compile(r"\s{10000}")


class Encoder:
    """Ids of texts by the tokenizer file, through its ranks where both are known to agree."""

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = tuple(added[i].content for i in added)
        self.fast = self.plain = None
        if name in RANKS:
            with open(public_tokenizers.path(RANKS[name]), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            pattern = public_tokenizers.PATTERN
            self.fast, self.plain = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, pattern.replace(BEFORE_SPACE, "")))

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a whole text and the closing id. Texts with special tokens or very long white space go to the tokenizer itself."""
        if not text:
            ids = []
        elif self.fast is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif not RUN.search(text):
            ids = self.plain.encode_ordinary(text)
        elif not LONG_RUN.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = array("I", ids)
        out.append(CLOSING)
        return np.frombuffer(out, dtype="<u4")


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    """The encoder that a worker keeps from task to task."""
    return Encoder(name)


class Statistics:
    """Document frequencies and mean length of a whole table."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean = n, mean
        size = int(terms.max()) + 1 if len(terms) else 1
        self.df, self.idf = np.zeros(size, np.int64), np.zeros(size)
        self.df[terms] = df
        self.idf[terms] = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)
        #: Columns of the terms common enough for a dense product; -1 for the rest.
        common = terms[(32 * df >= n) & (self.idf[terms] > 0)]
        self.column = np.full(size, -1)
        self.column[common] = np.arange(len(common))
        self.width = len(common)
        #: A column per topic, a row per common term, and a last row for all other terms.
        self.topics = np.zeros((self.width + 1, 1), np.float32)

    def weights(self, terms, counts, totals) -> np.ndarray:
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * totals / self.mean))

    def fit_topics(self, tails: list[Tail]) -> None:
        """Spherical k-means over the common terms of some documents; the topics stand in the order of their main axis."""
        x = np.zeros((len(tails), self.width), np.float32)
        for row, t in enumerate(tails):
            c = self.column[t.terms]
            x[row, c[c >= 0]] = self.weights(t.terms[c >= 0], t.counts[c >= 0].astype(np.float64), float(t.total))
        x = x[x.any(axis=1)]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if len(x) < 2 * TOPICS:
            return
        topics = x[np.linspace(0, len(x) - 1, TOPICS).astype(int)].copy()
        for _ in range(STEPS):
            own = (x @ topics.T).argmax(axis=1)
            for k in np.unique(own):
                topics[k] = x[own == k].mean(axis=0)
            topics /= np.linalg.norm(topics, axis=1, keepdims=True)
        axis = np.linalg.svd(topics - topics.mean(axis=0), full_matrices=False)[0][:, 0]
        self.topics = np.vstack([topics[np.argsort(axis, kind="stable")].T, np.zeros((1, TOPICS), np.float32)])

    def keys(self, terms: list[np.ndarray], counts: list[np.ndarray], totals: np.ndarray) -> np.ndarray:
        """A row per document: the topic, then the terms that other documents share and that weigh the most in it; -1 where there are fewer."""
        sizes = np.array([len(t) for t in terms])
        starts, owner, term = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes), np.concatenate(terms)
        weight = self.weights(term, np.concatenate(counts), totals.astype(np.float64)[owner]).astype(np.float32)
        out = np.full((len(sizes), 1 + KEY_TERMS), -1, np.int64)
        out[:, 0] = np.add.reduceat(weight[:, None] * self.topics[self.column[term]], starts).argmax(axis=1)
        weight[self.df[term] < 2] = 0
        order = np.lexsort((-weight, owner))  # terms are sorted, so ties go to the smaller one
        for k in range(KEY_TERMS):
            has = np.flatnonzero(sizes > k)
            at = order[starts[has] + k]
            out[has, 1 + k] = np.where(weight[at] > 0, term[at].astype(np.int64), -1)
        return out


class Tail:
    """What is left of a document, and the terms of all of it."""

    __slots__ = ("counts", "doc_id", "ids", "start", "taken", "terms", "total")

    def __init__(self, doc_id, start: int, total: int, terms: bytes, counts: bytes, ids: bytes):
        self.doc_id, self.start, self.total, self.taken = doc_id, start, total, 0
        self.terms, self.counts, self.ids = np.frombuffer(terms, "<u4"), np.frombuffer(counts, "<u2"), ids

    @classmethod
    def of(cls, doc_id, ids: np.ndarray) -> Tail:
        terms, counts = np.unique(ids, return_counts=True)
        start = len(ids) // WINDOW * WINDOW
        return cls(doc_id, start, len(ids), terms.tobytes(), np.minimum(counts, 65_535).astype("<u2").tobytes(), ids[start:].tobytes())

    @property
    def left(self) -> int:
        return len(self.ids) // 4 - self.taken

    def cut(self, n: int) -> tuple:
        """Take the next ``n`` ids away: (doc_id, start, length, total, ids)."""
        at, self.taken = self.taken, self.taken + n
        return self.doc_id, self.start + at, n, self.total, self.ids[4 * at : 4 * self.taken]


class Shard:
    """Inverted index of some tails: dense columns for common terms, postings for the others."""

    def __init__(self, tails: list[Tail], s: Statistics):
        self.s, self.n = s, len(tails)
        self.dense = np.zeros((len(tails), s.width), np.float32)
        rare_ones = []
        for at in range(0, len(tails), PART_DOCS):  # long documents have many terms, so only the rare ones of all tails are held
            part = tails[at : at + PART_DOCS]
            owner, term = _entries(part)
            totals = np.array([t.total for t in part], dtype=np.float64)
            weight = s.weights(term, np.concatenate([t.counts for t in part]).astype(np.float64), totals[owner])
            owner, c = (owner + at).astype(np.int32), s.column[term]
            self.dense[owner[c >= 0], c[c >= 0]] = weight[c >= 0]
            rare = (c < 0) & (weight > 0)
            rare_ones.append((term[rare], owner[rare], weight[rare]))
        self.terms, self.owner, self.weight = map(np.concatenate, zip(*rare_ones, strict=True))
        order = np.argsort(self.terms, kind="stable")
        self.terms, self.owner, self.weight = self.terms[order], self.owner[order], self.weight[order]

    def scores(self, seeds: list[Tail]) -> np.ndarray:
        """BM25 of every tail (columns) for every seed (rows)."""
        row, term = _entries(seeds)
        c = self.s.column[term]
        asked = np.zeros((len(seeds), self.s.width), np.float32)
        asked[row[c >= 0], c[c >= 0]] = 1
        out = asked @ self.dense.T
        row, term = row[c < 0], term[c < 0]
        first = np.searchsorted(self.terms, term)
        n = np.searchsorted(self.terms, term, side="right") - first
        # whole seeds at a time, so that each sum is added up in one go
        ends = np.cumsum(np.bincount(row, n, len(seeds)).astype(np.int64))
        at = 0
        while at < len(seeds):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + POSTINGS, side="right")))
            if ends[to - 1] > before:
                own = slice(*np.searchsorted(row, (at, to)))
                self._add_postings(out[at:to], row[own] - at, first[own], n[own])
            at = to
        return out

    def _add_postings(self, out: np.ndarray, row: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Add the weights of ``n`` postings from ``first`` on to the scores in each ``row``."""
        ends = np.cumsum(n)
        spots = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(first, n)
        flat = np.repeat(row, n) * self.n + self.owner[spots]
        out += np.bincount(flat, self.weight[spots], out.size).reshape(out.shape).astype(np.float32)


def _entries(tails: list[Tail]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(tails)), [len(t.terms) for t in tails]), np.concatenate([t.terms for t in tails])


def fill(tails: list[Tail], s: Statistics) -> Iterator[tuple[int, int, tuple]]:
    """(window, offset, piece) of as many full windows as the tails fill; the rest stays in the list."""
    left = np.array([t.left for t in tails], dtype=np.int64)
    windows = int(left.sum()) // WINDOW
    if not windows:
        return
    by_length = np.argsort(-left, kind="stable")
    seeds, others = by_length[:windows], np.sort(by_length[windows:])
    left = left[others]
    shard = Shard([tails[k] for k in others], s) if len(others) else None
    for at in range(0, windows, SEED_BLOCK):
        block = seeds[at : at + SEED_BLOCK]
        scores = shard.scores([tails[k] for k in block]) if shard else np.zeros((len(block), 0), np.float32)
        for row, k in enumerate(block.tolist()):
            seed, room = tails[k], WINDOW
            piece = seed.cut(seed.left)
            yield at + row, 0, piece
            room -= piece[2]
            while room:
                # the best unused ones: whole while they fit, then the best other one, cut
                unused = np.flatnonzero(left)
                own = scores[row, unused]
                if len(unused) > NEIGHBOURS:
                    near = np.argpartition(-own, NEIGHBOURS - 1)[:NEIGHBOURS]
                    unused, own = unused[near], own[near]
                ranked = unused[np.lexsort((unused, -own))].tolist()
                taken, over, rest = [], room, None
                for j, n in zip(ranked, left[ranked].tolist(), strict=True):
                    if n <= over:
                        taken.append((j, n))
                        over -= n
                    elif rest is None:
                        rest = j
                    if not over:
                        break
                if rest is not None and over:
                    taken.append((rest, over))
                for j, n in taken:
                    yield at + row, WINDOW - room, tails[others[j]].cut(n)
                    left[j] -= n
                    room -= n
    tails[:] = [t for t in tails if t.left]


def last_windows(tails: list[Tail]) -> Iterator[tuple[int, int, tuple]]:
    """(window, offset, piece) of sequences of decreasing powers of two from tails of less than a window in all."""
    total, queue = sum(t.left for t in tails), list(tails)
    for bit in range(total.bit_length() - 1, -1, -1):
        size = room = total & (1 << bit)
        while room:
            piece = queue[0].cut(min(room, queue[0].left))
            yield bit, size - room, piece
            room -= piece[2]
            if not queue[0].left:
                queue.pop(0)


TAIL = "place long, doc_id long, start int, total int, first_window long, crcs array<long>, terms binary, counts binary, tail binary"
COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _number(shift: int) -> int:
    task = TaskContext.get()
    return (task.partitionId() if task else 0) << shift


def _nullable(values: list) -> pd.Series:
    return pd.array([None if pd.isna(v) else int(v) for v in values], dtype="Int64")


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slices of batches: what is made of a few documents is passed on before the next ones are taken."""
    for pdf in batches:
        for at in range(0, len(pdf), PART_DOCS):
            yield pdf.iloc[at : at + PART_DOCS]


def _tails(docs: DataFrame, tokenizer: str, with_ids: bool) -> DataFrame:
    """A row per document: checksums of its full windows, the terms of all of it, its tail; all ids on demand."""

    def run(batches):
        encode, place, window = encoder(tokenizer), _number(36), _number(40)
        for pdf in _parts(batches):
            held: list[tuple] = []
            for doc_id, ids in zip(pdf["doc_id"], map(encode, pdf["text"]), strict=True):
                t = Tail.of(doc_id, ids)
                crcs = [zlib.crc32(ids[a : a + WINDOW].tobytes()) for a in range(0, t.start, WINDOW)]
                held.append((place, doc_id, t.start, t.total, window, crcs, t.terms.tobytes(), t.counts.tobytes(), t.ids, *([ids[: t.start].tobytes()] * with_ids)))
                place, window = place + 1, window + len(crcs)
            out = pd.DataFrame(held, columns=["place", "doc_id", "start", "total", "first_window", "crcs", "terms", "counts", "tail", *["head"] * with_ids])
            out["doc_id"] = _nullable([h[1] for h in held])
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, TAIL + ", head binary" * with_ids)


def statistics(tails: DataFrame) -> Statistics:
    """From one count per term and task over all documents."""

    def run(batches):
        df = np.zeros(0, np.int64)
        for pdf in batches:
            if len(pdf):
                got = np.bincount(np.concatenate([np.frombuffer(t, "<u4") for t in pdf["terms"]]))
                wide = np.zeros(max(len(df), len(got)), np.int64)
                wide[: len(df)] += df
                wide[: len(got)] += got
                df = wide
        at = np.flatnonzero(df)
        yield pd.DataFrame({"term": at, "df": df[at]})

    df = tails.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # a row per id of the vocabulary
    n, mean = tails.agg(F.count("*"), F.avg("total")).first()
    out = Statistics(n, mean or 1.0, df["term"].to_numpy(np.int64), df["df"].to_numpy(np.int64))
    sample = tails.orderBy(F.xxhash64("place"), "place").select("place", "start", "total", "terms", "counts").limit(SAMPLE_DOCS)
    out.fit_topics([Tail(r["place"], r["start"], r["total"], bytes(r["terms"]), bytes(r["counts"]), b"") for r in sample.toLocalIterator()])
    return out


def _dealt(tails: DataFrame, s: Statistics, shard_docs: int) -> DataFrame:
    """The tails in ranges of their content keys, each sorted."""
    spark = tails.sparkSession
    shipped = spark.sparkContext.broadcast(s)  # bounded by the vocabulary
    keys = [f"k{i}" for i in range(1 + KEY_TERMS)]
    columns = ["place", "doc_id", "start", "total", "terms", "counts", "tail"]

    def keyed(batches):
        encoder.cache_clear()  # no text is encoded from here on
        for pdf in _parts(batches):
            key = shipped.value.keys([np.frombuffer(t, "<u4") for t in pdf["terms"]], [np.frombuffer(c, "<u2") for c in pdf["counts"]], pdf["total"].to_numpy())
            yield pdf.assign(doc_id=_nullable(pdf["doc_id"]), **{c: key[:, i] for i, c in enumerate(keys)})

    own = tails.select(*columns).where("octet_length(tail) > 0")
    own = own.mapInPandas(keyed, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in own.schema] + [f"{c} long" for c in keys]))
    wanted = max(1, -(-s.n // shard_docs))
    ranges = max(-(-wanted // RANGE_SHARDS), min(wanted, 2 * spark.sparkContext.defaultParallelism))
    return own.repartitionByRange(ranges, *keys, "place").sortWithinPartitions(*keys, "place").select(*columns)


def _tail_pieces(dealt: DataFrame, s: Statistics, shard_docs: int, schema: str, with_ids: bool) -> DataFrame:
    shipped = dealt.sparkSession.sparkContext.broadcast(s)

    def frame(pieces: list[tuple]) -> pd.DataFrame:
        rows = [(doc_id, start, n, zlib.crc32(ids), total, window, offset, *([ids] * with_ids)) for window, offset, (doc_id, start, n, total, ids) in pieces]
        out = pd.DataFrame(rows, columns=[*COLUMNS, *["ids"] * with_ids])
        out["doc_id"] = _nullable([r[0] for r in rows])
        return out

    def run(batches):
        waiting, number = [], _number(40)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                waiting.append(Tail(r.doc_id, int(r.start), int(r.total), r.terms, r.counts, r.tail))
                if len(waiting) >= shard_docs:
                    yield frame([(number + w, offset, piece) for w, offset, piece in fill(waiting, shipped.value)])
                    number += shard_docs
        yield frame([(number + w, offset, piece) for w, offset, piece in fill(waiting, shipped.value)])
        number += shard_docs
        yield frame([(number + bit, offset, piece) for bit, offset, piece in last_windows(waiting)])

    return dealt.mapInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``with_ids`` also ids, as little-endian unsigned 32-bit numbers.
    """
    ship(docs.sparkSession)
    tails = materialise(_tails(docs, tokenizer, with_ids), "packing-tails")
    s = statistics(tails)
    schema = ", ".join(f"{c} long" for c in COLUMNS) + ", ids binary" * with_ids
    parts = _tail_pieces(_dealt(tails, s, shard_docs), s, shard_docs, schema, with_ids)
    full = tails.select("doc_id", "total", "first_window", *["head"] * with_ids, F.posexplode("crcs").alias("k", "crc"))
    full = full.select(
        "doc_id", (F.col("k") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("total").cast("long").alias("doc_tokens"),
        (-1 - F.col("first_window") - F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),  # below zero: windows of one document
        *[F.substring("head", F.col("k") * (4 * WINDOW) + 1, F.lit(4 * WINDOW)).alias("ids")] * with_ids,
    )
    return full.unionByName(parts)
