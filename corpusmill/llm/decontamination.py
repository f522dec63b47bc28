"""Benchmark decontamination by greedy string tiling.

1. Every benchmark item becomes its tokens and the Karp-Rabin hashes of its runs of
   ``MIN_TILE`` tokens (of all its tokens, if it has fewer). These seeds are a table,
   and mark their slots in a bitmap of ``FILTER_BITS`` bits, which bounds what is
   broadcast however large the benchmark is.
2. One pass over the documents hashes their runs; only documents with a run in a
   marked slot go on, as tokens and marked hashes. A benchmark that fills the bitmap
   lets more rows through to the join, which decides.
3. Tiles have ``width`` words or more, so a document that covers enough of an item of
   ``n`` words holds at least ``m = ceil(ceil(min_coverage n) / width)`` of the places of
   its seeds. Therefore the most common seeds of an item (in documents), up to ``m - 1``
   places, are left out of the join without loss: a phrase that many documents and items
   share makes no pairs. The documents of a hot seed are dealt to many tasks. Pairs
   whose common seeds, with those left out, are fewer than ``m`` places go no further.
4. Each remaining pair is tiled: the seeds make maximal runs, and the longest run whose
   words are still unmarked on both sides is marked, again and again; a run that marked
   words cut goes back with the parts that are left. Coverage is the marked share of
   the item, so reordered passages count as much as straight ones. Items at
   ``MIN_COVERAGE`` or more contaminate the document.

Defined cases: null and empty texts match nothing; an item of fewer than ``MIN_TILE``
words contaminates the documents in which all of it stands in a row, one without words
or null none; repeated items of equal id are tiled one by one and the best coverage
counts (ties: the fewest tiles); of equally long runs the first in the document is
marked first; repeated documents are each reported; very long and repetitive texts are
tiled whole; empty tables give no rows; extra columns pass through or are ignored,
whatever their names.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import forget, materialise, ship, with_facts

MIN_TILE = 5
MIN_COVERAGE = 0.8
CACHE_WORDS = 300_000
WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 24
#: Tasks that make a bitmap each, which the driver unites.
FILTER_TASKS = 8
#: Equal places listed one by one; beyond, rows of the comparison table are taken in blocks of so many cells.
LISTED, CELLS = 1_000_000, 1 << 24
#: Contaminated texts up to which their hashes are broadcast; beyond, Spark joins by shuffle.
BROADCAST_TEXTS = 500_000


class TokenHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def tokens_of(text: str | None, cache: TokenHashes) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def run_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``width`` tokens."""
    n = max(0, len(tokens) - width + 1)
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = h * BASE + tokens[k : k + n]
    return h ^ (h >> np.uint64(32))


def maximal_runs(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(place in document, place in item, length) of all maximal equal runs of ``width`` tokens or more."""
    a, b = run_hashes(doc, width), run_hashes(item, width)
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, side="left"), np.searchsorted(b[order], a, side="right")
    n = high - low
    if not n.any():
        return []
    starts, ends = [], []
    if n.sum() <= LISTED:
        p = np.repeat(np.arange(len(a)), n)
        q = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        by = np.lexsort((p, p - q))
        p, q = p[by], q[by]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(p - q) != 0) | (np.diff(p) != 1)]))
        last = np.concatenate([new[1:], [len(p)]]) - 1
        out = np.stack([p[new], q[new], p[last] - p[new] + width], axis=1)
    else:
        # repetitive texts: the whole table of equal places, a block of item places at a time
        step = max(1, CELLS // max(1, len(a)))
        for at in range(0, len(b), step):
            rows = np.arange(max(0, at - 1), min(len(b), at + step + 1))
            same = b[rows][:, None] == a[None, :]
            own = slice(at - rows[0], at - rows[0] + min(step, len(b) - at))
            before, after = np.zeros_like(same), np.zeros_like(same)
            before[1:, 1:], after[:-1, :-1] = same[:-1, :-1], same[1:, 1:]
            for edge, into in ((same & ~before, starts), (same & ~after, ends)):
                q, p = np.nonzero(edge[own])
                into.append(np.stack([p, q + at], axis=1))
        first, last = (np.concatenate(x) for x in (starts, ends))
        first = first[np.lexsort((first[:, 0], first[:, 0] - first[:, 1]))]
        last = last[np.lexsort((last[:, 0], last[:, 0] - last[:, 1]))]
        out = np.stack([first[:, 0], first[:, 1], last[:, 0] - first[:, 0] + width], axis=1)
    return [(p, q, n) for p, q, n in out.tolist() if np.array_equal(doc[p : p + n], item[q : q + n])]


def _parts(free: np.ndarray, width: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of true values of ``width`` or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= width]


def tiles(doc: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: the longest unmarked run first, ties by place."""
    heap = [(-n, p, q) for p, q, n in maximal_runs(doc, item, width)]
    heapq.heapify(heap)
    in_doc, in_item, out = np.zeros(len(doc), dtype=bool), np.zeros(len(item), dtype=bool), []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = ~(in_item[q : q - n] | in_doc[p : p - n])
        if free.all():
            out.append((p, q, -n))
            in_doc[p : p - n] = in_item[q : q - n] = True
            if not _parts(~in_item, width):
                break
            continue
        for a, b in _parts(free, width):
            heapq.heappush(heap, (a - b, p + a, q + a))
    return out


def _items(benchmark: DataFrame, width: int) -> DataFrame:
    """A row per item with words: its number, id, tokens and tile width."""

    def run(batches):
        cache, at = TokenHashes(), TaskContext.get().partitionId() << 40
        for pdf in batches:
            tokens = [tokens_of(t, cache) for t in pdf["text"]]
            yield pd.DataFrame({"item": np.arange(at, at + len(pdf)), "item_id": pdf["item_id"].astype("Int64"), "n": [len(t) for t in tokens], "item_tokens": pd.Series([t.tobytes() for t in tokens], dtype=object)})
            at += len(pdf)

    rows = benchmark.select(F.col("item_id").cast("long"), "text").mapInPandas(run, "item long, item_id long, n long, item_tokens binary")
    return rows.where("n > 0").withColumn("width", F.least("n", F.lit(width)))


def _seeds(items: DataFrame) -> DataFrame:
    """(h, item, places): the hashes of the runs of each item."""

    def run(batches):
        for pdf in batches:
            for item, raw, width in zip(pdf["item"], pdf["item_tokens"], pdf["width"], strict=True):
                h, n = np.unique(run_hashes(np.frombuffer(raw, np.uint64), int(width)), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "item": item, "places": n})

    return items.mapInPandas(run, "h long, item long, places long")


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Marked slots of all seeds: one bitmap from each of a few tasks."""

    def run(batches):
        marked = np.zeros(1 << FILTER_BITS, dtype=bool)
        for pdf in batches:
            marked[pdf["h"].to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        yield pd.DataFrame({"bits": [np.packbits(marked).tobytes()]})

    out = np.zeros(1 << FILTER_BITS >> 3, dtype=np.uint8)
    for row in seeds.coalesce(FILTER_TASKS).mapInPandas(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def text_hashes() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def _candidates(docs: DataFrame, bitmap: np.ndarray, widths: list[int]) -> DataFrame:
    """Rows with a run in a marked slot: number, doc_id, hashes of the text, tokens and marked hashes."""
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        cache, at = TokenHashes(), TaskContext.get().partitionId() << 40
        marked = np.unpackbits(shipped.value).view(bool)
        for pdf in batches:
            held = []
            for k, text in enumerate(pdf["text"]):
                tokens = tokens_of(text, cache)
                hits = [h[marked[h >> np.uint64(64 - FILTER_BITS)]] for h in (run_hashes(tokens, w) for w in widths)]
                if any(map(len, hits)):
                    held.append((k, tokens.tobytes(), np.unique(np.concatenate(hits)).view(np.int64)))
            own = pdf.iloc[[k for k, *_ in held]]
            yield pd.DataFrame({"row": np.array([at + k for k, *_ in held], dtype=np.int64), "doc_id": own["doc_id"].astype("Int64").array, "t1": own["t1"].array, "t2": own["t2"].array, "tokens": pd.Series([t for _, t, _ in held], dtype=object), "hits": pd.Series([h for *_, h in held], dtype=object)})
            at += len(pdf)

    rows = docs.select(F.col("doc_id").cast("long"), "text", *text_hashes()).where("text <> ''")
    return rows.mapInPandas(run, "row long, doc_id long, t1 long, t2 long, tokens binary, hits array<long>")


def _tiled(docs: DataFrame, benchmark: DataFrame, min_coverage: float, width: int) -> tuple[DataFrame, list[DataFrame]]:
    """(row, doc_id, t1, t2, item_id, coverage, n_tiles) of pairs at ``min_coverage`` or more, and the frames it reads."""
    ship(docs.sparkSession)
    items = materialise(_items(benchmark, width), "dec-items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())  # MIN_TILE at most
    seeds = materialise(_seeds(items), "dec-seeds")
    found = materialise(_candidates(docs, _bitmap(seeds), widths), "dec-candidates")

    each = found.select("row", F.explode("hits").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("df"))
    # places of its seeds that an item owes; its most common seeds up to one less are not joined
    owed = F.ceil(F.ceil(F.col("n") * min_coverage - 1e-9) / F.col("width")).cast("long")
    owing = items.select("item", F.greatest(owed, F.lit(1)).alias("owed"))
    common = Window.partitionBy("item").orderBy(F.desc("df"), "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = seeds.join(often, "h").join(owing, "item").withColumn("left_out", F.sum("places").over(common) < F.col("owed"))
    ordered = materialise(ordered, "dec-ordered")
    facts = ordered.where("not left_out").groupBy("h").agg(F.first("df").alias("df"), F.collect_list(F.struct("item", "places")).alias("of"))
    facts = materialise(facts, "dec-facts")
    met = with_facts(each, facts, ["h"], "df").select("row", F.explode("of").alias("s")).groupBy("row", F.col("s.item").alias("item")).agg(F.sum("s.places").alias("places"))
    bounds = ordered.groupBy("item").agg(F.first("owed").alias("owed"), F.sum(F.when(F.col("left_out"), F.col("places")).otherwise(0)).alias("unseen"))
    pairs = met.join(bounds, "item").where(F.col("places") + F.col("unseen") >= F.col("owed"))
    likely = pairs.join(items, "item").select("row", "item_id", "item_tokens", "width")
    both = likely.join(found.drop("hits"), "row")

    def run(batches):
        for pdf in batches:
            held = []
            for k, (raw, item_raw, w) in enumerate(zip(pdf["tokens"], pdf["item_tokens"], pdf["width"], strict=True)):
                item, doc = np.frombuffer(item_raw, np.uint64), np.frombuffer(raw, np.uint64)
                places = np.isin(run_hashes(item, int(w)), run_hashes(doc, int(w))).sum()
                if places * int(w) < len(item) * min_coverage:
                    continue
                got = tiles(doc, item, int(w))
                covered = sum(n for *_, n in got) / len(item)
                if covered >= min_coverage:
                    held.append((k, covered, len(got)))
            own = pdf.iloc[[k for k, *_ in held]][["row", "doc_id", "t1", "t2", "item_id"]]
            yield own.assign(doc_id=own["doc_id"].astype("Int64"), item_id=own["item_id"].astype("Int64"), coverage=np.array([c for _, c, _ in held], dtype=float), n_tiles=np.array([n for *_, n in held], dtype=np.int64))

    columns = "row long, doc_id long, t1 long, t2 long, item_id long"
    tiled = both.select("row", "doc_id", "t1", "t2", "item_id", "tokens", "item_tokens", "width").mapInPandas(run, columns + ", coverage double, n_tiles long")
    return tiled, [items, seeds, found, ordered, facts]


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, width: int = MIN_TILE) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of all pairs at ``min_coverage`` or more."""
    tiled, _ = _tiled(docs, benchmark, min_coverage, width)
    best = F.max_by(F.struct("coverage", "n_tiles"), F.struct(F.col("coverage"), F.negative("n_tiles"))).alias("b")
    return tiled.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.coverage", "b.n_tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, width: int = MIN_TILE) -> DataFrame:
    """The rows of ``docs`` whose text no item contaminates, with all their columns."""
    tiled, read = _tiled(docs, benchmark, min_coverage, width)
    gone = materialise(tiled.select("t1", "t2").distinct(), "dec-gone")
    for frame in read:
        forget(frame)
    few = gone.count() <= BROADCAST_TEXTS
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *text_hashes())
    return rows.join(F.broadcast(gone) if few else gone, ["t1", "t2"], "left_anti").select("d.*")
