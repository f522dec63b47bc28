"""Ranked lexical search by presence masks.

A query is an item's set of terms. Of every document only the terms that some item
asks for are kept, with their frequencies (one pass over the texts). Then, for each
item and each window of documents, bitmap operations give each document the mask of
the item's terms that it holds; documents with one mask form a group. A mask's
score is at most the sum, over its terms, of the largest contribution of the term
in the window, so masks are evaluated by descending bound, and the rest is left
once the k-th best score exceeds the next bound (equal bounds are evaluated, so ties
are whole). A task keeps ``k`` documents an item over all its windows; a window function
merges the tasks.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, each of which is sent to all
tasks; the texts are read once a block, so the terms of a few thousand items take one pass.

Defined cases: a null or empty text has no terms, counts in no statistic and is never
returned; rows that share an item_id (null too) are one item that holds the terms of
all of them; an item without terms has no rows; every row is a document, so rows that
repeat a doc_id are each ranked, and a null doc_id comes before all others among equal scores;
texts of any length are read whole; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import forget, materialise, ship

#: Bytes of terms stay (A-Z in lower case), all others end a term.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TOP = 10
#: Terms of the items of a block (about 100 MB in a task).
BLOCK_TERMS = 500_000
#: Documents of a window: their postings are held at once.
WINDOW, WINDOW_POSTINGS = 8_192, 2_000_000
#: Masks that are evaluated in the first step; later steps take twice as many.
STEP = 16


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def run(batches):
        for pdf in batches:
            for item, text in zip(pdf["item_id"], pdf["text"], strict=True):
                terms = list(set(terms_of(text)))
                yield pd.DataFrame({"item_id": pd.array([item] * len(terms), dtype="Int64"), "term": pd.Series(terms, dtype=object)})

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text <> ''")
    return rows.mapInPandas(run, "item_id long, term binary").distinct()


def _postings(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf) of every document that has terms: the numbers of those asked for, and how often it holds them."""
    shipped = docs.sparkSession.sparkContext.broadcast(numbers)  # BLOCK_TERMS terms at most

    def run(batches):
        number = shipped.value.get
        for pdf in batches:
            held = []
            for k, text in enumerate(pdf["text"]):
                parts = terms_of(text)
                if parts:
                    ids = np.fromiter((number(p, -1) for p in parts), dtype=np.int32, count=len(parts))
                    ids, tf = np.unique(ids[ids >= 0], return_counts=True)
                    held.append((k, len(parts), ids, tf))
            own = pdf["doc_id"].iloc[[k for k, *_ in held]]
            yield pd.DataFrame({"doc_id": own.astype("Int64").array, "n": np.array([n for _, n, *_ in held], dtype=np.int64), "terms": pd.Series([t for *_, t, _ in held], dtype=object), "tf": pd.Series([x for *_, x in held], dtype=object)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text <> ''")
    return rows.mapInPandas(run, "doc_id long, n long, terms array<int>, tf array<long>")


def _frequencies(postings: DataFrame, size: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                df += np.bincount(np.concatenate(pdf["terms"].to_list()).astype(np.int64), minlength=size)
        term = np.flatnonzero(df)
        yield pd.DataFrame({"term": term, "df": df[term]})

    got = postings.select("terms").mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()  # BLOCK_TERMS rows at most
    out = np.zeros(size, dtype=np.int64)
    out[got["term"].to_numpy(dtype=np.int64)] = got["df"]
    return out


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The best ``k`` documents of an item so far: place of the row, id and score."""

    def __init__(self, k: int):
        self.k, self.ids, self.none, self.scores = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, ids: np.ndarray, none: np.ndarray, scores: np.ndarray) -> None:
        ids, none, scores = (np.concatenate(x) for x in ((self.ids, ids), (self.none, none), (self.scores, scores)))
        order = np.lexsort((ids, ~none, -scores))
        order = order[scores[order] > 0][: self.k]
        self.ids, self.none, self.scores = ids[order], none[order], scores[order]


class DocumentWindow:
    """The postings of some documents, by term and by document, with what each adds to a score."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, documents: int, total: int):
        self.ids, self.none, self.terms = ids, none, terms
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.repeat(np.arange(len(ids)), lengths)
        m = 10 + (90 * n * documents) // total
        self.adds = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by_term = np.argsort(terms, kind="stable")
        self.docs, sorted_terms = doc[by_term], terms[by_term]
        self.first = np.searchsorted(sorted_terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), dtype=np.int64)
        held = np.flatnonzero(np.diff(self.first))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.adds[by_term], self.first[held])

    def masks(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the distinct masks of an item, and the documents grouped by mask with their starts."""
        words = np.zeros((-(-len(terms) // 64), len(self.ids)), dtype=np.uint64)
        for k, t in enumerate(terms):
            words[k >> 6, self.docs[self.first[t] : self.first[t + 1]]] |= np.uint64(1 << (k & 63))
        some = np.flatnonzero(words.any(axis=0))
        order = some[np.lexsort(words[:, some])]
        masks = words[:, order]
        new = np.concatenate([[True], (masks[:, 1:] != masks[:, :-1]).any(axis=0)]) if len(order) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(new)
        bits = np.unpackbits(np.ascontiguousarray(masks[:, starts].T).view(np.uint8), axis=1, bitorder="little")[:, : len(terms)]
        return bits.astype(np.int64) @ self.most[terms], order, np.append(starts, len(order))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs``; ``asked`` marks the item's terms."""
        n = self.start[docs + 1] - self.start[docs]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[docs], n)
        adds = np.where(asked[self.terms[at]], self.adds[at], 0)
        sums = np.concatenate([[0], np.cumsum(adds)])
        ends = np.cumsum(n)
        return sums[ends] - sums[ends - n]

    def search(self, terms: np.ndarray, asked: np.ndarray, best: Best) -> int:
        """Adds the window's best documents for an item; returns how many were evaluated."""
        bounds, docs, starts = self.masks(terms)
        order = np.argsort(-bounds, kind="stable")
        at, step, done = 0, STEP, 0
        while at < len(order) and bounds[order[at]] >= best.least():
            part = order[at : at + step]
            part = part[bounds[part] >= best.least()]
            own = np.concatenate([docs[starts[g] : starts[g + 1]] for g in part])
            best.add(self.ids[own], self.none[own], self.scores(own, asked))
            at, step, done = at + step, 2 * step, done + len(own)
        return done


def _search(postings: DataFrame, items: list[tuple[int | None, np.ndarray]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best ``k`` of every task for every item."""
    shipped = postings.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        asked_items, w = shipped.value
        best = [Best(k) for _ in asked_items]
        asked = np.zeros(len(w), dtype=bool)

        def close(rows: list[pd.DataFrame]):
            pdf = pd.concat(rows)
            lengths = np.fromiter(map(len, pdf["terms"]), dtype=np.int64, count=len(pdf))
            terms, tf = (np.concatenate([*pdf[c], np.zeros(0, dtype=np.int64)]).astype(np.int64) for c in ("terms", "tf"))
            none = pdf["doc_id"].isna().to_numpy()
            window = DocumentWindow(pdf["doc_id"].fillna(0).to_numpy(dtype=np.int64), none, pdf["n"].to_numpy(), lengths, terms, tf, w, documents, total)
            for (_, own), b in zip(asked_items, best, strict=True):
                asked[own] = True
                window.search(own, asked, b)
                asked[own] = False

        held, size, rows = [], 0, 0
        for pdf in batches:
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            held.append(pdf)
            size, rows = size + sum(map(len, pdf["terms"])), rows + len(pdf)
            if size >= WINDOW_POSTINGS or rows >= WINDOW:
                close(held)
                held, size, rows = [], 0, 0
        if rows:
            close(held)
        for (item, _), b in zip(asked_items, best, strict=True):
            yield pd.DataFrame({"item_id": pd.array([item] * len(b.ids), dtype="Int64"), "doc_id": pd.arrays.IntegerArray(b.ids, b.none), "score": b.scores})

    return postings.mapInPandas(run, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item with a score above 0."""
    spark = docs.sparkSession
    ship(spark)
    asked = materialise(_item_terms(items), "rank-items")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    parts = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "term").toPandas()
        numbers = {bytes(t): i for i, t in enumerate(sorted({bytes(t) for t in own["term"]}))}
        found = materialise(_postings(docs, numbers), "rank-postings")
        stats = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        df = _frequencies(found, len(numbers))
        weights = np.array([term_weight(stats["n"], d) for d in df.tolist()], dtype=np.int64)
        own["t"] = [numbers[bytes(t)] for t in own["term"]]
        sets = [(None if pd.isna(i) else int(i), g["t"].to_numpy(dtype=np.int64)) for i, g in own.groupby("item_id", dropna=False)]
        parts.append(materialise(_search(found, sets, weights, stats["n"], max(1, stats["total"]), k), "rank-best"))
        forget(found)
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    window = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    out = materialise(best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "rank-result")
    for done in (asked, *parts):
        forget(done)
    return out
