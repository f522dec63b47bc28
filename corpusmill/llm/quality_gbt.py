"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, in
hash order) by histogram boosting with monotonic constraints, and flattened into
numpy node arrays. Scoring is one mapInPandas pass over the whole table without
a shuffle: each batch walks all trees at once, one level per step.

Defined cases: null, empty and white-space texts have no words and fail the base
rules; repeated rows are scored one by one; a label whose id has several texts counts
for the one with the largest hash; a score of exactly ``keep_from`` is kept; a text of
any length is described whole; an empty table gives no rows; extra columns are ignored,
whatever their names; a null doc_id stays null. Without labels of both classes every
document gets the base rate (or 1.0), so the base rules decide alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpusmill.llm import stats
from corpusmill.llm.common import sampled_texts, ship

#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 20_000
MAX_BINS = 64
#: +1: the score may only rise with the feature; -1: only fall.
MONOTONE = {"symbol_ratio": -1, "repeat_word_ratio": -1, "dup_line_ratio": -1, "stutter_ratio": -1, "upper_ratio": -1}


@dataclass
class Forest:
    """Trees as arrays of shape (trees, nodes); a leaf points to itself."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not len(self.value):
            return np.full(len(x), self.base)
        trees = np.arange(len(self.value))[None, :]
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.value)), dtype=np.int32)
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(goes_left, self.left[trees, at], self.right[trees, at])
        return self.base + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def _edges(column: np.ndarray) -> np.ndarray:
    values = np.unique(column)
    if len(values) > MAX_BINS:
        values = np.unique(np.quantile(column, np.linspace(0, 1, MAX_BINS + 1)[1:-1]))
        return values
    return (values[:-1] + values[1:]) / 2


def _grow(binned, edges, grad, hess, signs, depth, rate, reg, least):
    """One tree as node lists; bounds keep children of a constrained split in order."""
    feature, threshold, left, right, value = [], [], [], [], []

    def add(rows: np.ndarray, low: float, high: float, level: int) -> int:
        me = len(value)
        g, h = grad[rows].sum(), hess[rows].sum()
        own = float(np.clip(-g / (h + reg), low, high))
        for into, x in ((feature, 0), (threshold, np.inf), (left, me), (right, me), (value, own * rate)):
            into.append(x)
        if level == depth or len(rows) < 2 * least:
            return me
        best = (1e-6, None)
        for j, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = binned[rows, j]
            gs = np.cumsum(np.bincount(b, grad[rows], len(cuts) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, hess[rows], len(cuts) + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=len(cuts) + 1))[:-1]
            lv = np.clip(-gs / (hs + reg), low, high)
            rv = np.clip(-(g - gs) / (h - hs + reg), low, high)
            gain = gs**2 / (hs + reg) + (g - gs) ** 2 / (h - hs + reg) - g**2 / (h + reg)
            bad = (ns < least) | (len(rows) - ns < least)
            if signs[j]:
                bad |= signs[j] * (rv - lv) < 0
            gain = np.where(bad, -np.inf, gain)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (j, k, lv[k], rv[k]))
        if best[1] is None:
            return me
        j, k, lv, rv = best[1]
        goes = binned[rows, j] <= k
        middle = (lv + rv) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
        feature[me], threshold[me] = j, edges[j][k]
        left[me] = add(rows[goes], *bounds[0], level + 1)
        right[me] = add(rows[~goes], *bounds[1], level + 1)
        return me

    add(np.arange(len(grad)), -np.inf, np.inf, 0)
    return feature, threshold, left, right, value


def fit(x: np.ndarray, y: np.ndarray, names=stats.FEATURES, monotone=MONOTONE, trees=60, depth=3, rate=0.2, reg=1.0, least=5) -> Forest:
    """Boost on log loss; with one class only (or no rows) the forest is a constant."""
    signs = [monotone.get(n, 0) for n in names]
    p = float(y.mean()) if len(y) else 1.0
    base = float(np.log(np.clip(p, 1e-3, 1 - 1e-3) / (1 - np.clip(p, 1e-3, 1 - 1e-3))))
    grown: list = []
    if 0 < p < 1:
        edges = [_edges(x[:, j]) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        raw = np.full(len(y), base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            tree = _grow(binned, edges, q - y, q * (1 - q), signs, depth, rate, reg, least)
            grown.append(tree)
            one = _flat([tree], 0.0, depth)
            raw = raw + one.raw(x)
    return _flat(grown, base, depth)


def _flat(grown: list, base: float, depth: int) -> Forest:
    width = max([len(t[4]) for t in grown], default=1)
    shape = (len(grown), width)
    arrays = [np.zeros(shape, dtype=d) for d in (np.int32, np.float64, np.int32, np.int32, np.float64)]
    for i, tree in enumerate(grown):
        for a, part in zip(arrays, tree, strict=True):
            a[i, : len(part)] = part
    return Forest(base, *arrays, depth)


def sample_features(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents, on the driver."""
    ship(docs.sparkSession)
    rows = sampled_texts(docs, labels, label, limit)

    def run(batches):
        for pdf in batches:
            _, x = stats.table(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": list(x)})

    got = rows.mapInPandas(run, "doc_id long, label int, x array<double>").toPandas()  # at most ``limit`` rows
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(stats.FEATURES))
    order = np.lexsort((*x.T[::-1], got["doc_id"].to_numpy()))
    return x[order], got["label"].to_numpy(dtype=np.float64)[order]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def quality_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, keep_from: float = 0.5) -> DataFrame:
    """Statistics, base rules and the forest's verdict for every row of ``docs``."""
    forest = fit(*sample_features(docs, labels, label, sample_rows))
    shipped = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            counts, x = stats.table(pdf["text"])
            n, repeats = counts[:, 0], counts[:, 4]
            failed = (n < 50) | (100 * repeats > 50 * n)
            score = shipped.value.score(x)
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64")})
            for i, c in enumerate(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")):
                out[c] = counts[:, i]
            out["base_failed"] = failed
            out["kept"] = ~failed & (score >= keep_from)
            out["score"] = score
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, SCHEMA)
