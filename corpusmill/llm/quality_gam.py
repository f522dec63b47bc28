"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round each feature in turn gets one shallow tree on
its bins, fitted to the current residual; the trees of a feature add up to one
lookup table. Then the pairs with the most residual gain get tables of two
dimensions, boosted the same way by trees of four leaves, which cut one feature and,
on each side, the other. A score is the sum of one bin of each table.

The fit uses a bounded sample of labelled rows (``SAMPLE_ROWS``, in hash order);
scoring is one mapInPandas pass over whole texts without a shuffle.

Defined cases: null and empty texts have all-zero statistics and a score like any
other; repeated rows are scored one by one; a label whose id has several texts counts
for the one with the largest hash; a score of exactly 0.5 is predicted 1; a text of any
length is described whole; an empty table gives no rows; extra columns are ignored,
whatever their names; without labels of both classes the score is the base rate, or 0.5
without any label.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import stats
from corpusmill.llm.common import id_remainder
from corpusmill.llm.quality_gbt import sample_features

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 10


@dataclass
class Additive:
    base: float
    edges: list
    tables: list
    pairs: list  # (i, j, coarse edges of i, coarse edges of j, table)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], side="left")]
        for i, j, ei, ej, t in self.pairs:
            out += t[np.searchsorted(ei, x[:, i], side="left"), np.searchsorted(ej, x[:, j], side="left")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, reg: float) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves over ordered bins."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def gain(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + reg)

    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                at = np.arange(a + 1, b)
                more = gain(a, at) + gain(at, b) - gain(a, b)
                i = int(np.argmax(more))
                if more[i] > best[0]:
                    best = (more[i], k, int(at[i]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + reg)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, reg: float) -> np.ndarray:
    """Values per cell of a tree of four leaves: the best cut of one feature, then of the other on each side."""
    best = (-1.0, None)
    for turned in (False, True):
        cg, ch = (np.cumsum(x.T if turned else x, axis=0) for x in (g, h))
        for k in range(len(cg) - 1):  # rows up to k, and the rest
            value, gain = np.zeros((len(cg), cg.shape[1])), 0.0
            for rows, sg, sh in ((slice(0, k + 1), cg[k], ch[k]), (slice(k + 1, None), cg[-1] - cg[k], ch[-1] - ch[k])):
                left_g, left_h = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                right_g, right_h = sg.sum() - left_g, sh.sum() - left_h
                gains = left_g**2 / (left_h + reg) + right_g**2 / (right_h + reg)
                if not len(gains):
                    value[rows] = -sg.sum() / (sh.sum() + reg)
                    gain += sg.sum() ** 2 / (sh.sum() + reg)
                    continue
                at = int(np.argmax(gains))
                gain += gains[at]
                value[rows, : at + 1] = -left_g[at] / (left_h[at] + reg)
                value[rows, at + 1 :] = -right_g[at] / (right_h[at] + reg)
            if gain > best[0]:
                best = (gain, value.T if turned else value)
    return np.zeros_like(g) if best[1] is None else best[1]


def fit(x: np.ndarray, y: np.ndarray, rounds=150, pair_rounds=40, rate=0.1, leaves=3, reg=1.0) -> Additive:
    p = float(y.mean()) if len(y) else 0.5
    p = float(np.clip(p, 1e-3, 1 - 1e-3))
    base, d = float(np.log(p / (1 - p))), x.shape[1]
    edges = [_cuts(x[:, j], BINS) if len(y) else np.array([]) for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(base, edges, tables, [])
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    raw = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(d):
            q = 1 / (1 + np.exp(-raw))
            g = np.bincount(bins[j], q - y, len(tables[j]))
            h = np.bincount(bins[j], q * (1 - q), len(tables[j]))
            step = rate * _shallow(g, h, leaves, reg)
            tables[j] += step
            raw += step[bins[j]]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    small = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(coarse)]
    q = 1 / (1 + np.exp(-raw))

    def sums(i, j, values):
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        return np.bincount(small[i] * shape[1] + small[j], values, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((sums(i, j, q - y) ** 2 / (sums(i, j, q * (1 - q)) + reg)).sum(), i, j) for i, j in combinations(range(d), 2))[::-1]
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked[:PAIRS]]
    for _ in range(pair_rounds):
        for i, j, _, _, t in model.pairs:
            q = 1 / (1 + np.exp(-raw))
            step = rate * _shallow_pair(sums(i, j, q - y), sums(i, j, q * (1 - q)), reg)
            t += step
            raw += step[small[i], small[j]]
    for j, t in enumerate(tables):  # centred, the mean going to the base
        mean = float(np.bincount(bins[j], minlength=len(t)) @ t / len(y))
        t -= mean
        model.base += mean
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_fold: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row; held-out labels are never read."""
    seen = labels.where(id_remainder("doc_id", folds) != held_fold)
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample_features(docs, seen, label, sample_rows)))

    def run(batches):
        for pdf in batches:
            score = model.value.score(stats.table(pdf["text"])[1])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32)})

    rows = docs.select("doc_id", "text", (id_remainder("doc_id", folds) == held_fold).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")
