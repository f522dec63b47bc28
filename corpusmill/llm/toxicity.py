"""Toxic passages: maximum-scoring segments of token log-odds.

Units are words and, as back-off for inflected or unseen forms, their first five
and four characters. Each unit gets a log-odds ratio between toxic and clean
labelled documents with a Dirichlet prior in proportion to the pooled counts; a
unit counts only if its z score passes the universal threshold sqrt(2 ln n) of the n
units tested, which keeps chance out at any vocabulary size. A word takes the score of its most specific unit, any other
word the (negative) mean of the rest.
The linear scan of Ruzzo and Tompa over these scores yields every maximal
segment. Extreme-value statistics of clean training documents, lambda from the mean
excess of their segments over the upper quartile and K from how many reach it, turn a
segment score s in a text of n words into s' = lambda * s - ln(K n); the best s' and
the sum of the significant ones go through a logistic curve fitted on the sample.

At most ``SAMPLE_ROWS`` labelled documents (in hash order, equal texts once) fit
the model; all their significant units are kept, so the sample bounds the broadcast.
Scoring is one pass over whole texts without a shuffle.

Defined cases: a text that is null, empty or has no word has no segment and the
score of a clean text; repeated rows are scored one by one; a label whose id has
several texts counts for the one with the largest hash, and of labels for equal texts
the toxic one counts; a score of exactly 0.5 is predicted 1; segments of equal score are
all reported; a text of any length is scanned whole; an empty table gives no rows; extra
columns are ignored or, by :func:`without_toxic`, kept whatever their names; without
labels of both classes every score is the base rate, or 0 without any label.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import forget, id_remainder, materialise, sampled_texts, ship

SAMPLE_ROWS = 40_000
#: Weight of the Dirichlet prior, as a share of the pooled counts.
PRIOR = 0.1
#: A segment is a passage if by chance fewer than this many are expected in its text.
MAX_EXPECTED = 0.05
CACHE_WORDS = 300_000
COUNT_TABLE = 200_000
WORD = re.compile(r"\w+")


def units_of(word: str) -> list[str]:
    """Units of a word, the most specific first; marks keep stems apart from words."""
    return [word, *(word[:k] + "\x01" for k in (5, 4) if len(word) >= k)]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    neutral: float = -0.02
    scale: float = 1.0  # lambda
    log_k: float = -2.0
    weights: tuple[float, float, float] = (-40.0, 0.0, 0.0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.weights[0] + x @ np.array(self.weights[1:])
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


class WordScores(dict):
    """Score of each word met, found through its units; cleared when it grows too large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        for u in units_of(word):
            if u in self.model.scores:
                self[word] = self.model.scores[u]
                break
        else:
            self[word] = self.model.neutral
        return self[word]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past the last, score), from left to right."""
    ends = np.cumsum(scores)
    found: list[list] = []  # first, end, sum before, sum after, index of the last one with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        right = float(ends[i])
        new = [i, i + 1, right - float(scores[i]), right, -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                new[4] = j
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3], -1]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


def examine(text: str | None, cache: WordScores) -> tuple[int, list[tuple[int, int, float]]]:
    words = WORD.findall(text.lower()) if text else []
    scores = np.fromiter(map(cache.__getitem__, words), dtype=np.float64, count=len(words))
    return len(words), maximal_segments(scores)


def summary(n: int, segments: list, model: Model) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(best normalised score, log of the sum of the significant ones), and the passages."""
    if not segments:
        return [0.0, 0.0], []
    normal = [(a, b, model.scale * s - model.log_k - np.log(n)) for a, b, s in segments]
    passages = [x for x in normal if np.exp(-x[2]) < MAX_EXPECTED]
    best = max(x[2] for x in normal)
    return [float(np.clip(best, 0, 60)), float(np.log1p(sum(x[2] for x in passages)))], passages


def extreme_values(scores: np.ndarray, words: int) -> tuple[float, float]:
    """lambda and ln K of the tail: n words have n K exp(-lambda s) segments of s or more by chance."""
    if len(scores) < 20:
        return 1.0, -2.0
    at = float(np.quantile(scores, 0.75))
    over = scores[scores >= at] - at
    scale = float(np.clip(1 / max(over.mean(), 1e-9), 0.05, 20.0))
    return scale, float(np.log(len(over) / max(1, words)) + scale * at)


def _unit_counts(rows: DataFrame) -> DataFrame:
    """(unit, toxic, clean): counts over all given rows."""

    def run(batches):
        tables = (Counter(), Counter())

        def flush():
            for label, table in enumerate(tables):
                units: Counter = Counter()
                for w, n in table.items():
                    for u in units_of(w):
                        units[u] += n
                if units:
                    yield pd.DataFrame({"unit": list(units), "label": label, "n": list(units.values())})
                table.clear()

        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                # once a document, since a rare word often comes in bursts
                tables[int(label > 0)].update(set(WORD.findall(text.lower())) if text else ())
                if sum(map(len, tables)) > COUNT_TABLE:
                    yield from flush()
        yield from flush()

    counted = rows.select("text", "label").mapInPandas(run, "unit string, label int, n long")
    return counted.groupBy("unit").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))


def _log_odds(counts: DataFrame) -> tuple[dict[str, float], float]:
    """Scores of the significant units, and the score of all other words."""
    words = ~F.col("unit").endswith("\x01")
    total = counts.agg(F.sum(F.when(words, F.col("toxic"))).alias("t"), F.sum(F.when(words, F.col("clean"))).alias("c"), F.count("*").alias("n")).first()
    t, c = float(total["t"] or 0), float(total["c"] or 0)
    if not t or not c:
        return {}, -0.02
    prior = PRIOR * (F.col("toxic") + F.col("clean"))
    a, b, more = F.col("toxic") + prior, F.col("clean") + prior, PRIOR * (t + c)
    odds = F.log(a / (F.lit(t + more) - a)) - F.log(b / (F.lit(c + more) - b))
    scored = counts.select("unit", "toxic", "clean", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z"))
    kept = scored.where(F.abs("z") >= float(np.sqrt(2 * np.log(max(2, total["n"]))))).toPandas().sort_values("unit")  # units of the sample
    plain = kept[~kept["unit"].str.endswith("\x01")]
    rest = (max(1.0, t - plain["toxic"].sum()) / t) / (max(1.0, c - plain["clean"].sum()) / c)
    return dict(zip(kept["unit"], kept["odds"], strict=True)), float(min(-0.005, np.log(rest)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Intercept and two weights by damped Newton steps; a feature of negative weight is left out."""
    used = list(range(x.shape[1]))
    while True:
        one = np.column_stack([np.ones(len(x)), x[:, used]])
        w, eye = np.zeros(one.shape[1]), ridge * np.eye(one.shape[1])

        def loss(v, one=one):
            raw = one @ v
            return np.logaddexp(0, raw).sum() - y @ raw + ridge / 2 * v @ v

        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
            step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + eye, one.T @ (y - p) - ridge * w)
            size = 1.0
            while size > 1e-6 and loss(w + size * step) > loss(w):
                size /= 2
            w = w + size * step
        worst = int(np.argmin(w[1:])) if len(used) else -1
        if worst < 0 or w[1 + worst] >= 0:
            break
        used.pop(worst)
    out = np.zeros(x.shape[1])
    out[used] = w[1:]
    return float(w[0]), float(out[0]), float(out[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn the model from at most ``sample_rows`` labelled documents."""
    ship(docs.sparkSession)
    rows = materialise(sampled_texts(docs, labels, label, sample_rows), "toxicity-sample")
    distinct = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.max("text").alias("text"))
    model = Model()
    model.scores, model.neutral = _log_odds(_unit_counts(distinct))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache = WordScores(shipped.value)
        for pdf in batches:
            seen = [examine(t, cache) for t in pdf["text"]]
            yield pd.DataFrame({"label": pdf["label"], "n": [n for n, _ in seen], "segments": [[s for *_, s in x] for _, x in seen]})

    got = rows.mapInPandas(run, "label int, n long, segments array<double>").toPandas()  # at most ``sample_rows`` rows
    forget(rows)
    if got.empty or got["label"].nunique() < 2:
        p = float(got["label"].mean()) if len(got) else 0.0
        model.weights = (float(np.log(max(p, 1e-9) / max(1 - p, 1e-9))), 0.0, 0.0)
        return model
    got = got.assign(best=[max(s, default=0.0) for s in got["segments"]]).sort_values(["label", "n", "best"])
    clean = got[got["label"] == 0]
    scores = np.concatenate([np.asarray(s, dtype=float) for s in clean["segments"]] + [np.zeros(0)])
    model.scale, model.log_k = extreme_values(scores, int(clean["n"].sum()))
    x = np.array([summary(n, [(0, 0, v) for v in s], model)[0] for n, s in zip(got["n"], got["segments"], strict=True)])
    model.weights = _logistic(x, got["label"].to_numpy(dtype=float))
    return model


def _judge(texts, cache: WordScores, model: Model) -> tuple[np.ndarray, list]:
    """Score and passages of each text."""
    rows = [summary(*examine(t, cache), model) for t in texts]
    return model.probability(np.array([r[0] for r in rows]).reshape(-1, 2)), [r[1] for r in rows]


def _learned(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_fold: int, sample_rows: int):
    seen = labels.where(id_remainder("doc_id", folds) != held_fold)
    return docs.sparkSession.sparkContext.broadcast(fit(docs, seen, label, sample_rows))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the passages of every row; held-out labels are never read."""
    model = _learned(docs, labels, label, folds, held_fold, sample_rows)

    def run(batches):
        cache = WordScores(model.value)
        for pdf in batches:
            score, found = _judge(pdf["text"], cache, model.value)
            passages = [[{"first_word": a, "end_word": b, "significance": float(s)} for a, b, s in x] for x in found]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "score": score, "predicted": (score >= 0.5).astype(np.int32), "passages": passages})

    rows = docs.select("doc_id", "text", (id_remainder("doc_id", folds) == held_fold).alias("held_out"))
    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first_word:long,end_word:long,significance:double>>")


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, held_fold: int = 0, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns, in one pass over the texts."""
    model = _learned(docs, labels, label, folds, held_fold, sample_rows)
    at = docs.columns.index("text")

    def run(batches):
        cache = WordScores(model.value)
        for batch in batches:
            score, _ = _judge(batch.column(at).to_pylist(), cache, model.value)
            yield batch.filter(pa.array(score < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
