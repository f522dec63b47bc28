"""Exact top-k search by inner product with a pivot table.

Components become integers, so scores are exact. The distances of every vector to
``PIVOTS`` pivots are computed once (the pivot table). For a query ``q`` and a vector
``x`` the largest ``|d(q, p) - d(x, p)|`` over the pivots bounds their distance from
below, hence the score ``(|q|^2 + |x|^2 - d^2) / 2`` from above. Candidates are
evaluated in the order of this bound until it falls below the k-th best score
(equal bounds are still evaluated, so ties are whole).

1. Vectors are dealt into blocks by their nearest pivot, large cells into several
   blocks of about ``BLOCK`` vectors.
2. Each query meets its own block first, which gives a score that its result must reach.
3. The least and largest distances of a block to each pivot bound all its vectors at
   once; a query is sent to the blocks that may still hold something for it, at most
   ``QUERIES`` queries of a block in one task.
4. The best of all blocks are merged by a window that keeps ``k`` rows a query.

Pivots are chosen by farthest-first traversal of a sample of ``SAMPLE`` vectors; which
they are changes the time, never the result. All vectors are candidates.

Defined cases: vectors that are null, or hold null or non-finite components, and rows
without an id take no part; repeated rows count once, and of different vectors
under one id the largest (as an array) counts; the shorter of two vectors counts as
filled up with zeros; components and scores beyond 64 bits take the nearest long; ties go to the
smaller vec_id; fewer than ``k`` candidates are all returned; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusmill.llm.common import forget, materialise, ship

PIVOTS, SAMPLE, BLOCK, QUERIES = 32, 2_048, 4_096, 2_048
#: Blocks whose ranges are broadcast at once: about 35 MB.
BLOCKS_AT_ONCE = 65_536
#: Candidates that a query evaluates in the first step; later steps take twice as many.
STEP = 64
RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, vector: str = "embedding", factor: float = 64.0) -> DataFrame:
    """(vec_id, v): floor(factor * component) of the sound vectors, one row an id."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).where(~bad)
    whole = F.transform(x, lambda c: F.floor(c * F.lit(factor)).cast("long"))
    return sound.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).groupBy("vec_id").agg(F.max("v").alias("v"))


def _table(vectors, width: int | None = None) -> np.ndarray:
    """Integer vectors as rows, filled up with zeros."""
    sizes = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    if len(sizes) and sizes.sum():
        out[np.arange(width) < sizes[:, None]] = np.concatenate(list(vectors))
    return out


def _distances(table: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(table.shape[1], pivots.shape[1])
    a, b = (np.pad(t.astype(float), ((0, 0), (0, width - t.shape[1]))) for t in (table, pivots))
    return np.sqrt(np.stack([((a - p) ** 2).sum(axis=1) for p in b], axis=1)) if len(b) else np.zeros((len(a), 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each next pivot is the vector farthest from those chosen."""
    if not len(sample):
        return sample
    chosen, near = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def products(table: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, as long; float arithmetic where no sum can leave 53 bits."""
    width = min(table.shape[1], len(q))
    a, b = table[:, :width], q[:width]
    if np.abs(a.astype(float)).max(initial=0) * np.abs(b.astype(float)).sum() < 2.0**52:
        return (a.astype(float) @ b.astype(float)).astype(np.int64)
    low, high = -(2**63), 2**63 - 1
    return np.array([min(high, max(low, sum(x * y for x, y in zip(r, b.tolist(), strict=True)))) for r in a.tolist()], dtype=np.int64)


def _upper(norms: np.ndarray, own: float, apart: np.ndarray) -> np.ndarray:
    """Bound of the score from the bound of the distance, with room for rounding."""
    apart = np.maximum(apart * (1 - 1e-9), 0)
    return (norms + own - apart**2) / 2 + 0.01 + 1e-9 * (norms + own)


def best_in_block(ids: np.ndarray, table: np.ndarray, d: np.ndarray, norms: np.ndarray, query: tuple, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of a block's best ``k`` for a query (id, vector, distances, norm, least score), best first."""
    own, q, dq, nq, least = query
    bound = _upper(norms, nq, np.abs(d - dq).max(axis=1, initial=0))
    order = np.flatnonzero((bound >= least) & (ids != own))
    order = order[np.argsort(-bound[order], kind="stable")]
    got_ids, got = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at, step = 0, STEP
    while at < len(order) and bound[order[at]] >= least:
        part = order[at : at + step]
        scores = products(table[part], q)
        got_ids, got = np.concatenate([got_ids, ids[part]]), np.concatenate([got, scores])
        keep = np.lexsort((got_ids, -got))[:k]
        got_ids, got = got_ids[keep], got[keep]
        if len(got) == k:
            least = max(least, int(got[-1]))
        at, step = at + step, 2 * step
    enough = got >= least
    return got_ids[enough], got[enough]


def _block(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return pdf["vec_id"].to_numpy(), _table(pdf["v"]), np.stack(pdf["d"].to_numpy()), pdf["norm"].to_numpy()


def _pivot_table(whole: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, d, norm, cell): the distances of every vector to all pivots."""

    def run(batches):
        for pdf in batches:
            table = _table(pdf["v"])
            d = _distances(table, pivots)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "d": list(d), "norm": (table.astype(float) ** 2).sum(axis=1), "cell": d.argmin(axis=1).astype(np.int64)})

    return whole.mapInPandas(run, "vec_id long, v array<long>, d array<double>, norm double, cell long")


def _routed(queries: DataFrame, ranges: pd.DataFrame) -> DataFrame:
    """``queries`` under every block of ``ranges`` (but their own) that may hold a vector of their least score or more."""
    low, high = np.stack(ranges["low"].to_numpy()), np.stack(ranges["high"].to_numpy())
    blocks, norms = ranges["block"].to_numpy(), ranges["norm"].to_numpy()

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                hits = []
                for d, norm, least, own in zip(part["d"], part["norm"], part["least"], part["block"], strict=True):
                    apart = np.maximum(np.maximum(low - d, d - high).max(axis=1, initial=0), 0)
                    hits.append(blocks[(_upper(norms, norm, apart) >= least) & (blocks != own)])
                if any(map(len, hits)):
                    out = part.iloc[np.repeat(np.arange(len(part)), [len(h) for h in hits])]
                    yield out[["vec_id", "v", "d", "norm", "least"]].assign(block=np.concatenate(hits))[["block", "vec_id", "v", "d", "norm", "least"]]

    return queries.mapInPandas(run, "block long, vec_id long, v array<long>, d array<double>, norm double, least double")


def top_k(vectors: DataFrame, is_query, k: int = 20, vector: str = "embedding", factor: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest scores of every row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    ship(spark)
    whole = materialise(integers(vectors, vector, factor), "top-integers")
    sample = whole.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    table = materialise(_pivot_table(whole, choose_pivots(_table([r["v"] for r in sample]), PIVOTS)), "top-table")
    cells = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}  # PIVOTS rows at most
    first, of_cell = 0, {}
    for cell, n in sorted(cells.items()):
        of_cell[cell] = (first, -(-n // BLOCK))
        first += of_cell[cell][1]
    dealt = F.create_map(*[F.lit(x) for cell, v in of_cell.items() for x in (cell, F.array(*map(F.lit, v)))]) if of_cell else F.create_map(F.lit(0), F.array(F.lit(0), F.lit(1)))
    place = F.element_at(dealt, F.col("cell").cast("int"))
    table = table.withColumn("block", (place[0] + F.pmod(F.xxhash64("vec_id"), place[1])).cast("long")).withColumn("asks", F.coalesce(is_query, F.lit(False)))
    blocked = materialise(table, "top-blocks")

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, rows, d, norms = _block(pdf)
        out = []
        for i in np.flatnonzero(pdf["asks"].to_numpy()):
            got, scores = best_in_block(ids, rows, d, norms, (ids[i], rows[i], d[i], norms[i], -np.inf), k)
            out.append(pd.DataFrame({"query_id": ids[i], "vec_id": got, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_id", "vec_id", "score")})

    near = materialise(blocked.groupBy("block").applyInPandas(home, RESULT), "top-near")
    least = near.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("s")).cast("double").alias("s"))
    queries = blocked.where("asks").join(least, "vec_id", "left").select("vec_id", "v", "d", "norm", "block", F.coalesce("s", F.lit(float("-inf"))).alias("least"))
    queries = materialise(queries, "top-queries")

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.stack(pdf["d"].to_numpy())
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "low": [d.min(axis=0)], "high": [d.max(axis=0)], "norm": [pdf["norm"].max()]})

    ranges = blocked.select("block", "d", "norm").groupBy("block").applyInPandas(spread, "block long, low array<double>, high array<double>, norm double")
    ranges = materialise(ranges, "top-ranges")
    sent = None
    for at in range(0, max(first, 1), BLOCKS_AT_ONCE):
        part = _routed(queries, ranges.where(F.col("block").between(at, at + BLOCKS_AT_ONCE - 1)).toPandas()) if first else queries.select("block", "vec_id", "v", "d", "norm", "least")
        sent = part if sent is None else sent.unionByName(part)
    sent = materialise(sent, "top-sent")
    asked = sent.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("chunks"))
    asked = materialise(asked, "top-asked")

    def far(key, pdf: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf):
            ids, rows, d, norms = _block(pdf)
            for own, q, dq, nq, low in zip(asking["vec_id"], asking["v"], asking["d"], asking["norm"], asking["least"], strict=True):
                got, scores = best_in_block(ids, rows, d, norms, (own, q, dq, nq, low), k)
                out.append(pd.DataFrame({"query_id": own, "vec_id": got, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, dtype=np.int64) for c in ("query_id", "vec_id", "score")})

    candidates = blocked.select("block", "vec_id", "v", "d", "norm").join(asked, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    of_block = asked.select(F.col("block").alias("to"), F.col("chunks").alias("of"))
    asking = sent.join(of_block, F.col("block") == F.col("to")).select(*sent.columns, F.pmod(F.xxhash64("vec_id"), F.col("of")).alias("chunk"))
    more = candidates.groupBy("block", "chunk").cogroup(asking.groupBy("block", "chunk")).applyInPandas(far, RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = near.unionByName(more).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = materialise(out, "top-result")
    for done in (whole, table, blocked, near, queries, ranges, sent, asked):
        forget(done)
    return out
