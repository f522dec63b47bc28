"""Which ids only one of two large sets has, without shuffling the sets.

Each task adds its ids to a small table (an invertible Bloom lookup table): a count, the
exclusive or of the ids' hashes, and that of a second hash, in one cell of each of
``HASHES`` parts. Tables of tasks merge cell by cell, one set counts up and the
other down, so what both sets have cancels out. The difference is peeled off the merged
table, whose ``CELLS`` cells are all that moves. The ids it names are then looked up in
both sets, and compared exactly. If the table does not empty (more than some 0.7
``CELLS`` differences, or an id that one set repeats), the sets meet by an exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.audit import set_audit

HASHES, CELLS = 4, 16_384
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (j + 1) % 2**64) for j in range(HASHES)]


def _cells(ids: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each id in each part of the table (a row a part)."""
    out = []
    for j, seed in enumerate(_SEEDS):
        x = ids.view(np.uint64) + seed
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        part = cells // HASHES
        out.append(((x >> np.uint64(33)) % np.uint64(part)).astype(np.int64) + j * part)
    return np.stack(out)


def _added(df: DataFrame, sign: int, cells: int) -> DataFrame:
    """(cell, n, ids, checks) of each task's rows of (id, check)."""

    def run(batches):
        n, ids, checks = (np.zeros(cells, dtype=np.int64) for _ in range(3))
        for pdf in batches:
            own, second = pdf["id"].to_numpy(), pdf["check"].to_numpy()
            for row in _cells(own, cells):
                n += sign * np.bincount(row, minlength=cells)
                np.bitwise_xor.at(ids, row, own)
                np.bitwise_xor.at(checks, row, second)
        some = np.flatnonzero((n != 0) | (ids != 0) | (checks != 0))
        yield pd.DataFrame({"cell": some, "n": n[some], "ids": ids[some], "checks": checks[some]})

    return df.mapInPandas(run, "cell long, n long, ids long, checks long")


def peeled(cell: np.ndarray, n: np.ndarray, ids: np.ndarray, checks: np.ndarray, cells: int) -> list[int] | None:
    """The ids of the difference; None if the table does not empty."""
    table = {int(c): [int(a), int(b), int(d)] for c, a, b, d in zip(cell, n, ids, checks, strict=True)}
    found, open_ = [], [c for c, v in table.items() if abs(v[0]) == 1]
    while open_:
        c = open_.pop()
        held = table.get(c)
        if held is None or abs(held[0]) != 1:
            continue
        count, one, check = held
        own = _cells(np.array([one], dtype=np.int64), cells)[:, 0].tolist()
        if c not in own:  # several ids that happen to count as one
            continue
        found.append(one)
        for other in own:
            v = table.setdefault(other, [0, 0, 0])
            v[0], v[1], v[2] = v[0] - count, v[1] ^ one, v[2] ^ check
            if not any(v):
                del table[other]
            elif abs(v[0]) == 1:
                open_.append(other)
        if len(found) > cells:
            return None
    return found if not table else None


def difference_ids(expected: DataFrame, actual: DataFrame, key: str, cells: int = CELLS) -> list[int] | None:
    """Hashes of the ids that the two sets do not share, at most ``cells``; None if there are too many or one set repeats some."""
    sides = [_added(df.select(*_hashes(key)), sign, cells) for df, sign in ((expected, 1), (actual, -1))]
    merged = sides[0].unionByName(sides[1]).groupBy("cell").agg(F.sum("n").alias("n"), F.bit_xor("ids").alias("ids"), F.bit_xor("checks").alias("checks"))
    got = merged.where("n <> 0 or ids <> 0 or checks <> 0").toPandas()  # CELLS rows at most
    return peeled(*(got[c].to_numpy(dtype=np.int64) for c in ("cell", "n", "ids", "checks")), cells)


def _hashes(key: str) -> list:
    return [F.xxhash64(F.col(key)).alias("id"), F.xxhash64(F.lit("second"), F.col(key)).alias("check")]


def reconcile(expected: DataFrame, actual: DataFrame, key: str, cells: int = CELLS) -> DataFrame:
    """key, side as :func:`audit.set_audit` has them, for sets of ids that hardly differ. Null ids count as one id."""
    named = difference_ids(expected, actual, key, cells)
    if named is None:
        return set_audit(expected, actual, key)
    asked = expected.sparkSession.createDataFrame([(x,) for x in named], "__asked long")
    some = lambda df: df.select(key).join(F.broadcast(asked), F.xxhash64(F.col(key)) == F.col("__asked"), "left_semi")
    return set_audit(some(expected), some(actual), key)
