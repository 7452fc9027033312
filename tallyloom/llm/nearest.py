"""Nearest neighbours by a block matrix join of int8 codes with error bounds.

A tile multiplies int8 codes of queries and rows. The rounding error of each side bounds how far
the product of codes is from the true inner product, so a pair whose upper bound is below the
query's k-th best lower bound is out. Pairs that survive are computed in double precision.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tiles import search, usable

#: Queries multiplied with a block at once.
STRIP = 256
#: Components whose int8 products add up exactly in float32.
EXACT = 1024


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of the rounding error and norm of the coded vector, per row."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(x - coded, axis=1), np.linalg.norm(coded, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 codes."""
    total = np.zeros((len(a), len(b)), np.float64 if a.shape[1] > EXACT else np.float32)
    for lo in range(0, a.shape[1], EXACT):
        total += a[:, lo : lo + EXACT].astype(np.float32) @ b[:, lo : lo + EXACT].astype(np.float32).T
    return total


def exact_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added component by component."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j].astype(np.float64) * rows[:, j].astype(np.float64)
    return total


def quantised(asks, ask_rows, rows, row_numbers, ids, k):
    """The tile kernel: every row that can be among a query's k best of this block is scored exactly."""
    empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(rows) or not len(asks):
        return empty
    x, y = asks.astype(np.float64), rows.astype(np.float64)
    (xc, xs, xe, _), (yc, ys, ye, yn) = _codes(x), _codes(y)
    norms = np.linalg.norm(x, axis=1)
    own = {int(r): i for i, r in enumerate(row_numbers)}
    found = []
    for lo in range(0, len(x), STRIP):
        part = slice(lo, lo + STRIP)
        about = _product(xc[part], yc) * (xs[part, None] * ys[None, :])
        # |x.y - x'.y'| <= |x||y - y'| + |x - x'||y'|, and a little for float32 and float64 rounding
        error = (norms[part, None] * ye[None, :] + xe[part, None] * yn[None, :]) * (1 + 1e-6) + 1e-6 * np.abs(about)
        lower = about - error
        mine = [(i, own[int(r)]) for i, r in enumerate(ask_rows[part]) if int(r) in own]
        for i, j in mine:
            lower[i, j] = -np.inf
        if lower.shape[1] > k:
            worst = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
        else:
            worst = np.full(len(lower), -np.inf)
        near = about + error >= worst[:, None]
        for i, j in mine:
            near[i, j] = False
        q, c = np.nonzero(near)
        score = exact_scores(x[part][q], y[c])
        order = np.lexsort((ids[c], -score, q))
        q, c, score = q[order], c[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        found.append((q[keep] + lo, c[keep], score[keep]))
    return tuple(np.concatenate(part) for part in zip(*found))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors`` (vec_id, embedding).

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own; a larger inner
    product is nearer, ties go to the smaller id. Null, empty or zero vectors, those with a null or
    non-finite component and rows without an id take no part. Rows that repeat an id are rows of
    their own. With fewer than ``k`` candidates all are returned, of an empty table none.
    """
    usable_rows = vectors.select("vec_id", F.col("embedding").alias("vector")).where(usable(F.col("vector"), zero=False))
    return search(usable_rows, F.col("vec_id") % every == 0, quantised, k, whole=False)


#: The same by all pairs.
SQL = """
WITH usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]), lambda a, b: a + b) AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 20
"""
