"""Exact top-k inner products by dual-tree search over cover trees of queries and rows.

A node covers its points by a centre and the exact distance to the farthest of them. With centres
a, b and radii r, s no pair below two nodes has a product above ``a.b + r|b| + s|a| + rs``; a pair of
nodes whose bound is below the worst k-th best score of the query node's group is pruned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.tiles import search, usable

LEAF = 512
#: Children of a node at most; the cover then keeps the radius that it has reached.
FAN = 16
#: Sums of integer products are exact in double precision below this.
EXACT = float(1 << 53)


class Node:
    """Points below a node (places in the block), their centre, covering radius and the children."""

    __slots__ = ("points", "centre", "norm", "radius", "children")

    def __init__(self, x: np.ndarray, points: np.ndarray, centre: int, far: np.ndarray):
        self.points = points
        self.centre = x[centre]
        self.norm = float(np.linalg.norm(self.centre))
        self.radius = float(far.max(initial=0.0)) * (1 + 1e-9)
        self.children: list[Node] = []


def _distances(x: np.ndarray, points: np.ndarray, centre: int) -> np.ndarray:
    return np.linalg.norm(x[points] - x[centre], axis=1)


def cover_tree(x: np.ndarray) -> Node:
    """Each node keeps its own centre as first child, as a cover tree does; further centres are the
    farthest points, so that they are at least a covering radius apart, until the radius has halved."""
    start = np.arange(len(x))
    root = Node(x, start, 0, _distances(x, start, 0))
    open_nodes = [(root, 0)]
    while open_nodes:
        node, centre = open_nodes.pop()
        if len(node.points) <= LEAF or node.radius == 0:
            continue
        centres, near = [centre], _distances(x, node.points, centre)
        owner = np.zeros(len(near), np.int64)
        goal = node.radius / 2
        while len(centres) < FAN and near.max() > goal:
            new = int(node.points[near.argmax()])
            far = _distances(x, node.points, new)
            closer = far < near
            owner[closer], near[closer] = len(centres), far[closer]
            centres.append(new)
        for i, c in enumerate(centres):
            mine = owner == i
            child = Node(x, node.points[mine], c, near[mine])
            node.children.append(child)
            open_nodes.append((child, c))
    return root


def _bound(a: Node, b: Node) -> float:
    bound = float(a.centre @ b.centre) + a.radius * b.norm + b.radius * a.norm + a.radius * b.radius
    return bound + 1e-9 * (1 + abs(bound))


def dual_tree(asks, ask_rows, rows, row_numbers, ids, k):
    """The tile kernel: best-first over pairs of nodes, leaves by one exact product each."""
    if not len(rows) or not len(asks):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = asks.astype(np.float64), rows.astype(np.float64)
    exact = np.abs(x).max() * np.abs(y).max() * x.shape[1] < EXACT
    whole_x, whole_y = (x, y) if exact else (asks.astype(object), rows.astype(object))
    score = np.full((len(x), k), -np.inf if exact else -(1 << 200), np.float64 if exact else object)
    place = np.full((len(x), k), -1, np.int64)
    worst = np.full(len(x), -np.inf)
    stack = [(cover_tree(x), cover_tree(y))]
    while stack:
        a, b = stack.pop()
        if _bound(a, b) < worst[a.points].min():
            continue
        if not a.children and not b.children:
            _leaves(a.points, b.points, whole_x, whole_y, ask_rows, row_numbers, ids, score, place, worst)
            continue
        if not b.children or (a.children and a.radius > b.radius):
            pairs = [(c, b) for c in a.children]
        else:
            pairs = [(a, c) for c in b.children]
        stack += sorted(pairs, key=lambda p: _bound(*p))  # the most promising pair is taken next
    q, c = np.nonzero(place >= 0)
    found = score[q, c]
    if not exact:  # a score beyond the range of the column is its end
        found = np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in found], object)
    return q, place[q, c], found.astype(np.int64)


def _leaves(q, c, x, y, ask_rows, row_numbers, ids, score, place, worst) -> None:
    """Score all pairs of two leaves; what reaches a query's worst kept score joins its list."""
    k = score.shape[1]
    products = x[q] @ y[c].T
    own = ask_rows[q][:, None] == row_numbers[c][None, :]
    able = products >= worst[q][:, None]
    if len(c) > k and products.dtype == np.float64:
        # lists that are not full yet take the k best of this leaf, with ties, and the own row beside them
        new = np.flatnonzero(place[q, -1] < 0)
        if len(new):
            able[new] &= products[new] >= np.partition(products[new], len(c) - k - 1, axis=1)[:, -k - 1, None]
    i, j = np.nonzero(able & ~own)
    if not len(i):
        return
    changed, row = np.unique(i, return_inverse=True)
    at = q[changed]
    rows = np.concatenate((np.repeat(np.arange(len(at)), k), row))
    scores = np.concatenate((score[at].ravel(), products[i, j]))
    places = np.concatenate((place[at].ravel(), c[j]))
    names = np.where(places >= 0, ids[places], np.iinfo(np.int64).max)
    if scores.dtype == np.float64:
        order = np.lexsort((names, -scores, rows))
    else:  # products too large for doubles: compared as Python integers
        order = np.array(sorted(range(len(rows)), key=lambda n: (rows[n], -scores[n], names[n])))
    rows = rows[order]
    order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k].reshape(-1, k)
    score[at], place[at] = scores[order], places[order]
    worst[at] = score[at][:, -1].astype(np.float64)


def integers(vector: Column, scale: int = 64) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_products(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): highest inner products of ``floor(scale * component)`` vectors.

    Queries are the rows whose id ``every`` divides, candidates all rows but the query's own; ties go to the
    smaller id. Null or empty vectors, those with a null or non-finite component and rows without an
    id take no part; zero vectors do. Scores beyond a long stand at its end. Rows that repeat an id are rows of their own. With fewer than
    ``k`` candidates all are returned, of an empty table none.
    """
    usable_rows = vectors.where(usable(F.col("embedding"), zero=True)).select("vec_id", integers(F.col("embedding"), scale).alias("vector"))
    return search(usable_rows, F.col("vec_id") % every == 0, dual_tree, k, whole=True)


#: The same by all pairs.
SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 20
"""
