import numpy as np
import pytest

from tallyloom.llm import cover_tree, nearest, tiles

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA)


def brute_force(rows, score, usable, k=20):
    rows = [(i, v) for i, v in rows if i is not None and v and usable(v)]
    out = []
    for n, (q, a) in enumerate(rows):
        if q % 20:
            continue
        best = sorted((-score(a, b), i) for m, (i, b) in enumerate(rows) if m != n and len(a) == len(b))[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def finite(v):
    return all(x is not None and np.isfinite(x) for x in v)


def dot(a, b):
    total = 0.0
    for x, y in zip(np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)):
        total += x * y
    return total


def whole(a, b):
    return sum(int(x) * int(y) for x, y in zip(*(np.floor(64 * np.array(v, np.float32).astype(float)) for v in (a, b))))


def odd_rows():
    random = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(random.normal(size=(90, 6)))]
    rows += [(i, rows[3][1]) for i in range(100, 140)]  # ties beyond k
    rows += [(20, rows[5][1]), (21, None), (22, []), (40, [0.0] * 6), (23, [None] + [1.0] * 5), (24, [float("inf")] * 6)]
    return rows + [(25, [float("nan")] * 6), (None, [1.0] * 6), (60, [1.0, 2.0]), (26, [2.0, 1.0]), (27, [1e30] * 6)]


@pytest.mark.parametrize("block", [8192, 16])
def test_nearest(spark, monkeypatch, block):
    rows = odd_rows()
    monkeypatch.setattr(nearest, "search", lambda *a, **b: tiles.search(*a, **b, block=block))
    got = sorted(tuple(r) for r in nearest.nearest(vectors(spark, rows)).collect())
    assert got == brute_force(rows, dot, lambda v: finite(v) and any(v))


@pytest.mark.parametrize("block", [8192, 16])
def test_top_products(spark, monkeypatch, block):
    rows = [(i, v if v is None or 1e30 not in v else [3e5] * 6) for i, v in odd_rows()]
    monkeypatch.setattr(cover_tree, "search", lambda *a, **b: tiles.search(*a, **b, block=block))
    monkeypatch.setattr(cover_tree, "LEAF", 4)
    got = sorted(tuple(r) for r in cover_tree.top_products(vectors(spark, rows)).collect())
    assert got == brute_force(rows, whole, finite)


def test_few_and_none(spark):
    rows = [(0, [1.0, 0.0]), (7, [0.5, 0.5]), (9, [0.0, 1.0])]
    assert [tuple(r) for r in nearest.nearest(vectors(spark, rows)).collect()] == [(0, 1, 7, 0.5), (0, 2, 9, 0.0)]
    for search in (nearest.nearest, cover_tree.top_products):
        assert search(vectors(spark, rows).limit(0)).collect() == []
        assert search(vectors(spark, rows).where("vec_id = 0")).collect() == []


def test_bounds_hold():
    random = np.random.default_rng(2)
    x, y = random.normal(size=(40, 64)), random.normal(size=(70, 64)) * 3
    (xc, xs, xe, _), (yc, ys, ye, yn) = nearest._codes(x), nearest._codes(y)
    about = nearest._product(xc, yc) * (xs[:, None] * ys[None, :])
    error = np.linalg.norm(x, axis=1)[:, None] * ye[None, :] + xe[:, None] * yn[None, :]
    assert (np.abs(x @ y.T - about) <= error).all()


def test_cover_tree_covers():
    x = np.random.default_rng(3).normal(size=(700, 8))
    todo, seen = [cover_tree.cover_tree(x)], 0
    while todo:
        node = todo.pop()
        assert np.linalg.norm(x[node.points] - node.centre, axis=1).max() <= node.radius
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            assert (node.children[0].centre == node.centre).all()
        else:
            seen += len(node.points)
        todo += node.children
    assert seen == len(x)


def test_products_beyond_doubles():
    a, b = np.array([[1 << 40, 3]]), np.array([[1 << 20, 1], [1 << 20, 2], [5, 5]])
    q, c, s = cover_tree.dual_tree(a, np.array([9]), b, np.array([1, 2, 3]), np.array([1, 2, 3]), 2)
    assert sorted(zip(s.tolist(), c.tolist())) == [((1 << 60) + 3, 0), ((1 << 60) + 6, 1)]


def test_scores_beyond_a_long_stand_at_its_end(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 0.0])]
    got = {r["vec_id"]: r["score"] for r in cover_tree.top_products(vectors(spark, rows)).collect()}
    assert got == {1: (1 << 63) - 1, 2: -(1 << 63)}
