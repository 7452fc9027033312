import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import outliers
from tests.llm.conftest import CLASHING, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked)


def check_counts(docs):
    rows = outliers.judge(docs).select("doc_id", *outliers.COUNTS[:5], "base_failed", "kept").collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        counts = plain(r["text"])
        expected.append((r["doc_id"], *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0]))
    key = lambda r: str(r)
    assert sorted((tuple(r)[:-1] for r in rows), key=key) == sorted(expected, key=key)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    return rows


def test_table(spark, sf_dir):
    rows = check_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    passed = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] for r in passed) > 0.8 * len(passed)


def test_odd_and_empty(spark, odd):
    rows = check_counts(odd)
    assert len(rows) == 10 and not any(r["kept"] for r in rows)
    assert outliers.judge(odd.limit(0)).collect() == []


def test_windows(spark):
    texts = ["a a a a", "a b c a b c", "a b\nc\na b c d", "A b c a b c", "x y", "é# % <b>|\t\x0b&", "l\n\nl\n l\nl \nl", "#" * 5]
    check_counts(documents(spark, [(i, t, "s") for i, t in enumerate(texts)], CLASHING))


def text_of(rng, n, symbols=0.0, length=5):
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(length - 2, length + 2))) for _ in range(n)]
    return " ".join(w + ("#" * 4 if rng.random() < symbols else "") for w in words)


@pytest.fixture(scope="module")
def mixed(spark):
    """Two sources; in one of them two of five texts are full of symbols, another has few texts."""
    rng = random.Random(3)
    rows = [(i, text_of(rng, rng.randint(60, 300)), "a") for i in range(300)]
    rows += [(1000 + i, text_of(rng, rng.randint(60, 300), 0.9 if i % 5 < 2 else 0.0), "b") for i in range(300)]
    rows += [(2000 + i, text_of(rng, rng.randint(60, 300)), "few") for i in range(5)] + [(2100, text_of(rng, 100, 1.0), "a")]
    return documents(spark, rows).withColumnRenamed("lang", "score").selectExpr("*", "'en' AS lang").cache()


def test_outliers_go_and_the_rest_stays(mixed):
    kept = {r["doc_id"]: r["kept"] for r in outliers.judge(mixed).collect()}
    assert all(kept[i] for i in range(300))
    assert not kept[2100]
    assert [kept[1000 + i] for i in range(300)] == [i % 5 >= 2 for i in range(300)]  # 40 % of a source do not sway it
    assert all(kept[2000 + i] for i in range(5))  # too few to judge


def test_reruns_agree(mixed):
    rows = [sorted(map(tuple, outliers.judge(df).collect())) for df in (mixed, mixed.repartition(3))]
    assert rows[0] == rows[1]


def _points(spark, x, weights=None):
    rows = [("p", *map(int, np.round(v * outliers.GRID)), int(w)) for v, w in zip(x, weights if weights is not None else np.ones(len(x)))]
    return spark.createDataFrame(rows, "pool string, " + ", ".join(f"{c} long" for c in outliers.X) + ", w long")


def _plain_mcd(x, rules, draws=200):
    """The least determinant over concentrations of random halves, by the definition."""
    rng = np.random.default_rng(1)
    h, wide, best = (len(x) + outliers.P + 1) // 2, np.diag(np.square(rules.tolerance)), (np.inf, None)
    factor = outliers.consistency(0.5)
    for _ in range(draws):
        subset = rng.choice(len(x), outliers.P + 1, replace=False)
        for _ in range(30):
            centre, cov = x[subset].mean(0), factor * np.cov(x[subset].T, bias=True) + wide
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            following = np.argsort(d, kind="stable")[:h]
            if set(following) == set(subset):
                break
            subset = following
        det = np.linalg.slogdet(factor * np.cov(x[subset].T, bias=True) + wide)[1]
        best = min(best, (det, tuple(centre)))
    return best


def test_determinant_is_as_low_as_random_halves_find(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rules = outliers.Rules(tolerance=(0.05,) * 5)
    a = rng.normal(size=(5, 5))
    x = np.vstack([rng.normal(size=(400, 5)) @ a, rng.normal(size=(120, 5)) + 12])
    points = _points(spark, x)
    steps = []
    original = outliers._concentrated
    monkeypatch.setattr(outliers, "_concentrated", lambda *args: steps.append(original(*args)) or steps[-1])
    model = outliers.estimates(points, rules).first()
    best, _ = _plain_mcd(x, rules)
    assert steps[-1].first()["logdet"] < best + 0.25  # its half takes in whole ranks
    centre = np.array(model["centre"])
    assert np.abs(centre - x[:400].mean(0)).max() < 0.5 * np.abs(a).sum(0).max()
    d = np.einsum("ij,jk,ik->i", x - centre, np.array(model["inverse"]).reshape(5, 5), x - centre)
    cut = outliers.chi2_quantile(0.999, 5)
    assert (d[400:] > cut).all() and (d[:400] > cut).mean() < 0.03


def test_copies_weigh_as_often_as_they_stand(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(200, 5)), rng.integers(1, 4, 200)
    once = outliers.estimates(_points(spark, x, w)).first()
    spread = outliers.estimates(_points(spark, np.repeat(x, w, axis=0))).first()
    assert once == spread


def test_equal_vectors_give_no_singular_matrix(spark):
    x = np.vstack([np.ones((300, 5)), np.ones((40, 5)) * [1, 1, 3, 1, 1]])
    model = outliers.estimates(_points(spark, x)).first()
    assert model["centre"] == [1.0] * 5 and np.isfinite(model["inverse"]).all()


def test_chi_squared():
    for q, k, x in ((0.95, 1, 3.8415), (0.975, 5, 12.8325), (0.999, 7, 24.3219), (0.5, 5, 4.3515)):
        assert outliers.chi2_quantile(q, k) == pytest.approx(x, abs=1e-3)
