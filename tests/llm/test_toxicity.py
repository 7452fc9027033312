import itertools
import zlib

import numpy as np
import pytest

from tallyloom.llm import toxicity
from tests.llm.conftest import documents


def enumerated(scores, steps):
    """Marginals of the second state by adding up all label sequences that start in the first."""
    total, toxic = 0.0, np.zeros(len(scores))
    for labels in itertools.product((0, 1), repeat=len(scores)):
        value, before = 0.0, 0
        for s, now in zip(scores, labels):
            value += steps[before, now] + s * now
            before = now
        total += np.exp(value)
        toxic += np.exp(value) * np.array(labels)
    return toxic / total


def test_marginals_against_enumeration(monkeypatch):
    random = np.random.default_rng(4)
    lengths = np.array([3, 0, 9, 1, 12])
    scores, steps = random.normal(size=lengths.sum()), random.normal(size=(2, 2))
    for chunk in (4, 64):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        got, pairs = toxicity.Chain(lengths).run(scores, steps, pairs=True)
        parts = np.split(scores, np.cumsum(lengths)[:-1])
        expected = np.concatenate([enumerated(p, steps) if len(p) else [] for p in parts])
        assert np.allclose(got, expected)
        assert np.isclose(pairs.sum(), lengths.sum()) and np.isclose(pairs[:, 1].sum(), got.sum())


def corpus(n=600):
    random = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{''.join(random.choice(list('abcdefgh'), 3))}" for _ in range(random.integers(5, 80))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words[random.integers(0, len(words))] = str(random.choice(["rotten", "Foul", "grimy"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_learns_from_training_folds_only(spark):
    rows, labels = corpus()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    wrong = [(i, q, 1 - t if h else t) for (i, q, t), h in zip(labels, held)]
    docs = documents(spark, rows, ("score", "toxic"))
    models = [toxicity.fit(docs, spark.createDataFrame(ls, "doc_id long, quality int, toxic int")) for ls in (labels, wrong)]
    assert models[0].weights == models[1].weights
    got = {r["doc_id"]: r for r in toxicity.score(docs, models[0]).collect()}
    right = [got[i]["predicted"] == t for (i, _, t), h in zip(labels, held) if h]
    assert np.mean(right) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    texts = {i: t for i, t, _ in rows}
    found = {texts[i][s["start"] : s["end"]].lower() for i, r in got.items() for s in r["spans"]}
    assert found == {"rotten", "foul", "grimy"}


def test_keep_clean(spark):
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept.collect()} == clean


@pytest.mark.parametrize("labels", [[], [(5, 1, 1), (5, None, None), (None, 1, 1)]])
def test_odd_and_empty(spark, odd, labels):
    model = toxicity.fit(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == 10 and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in rows)
    assert toxicity.keep_clean(odd, model).count() == 10
    assert toxicity.score(odd.limit(0), model).collect() == []
    assert toxicity.keep_clean(odd.limit(0), model).collect() == []


def test_labels_of_absent_documents_change_nothing(spark):
    """Ten times as many labels as documents leave the sample as it is."""
    rows, labels = corpus(300)
    docs = documents(spark, rows)
    more = labels + [(10_000 + i, 1, int(i % 2)) for i in range(3000)]
    sample = toxicity.Sample(toxic=40, clean=80)
    models = [toxicity.fit(docs, spark.createDataFrame(ls, "doc_id long, quality int, toxic int"), sample) for ls in (labels, more)]
    assert models[0].weights and models[0].weights == models[1].weights and np.array_equal(models[0].curve, models[1].curve)
    assert toxicity.keep_clean(docs, models[1]).count() == sum(t == 0 for _, _, t in labels)


@pytest.mark.parametrize("toxic", [0, 1])
def test_labels_of_one_kind_call_nothing_toxic(spark, toxic):
    rows, labels = corpus(100)
    docs = documents(spark, rows)
    for known in ([(i, 1, toxic) for i, _, _ in labels], [(10_000 + i, 1, i % 2) for i, _, _ in labels]):
        model = toxicity.fit(docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"))
        assert toxicity.keep_clean(docs, model).count() == 100


def test_words_that_tell_nothing_call_nothing_toxic(spark):
    docs = documents(spark, [(i, "the same words again", "s") for i in range(60)])
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs, model).where("predicted = 1").count() == 0
