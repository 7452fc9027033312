import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import minhash
from tallyloom.llm.components import components
from tallyloom.llm.words import shingle_sets, word_hashes
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_force(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if None not in (i, j) and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


def varied(seed, n, base_words, edits):
    """A base text and ``n`` variants with random words replaced."""
    random = np.random.default_rng(seed)
    base = [f"w{i}" for i in random.integers(0, 5000, base_words)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for at in random.integers(0, base_words, random.integers(0, edits + 1)):
            words[at] = f"v{random.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def test_words_and_shingles():
    texts = ["A b\tC", None, "", "Äb  äb", "one two three four five six", "x" * 3_000_000 + " y", "a b c d e f"]
    words, bounds = word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [len(WORD.findall(t or "")) for t in texts]
    assert words[0] == word_hashes(pa.array(["a"]))[0][0] != words[1]
    assert words[bounds[3]] != words[bounds[3] + 1]  # only A-Z are lower-cased
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(plain_set(t)) for t in texts]
    assert len(shingle_sets(pa.array(["tail", *texts])[1:])[4]) == 2


@pytest.mark.parametrize("edits", [1, 6])
def test_near_duplicates_against_brute_force(spark, edits):
    rows = varied(edits, 150, 120, edits) + [(1000 + i, t) for i, t in varied(9, 40, 60, 3)]
    rows += [(2000 + i, f"common words that many share in a line of text {i} and then its own end {i * i}") for i in range(60)]
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    assert found(minhash.near_duplicates(docs)) == brute_force(rows)


def test_hot_bucket_is_compared_in_blocks(spark, monkeypatch):
    """Variants too far from the pivot still find each other, in parts that meet pairwise."""
    monkeypatch.setattr(minhash, "PART", 8)
    rows = varied(3, 120, 60, 4)
    docs = documents(spark, [(i, t, "s") for i, t in rows])
    assert found(minhash.near_duplicates(docs, minhash.Banding(sketches=12, minhashes=2))) == brute_force(rows)


def test_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(minhash.near_duplicates(odd)) == brute_force(rows)
    kept = minhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 7, None])


def test_empty(spark, odd):
    assert minhash.near_duplicates(odd.limit(0)).collect() == []
    assert minhash.drop_near_duplicates(odd.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 250), (250, 200), (250, 260)] + [(300, i) for i in range(301, 340)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 200: 200, 250: 200, 260: 200, **{i: 300 for i in range(300, 340)}}
