import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import token_files as tf
from tallyloom.session import scratch_path
from tests.llm.conftest import documents

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_grammar_round_trip():
    random = np.random.default_rng(5)
    for ids in (
        random.integers(0, 50, 20_000), np.zeros(5000, np.int64), np.tile([1, 2, 3], 3000), np.array([7]), np.empty(0, np.int64),
        random.zipf(1.3, 30_000) % 49_000,
    ):
        symbols, rules = tf.repair(ids, 50_000)
        assert tf.expand(symbols, rules, 50_000).tolist() == ids.tolist()
    assert len(tf.repair(np.tile([1, 2, 3, 4], 3000), 50_000)[0]) < 3000


def uses(symbols):
    """Uses of the most frequent pair, overlapping ones of one symbol counted once."""
    counts, last = {}, {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        if last.get(pair) != i - 1 or pair[0] != pair[1]:
            counts[pair] = counts.get(pair, 0) + 1
            last[pair] = i
    return max(counts.values(), default=0)


def test_no_frequent_pair_is_left():
    random = np.random.default_rng(8)
    passage = random.integers(0, 49_000, 1000)
    shared = np.concatenate([np.concatenate((passage, random.integers(0, 49_000, 50))) for _ in range(60)])
    for ids in (np.tile(passage, 100), shared, random.zipf(1.3, 60_000) % 49_000, random.integers(0, 60, 300_000), np.zeros(70_000, np.int64)):
        symbols, rules = tf.repair(ids, 50_000)
        assert uses(symbols.tolist()) < tf.LEAST
        assert tf.expand(symbols, rules, 50_000).tolist() == ids.tolist()
    assert len(tf.repair(np.tile(passage, 100), 50_000)[0]) < 120
    assert len(tf.repair(shared, 50_000)[0]) < 60 * 60
    row = tf._row(0, 0, 50_000, [1], [np.tile(passage, 100)])
    assert tf.span(row, 54_321, 777).tolist() == np.tile(passage, 100)[54_321 : 54_321 + 777].tolist()


def test_spans_without_the_rest_of_the_block():
    ids = np.random.default_rng(6).zipf(1.4, 20_000) % 300
    row = tf._row(0, 0, 50_000, [1], [ids])
    for start, count in ((0, 10), (777, 1), (9_999, 513), (19_990, 50), (0, 20_000)):
        assert tf.span(row, start, count).tolist() == ids[start : start + count].tolist()


def test_files(spark, tokenizer, monkeypatch):
    rows = [(i * 7 % 101, f"Some Words of {i} and it's THE end. " * (i % 9), "s") for i in range(101)]
    path = scratch_path(spark, "test-files")
    tf.write_ids(documents(spark, rows).repartition(5), path, FILE)
    start = 0
    expected = []
    for i, text, _ in sorted(rows):
        ids = ids_of(tokenizer, text)
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in tf.read_digests(spark, path).collect()) == expected
    ids = {r["doc_id"]: r["ids"] for r in tf.read_ids(spark, path).collect()}
    assert all(ids[i] == ids_of(tokenizer, t) for i, t, _ in rows)


def test_special_names_and_blanks(spark, tokenizer):
    texts = ["<|endoftext|> x", "a\x1cb  c d", "İSTANBUL ΟΔΟΣ", "é ́e", "'S 'll don'T", "12345"]
    got = tf.round_trip(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]), FILE)
    for r in got.collect():
        ids = ids_of(tokenizer, texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_odd_and_empty(spark, odd, tokenizer):
    rows = tf.round_trip(odd, FILE).collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in rows) == sorted((str(t["doc_id"]), len(ids_of(tokenizer, t["text"]))) for t in texts)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered[:-1])]).tolist()
    assert [r["doc_id"] for r in ordered] == [1, 2, 3, 4, 5, 5, 6, 7, None, None]
    assert tf.round_trip(odd.limit(0), FILE).collect() == []
