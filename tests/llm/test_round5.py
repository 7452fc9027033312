"""Token files: pieces met before are looked up once, and the pairs of a large block are numbered without a search for each."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa

from tallyloom.llm import token_files as t
from tallyloom.llm.units import Pieces, tokenizer_of


def pieces():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return Pieces(tokenizer_of(file.read()), keep_space=False, lower=True)


def test_known_pieces_are_not_learned_again(monkeypatch):
    found, asked = pieces(), []
    learn = found._learn
    monkeypatch.setattr(found, "_learn", lambda new: asked.append(set(new)) or learn(new))
    long = "x" * 100
    texts = ["The dog, the DOG.\nIt's here", "", "a  b", f"{long} end", "Éa! <|endoftext|>"]
    for column in (texts, texts[::-1], ["", ""], texts + ["dog cat"]):
        flat, counts = found.encode_column(pa.array(column))
        expected = [found.tokenizer.encode(text, add_special_tokens=False).ids for text in column]
        assert flat.tolist() == [i for ids in expected for i in ids] and counts.tolist() == [len(ids) for ids in expected]
    # long pieces are not remembered
    assert len(asked[0]) > 5 and asked[1:] == [{long}, set(), {long, "cat"}]
    # pieces of the generation before are taken from it
    found.remembered = 1
    assert found.encode_column(pa.array(texts))[0].tolist() == [i for text in texts for i in found.tokenizer.encode(text, add_special_tokens=False).ids]
    # a slice of a column
    assert found.encode_column(pa.array(texts).slice(1, 3))[1].tolist() == [0, 2, len(found.tokenizer.encode(texts[3]).ids)]


def test_pairs_that_share_a_slot():
    rng = np.random.default_rng(3)
    kept = np.unique((rng.integers(0, 60_000, 30_000) << 32) | rng.integers(0, 60_000, 30_000))
    pairs = np.concatenate((rng.permutation(kept), kept[:50] + 1))
    slot = t._slots((pairs >> 32).astype(np.uint32), pairs.astype(np.uint32))
    assert len(np.unique(slot)) < len(kept) - 500
    number = t._numbers(pairs, slot, kept)
    there = np.isin(pairs, kept)
    assert (kept[number[there]] == pairs[there]).all() and (kept[number[~there]] != pairs[~there]).all()


def test_large_blocks_are_numbered_without_a_search(monkeypatch):
    rng, searched = np.random.default_rng(4), []
    ids = np.concatenate((rng.zipf(1.3, 300_000) % 3000, np.zeros(999, int), np.tile([1, 2], 777)))
    search = np.searchsorted
    monkeypatch.setattr(t.np, "searchsorted", lambda a, v, **k: searched.append(np.size(v)) or search(a, v, **k))
    symbols, rules = t.repair(ids, 5000)
    assert max(searched) < t.SLOTS >> 4
    assert (t.expand(symbols, rules, 5000) == ids).all()


def test_overlapping_places_and_cuts():
    rng = np.random.default_rng(6)
    for share in (0.1, 0.5, 0.9, 1):
        places = np.flatnonzero(rng.random(3000) < share)
        expected, last = [], -2
        for i, place in enumerate(places.tolist()):
            if place != last + 1:
                expected.append(i)
                last = place
        at, number = t._apart(places, np.arange(len(places)))
        assert number.tolist() == expected and at.tolist() == places[expected].tolist()
    values, other = np.arange(5000), rng.random(5000) < 0.5
    for n in (1, 2, t.CUTS - 1, t.CUTS, 5000):
        gone = np.sort(rng.choice(5000, n, replace=False))
        left = t._without(gone, values, other)
        assert left[0].tolist() == np.delete(values, gone).tolist() and left[1].tolist() == np.delete(other, gone).tolist()
