"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow column.

A word is a run of characters other than space and U+0009 to U+000D, in which A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyloom.llm.units import runs

SHINGLE = 5
#: Bytes hashed at once; bounds the temporary arrays, whatever the length of a text.
SPAN = 1 << 20
#: Bytes of texts in a slice of a batch, unless one text has more.
SLICE = 1 << 22

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_CASED = _BYTE.copy()
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RANDOM.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts are bounded in sum, however long single ones are."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for lo, hi in runs([n + 64 for n in sizes], most):
        yield batch.slice(lo, hi - lo)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values; equal values stay equal."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SPAN + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have


def _hash_span(data: np.ndarray, breaks: np.ndarray, codes: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of ``data``; ``breaks`` are places at which a new text begins."""
    inside = _IS_WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    breaks = breaks[breaks < len(data)]
    first[breaks] = inside[breaks]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = breaks[breaks > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _powers_of(_BASE, len(data))[: len(data)], out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers_of(_BASE_INVERSE, len(data) + 1)[starts]
    return starts, mix(words + (ends - starts).astype(np.uint64))


def word_hashes(texts: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and the place of each text's first word, with the end last.

    Null texts have no words. Without ``fold`` capitals are letters of their own.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    if texts.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + SPAN)
        while end < len(data):  # no word may be cut: go on to the next blank
            blanks = np.flatnonzero(~_IS_WORD[data[end : end + SPAN]])
            if len(blanks):
                end += int(blanks[0])
                break
            end = min(len(data), end + SPAN)
        inner = bounds[np.searchsorted(bounds, at) : np.searchsorted(bounds, end)]
        found, words = _hash_span(data[at:end], inner - at, _BYTE if fold else _CASED)
        starts.append(found + at)
        hashes.append(words)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its set of five-word shingles, sorted; of a shorter text the whole sequence is the one shingle."""
    words, bounds = word_hashes(texts)
    rows = max(0, len(words) - SHINGLE + 1)
    joined = np.zeros(rows, np.uint64)
    for place in range(SHINGLE):
        joined += words[place : place + rows] * _PLACE[place]
    joined = mix(joined)
    sets = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= SHINGLE:
            own = np.sort(joined[lo : hi - SHINGLE + 1])
            sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif hi > lo:
            whole = np.uint64(hi - lo)
            for word in words[lo:hi]:
                whole = mix(np.array([whole ^ word]))[0]
            sets.append(np.array([whole], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets
