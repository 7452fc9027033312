"""Byte-level BPE over Arrow batches: ids, character offsets of tokens, and decoding to bytes and text."""

from __future__ import annotations

import base64
import codecs
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.units import Pieces, byte_characters, runs, tokenizer_of

#: Characters encoded together.
TOGETHER = 1 << 22


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two tokens whose merge makes ``token``: merges of lower rank leave just these."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def tokenizer_json(rank_file: str) -> str:
    """A tokenizer of the tokenizers library for a file of ``base64-token rank`` lines, without special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    names = byte_characters()
    name = {token: "".join(names[b] for b in token) for token in ranks}
    merges = [
        [name[half] for half in _halves(token, ranks)]
        for token, _ in sorted(ranks.items(), key=lambda item: item[1])
        if len(token) > 1
    ]
    model = {"type": "BPE", "vocab": {name[t]: r for t, r in ranks.items()}, "merges": merges}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": True}
    return json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": level, "model": model})


class Codec:
    """Encodes texts to ids, finds the characters that tokens begin at, and decodes ids."""

    def __init__(self, text: str):
        tokenizer = tokenizer_of(text)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = tokenizer.get_vocab()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(byte_of[c] for c in token)
        self.lengths = np.array([len(t) for t in self.tokens])
        self.pieces = Pieces(tokenizer, keep_space=True)
        self.kind = np.uint16 if self.pieces.code == "H" else np.uint32

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, self.kind) for ids in self.pieces.encode(texts)]

    def starts(self, raw: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the character that its first byte belongs to, and whether it begins inside it."""
        lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        ends = np.cumsum(self.lengths[ids])
        begins = ends - self.lengths[ids]
        return np.cumsum(lead)[begins] - 1, ~lead[begins]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def characters(self, ids: np.ndarray) -> Iterator[str]:
        """The text token by token; a character split over tokens comes with its last byte."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids.tolist():
            yield reader.decode(self.tokens[i])
        yield reader.decode(b"", True)


@lru_cache(maxsize=2)
def _codec(text: str) -> Codec:
    """One codec for each worker, which keeps what it has seen from task to task."""
    return Codec(text)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for lo, hi in runs([len(t) for t in texts], TOGETHER):
            yield batch.column(0).slice(lo, hi - lo), texts[lo:hi]


def encode(docs: DataFrame, rank_file: str) -> DataFrame:
    """Per row: doc_id, ids, and for each id the character ``start`` and whether it begins inside it.

    Null texts count as empty and have no ids. Rows stay as they are, repeats too; other columns are
    ignored. ``rank_file`` is read by the driver; its vocabulary goes to the executors as a broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(rank_file))

    def run(batches):
        codec = _codec(shared.value)
        for ids_of, texts in _batches(batches):
            found = codec.encode(texts)
            places = [codec.starts(t.encode(), ids) for t, ids in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids_of, pa.array([i.astype(np.int32) for i in found], pa.list_(pa.int32())),
                    pa.array([p[0] for p in places], pa.list_(pa.int64())), pa.array([p[1] for p in places], pa.list_(pa.bool_())),
                ],
                ["doc_id", "ids", "starts", "inside"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, ids array<int>, starts array<long>, inside array<boolean>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, the decoded bytes ``raw`` and ``text``; null ids count as none.

    Bytes that are no UTF-8 (ids cut inside a character) become U+FFFD in ``text`` only.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(tokenizer_json(rank_file))

    def run(batches):
        codec = _codec(shared.value)
        for batch in batches:
            raw = [codec.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())],
                ["doc_id", "raw", "text"],
            )

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, raw binary, text string")


def digests(docs: DataFrame, rank_file: str) -> DataFrame:
    """Encoding and decoding in one pass, without moving ids out of the worker.

    Per row: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by spaces), decoded_sha256, n_split
    (tokens that begin inside a character). Empty and null texts have 0 tokens and digests of nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(rank_file))

    def run(batches):
        codec = _codec(shared.value)
        decimal = [str(i) for i in range(len(codec.tokens))]
        for ids_of, texts in _batches(batches):
            counts, ids_sums, raw_sums, split = [], [], [], []
            for ids in codec.encode(texts):
                raw = codec.decode(ids)
                counts.append(len(ids))
                ids_sums.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                raw_sums.append(hashlib.sha256(raw).hexdigest())
                split.append(int(codec.starts(raw, ids)[1].sum()) if len(ids) else 0)
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(raw_sums, pa.string()), pa.array(split, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long")
