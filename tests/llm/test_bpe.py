import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from tallyloom.llm import bpe
from tallyloom.llm.units import Pieces, tokenizer_of
from tests.llm.conftest import documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    "", " ", "  ", "a  b", "a   b", " lead", "trail ", "trail  ", "tab\there", "a \n b", "a\n b", "a \n\nb", "x  \ny", "don't we'll I'M",
    "naïve Öl ½ ٣ ✓ 😀🇩🇪", "<|endoftext|>", "\x1c\x85  z", "a\x1c b\x1cc  \x1c", "123 4567\r\n\r\n89", "́ á", "word " * 2000, "ab" * 5000,
]


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.tokenizer_json(RANKS))


def test_ids_are_those_of_the_rank_library(tik, codec):
    assert [i.tolist() for i in codec.encode(TEXTS)] == [tik.encode_ordinary(t) for t in TEXTS]


def test_small_memory_gives_the_same_ids(tik):
    pieces = Pieces(tokenizer_of(bpe.tokenizer_json(RANKS)), keep_space=True, remembered=3)
    for _ in range(2):
        got = pieces.encode(TEXTS)
        assert [memoryview(g).cast(pieces.code).tolist() for g in got] == [tik.encode_ordinary(t) for t in TEXTS]


def test_decoding_and_split_characters(codec):
    for text, ids in zip(TEXTS, codec.encode(TEXTS)):
        assert codec.decode(ids) == text.encode()
        assert "".join(codec.characters(ids)) == text
    ids = codec.encode(["😀x"])[0]
    starts, inside = codec.starts("😀x".encode(), ids)
    assert inside.sum() >= 1 and starts[-1] == 1 and not starts[:-1].any()
    assert "".join(codec.characters(ids[:1])) == "�"


def test_columns(spark, tik):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(TEXTS)], ("ids", "starts"))
    encoded = bpe.encode(docs, RANKS)
    rows = {r["doc_id"]: r for r in encoded.collect()}
    assert rows[14]["ids"] == tik.encode_ordinary(TEXTS[14])
    for r in rows.values():
        text = TEXTS[r["doc_id"]]
        assert len(r["starts"]) == len(r["ids"]) and all(0 <= s < len(text) for s in r["starts"])
    decoded = {r["doc_id"]: r for r in bpe.decode(encoded, RANKS).collect()}
    assert all(decoded[i]["text"] == t and decoded[i]["raw"] == t.encode() for i, t in enumerate(TEXTS))


def test_digests(spark, odd, tik):
    rows = bpe.digests(odd, RANKS).collect()
    assert len(rows) == odd.count()
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in odd.select("doc_id", "text").collect())
    expected = []
    for i, text in texts:
        ids = tik.encode_ordinary(text)
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), *r[1:4]) for r in rows) == sorted(expected)
    assert bpe.digests(odd.limit(0), RANKS).collect() == []
