"""Encoding of whole texts by a tokenizers.Tokenizer, each distinct word once while it is remembered.

Texts are cut before single U+0020 characters. Neither tokenizer used here has a token or a rule that spans such
a place, so the ids of a text are those of its pieces, and most pieces recur.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces remembered in each of two generations, and their longest length: about 200 MB in all.
REMEMBERED = 500_000
LONGEST = 64
#: A word of plain or accented letters and the signs after it, which no rule of either tokenizer joins.
WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*]*)")
SIGNS = r"([a-zÀ-ÖØ-öø-ÿ])([.,;:!?|#$%&*]+)( |$)"


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def tokenizer_of(text: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    return Tokenizer.from_str(text)


class Pieces:
    """ids of texts as the bytes of an array of ``code`` ('H' or 'I').

    ``keep_space``: a piece goes with the space before it. ``lower``: the tokenizer lower-cases, so that words
    that differ in case alone are one.
    """

    def __init__(self, tokenizer: Tokenizer, keep_space: bool, lower: bool = False, remembered: int = REMEMBERED):
        self.tokenizer, self.space, self.lower, self.remembered = tokenizer, " " if keep_space else "", lower, remembered
        self.code = "H" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.model, self.named = tokenizer.model, dict(enumerate(byte_characters()))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _word_ids(self, words: set[str]) -> list[bytes]:
        """ids of words of ``WORD``, which normalising and cutting would leave as they are: merged at once."""
        merge, code, named = self.model.tokenize, self.code, self.named
        out = []
        for word in words:
            raw = self.space + word
            if self.space or not raw.isascii():  # plain letters stand for themselves
                raw = raw.encode().decode("latin-1").translate(named)
            out.append(array(code, [t.id for t in merge(raw)]).tobytes())
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _learn(self, pieces: set[str]) -> list[str]:
        """Take what ``young`` lacks from ``old``, put it together from word and signs, or encode it.

        Returns the pieces that are too long to be remembered.
        """
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, {}
        young, old, plain, words, joined = self.young, self.old, [], set(), []
        for piece in pieces.difference(young):
            if (ids := old.get(piece)) is not None:
                young[piece] = ids
                continue
            if match := WORD.fullmatch(piece):
                word = match[1].lower() if self.lower else match[1]
                if word != piece:
                    joined.append((piece, word, match[2]))
                    piece = word
                    if piece in young:
                        continue
                    if (ids := old.get(piece)) is not None:
                        young[piece] = ids
                        continue
                words.add(piece)
            else:
                plain.append(piece)
        young.update(zip(plain, self._ids([self.space + p for p in plain])))
        young.update(zip(words, self._word_ids(words)))
        signs = {tail for _, _, tail in joined}
        signs = dict(zip(signs, self._ids(list(signs))))
        for piece, word, tail in joined:
            young[piece] = young[word] + signs[tail]
        return [p for group in (plain, words, (p for p, _, _ in joined)) for p in group if len(p) > LONGEST]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [text.split(" ") for text in texts]
        heads = [b""] * len(cut)
        if self.space:
            for i, text in enumerate(texts):
                if "  " in text:  # runs of spaces are one token: such texts stay whole
                    cut[i] = [text]
            heads = self._ids([parts[0] for parts in cut])  # nothing stands before the first piece
            cut = [parts[1:] for parts in cut]
        long = self._learn(set().union(*cut))
        known = self.young.__getitem__
        out = [head + b"".join(map(known, parts)) for head, parts in zip(heads, cut)]
        for piece in long:
            self.young.pop(piece, None)
        return out


    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts of a column in one array, and how many each text has; for tokenizers that drop white space and case.

        Each different piece of the column is looked up once, and its ids are gathered to every place where it stands. A line
        end parts words as a space does, signs after letters are pieces of their own, and A-Z count as a-z: there are far
        fewer pieces then, and their ids are the same.
        """
        plain = pc.ascii_lower(pc.replace_substring(texts, "\n", " "))
        plain = pc.replace_substring_regex(plain, SIGNS, r"\1 \2\3")
        parts = pc.split_pattern(plain, " ")
        coded, offsets = parts.flatten().dictionary_encode(), parts.offsets.to_numpy()
        del plain, parts  # large beside what is left of them
        different, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices
        del coded
        raw = list(map(self.young.get, different))
        new = [i for i, ids in enumerate(raw) if ids is None]
        long = self._learn({different[i] for i in new})
        for i in new:
            raw[i] = self.young[different[i]]
        for piece in long:
            self.young.pop(piece, None)
        ids = pa.array(raw, pa.large_binary()).take(places)
        code = np.dtype(np.uint16 if self.code == "H" else np.uint32)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // code.itemsize
        flat = np.frombuffer(ids.buffers()[2] or b"", code, ends[-1])
        return flat, np.diff(ends[offsets - offsets[0]])


def runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of items of ``most`` in all, or one larger item."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out
