"""Secrets in whole texts: fixed patterns, and strings that zstandard cannot compress where secrets are named.

A candidate of the second kind is a long string close after a word such as "key". Its cost is the number of bytes by
which the compressed text grows with it, once the compressor has seen a dictionary of identifiers and the text
around. Prose, code and repeated names cost little. What a random string costs depends on its alphabet and on what
stands around, so the cost is held against that of decoys: random strings of the same alphabet and length in its place.
"""

from __future__ import annotations

import builtins
import hashlib
import keyword
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pydoc_data.topics import topics

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the patterns of the base kinds, with their least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: Texts without a match of the first hold no base span, those without one of the second no candidate.
BASE_SIEVE = (
    r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[a-z0-9+/_.=-]{6})|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""
)
# without bounds, as most stand in identifiers: aws_secret_access_key, privateKey, auth-header, secretkey
_CONTEXT = r"(?:key|secret|token|password|passwd|pwd|auth|bearer|credential|private|access|signature)"
#: Characters of the manual in the compressor's dictionary, and before each text that it measures.
DICTIONARY = 15_000
LEAD, LEADS = 1000, 4
#: Decoys of a candidate, as long as it is, each measured after each lead.
DECOYS = 2
NOVEL_SIEVE = f"(?i){_CONTEXT}"
LEAST_NOVEL = 16
#: A value may follow "=" at once, or stand on the line after one that ends by opening a value: "private_key:", "secret: {".
CANDIDATE = re.compile(
    rf"(?i:{_CONTEXT})(?P<between>[^\n]{{0,40}}?(?:[:=|>({{[][^\S\n]*\n[^\n]{{0,40}}?)?)(?<![A-Za-z0-9+/_-])(?P<value>[A-Za-z0-9+/_=-]{{{LEAST_NOVEL},}})", re.ASCII
)


@dataclass(frozen=True)
class Novelty:
    """What makes a candidate novel, and the text around it, in characters, that it is measured against.

    ``cost``: bytes per character that suffice whatever decoys cost. ``share``: of the cost of decoys; ``share_plain``
    for letters or digits alone, which words and dates are made of too.
    """

    cost: float = 0.85
    share: float = 0.8
    share_plain: float = 0.9
    around: int = 2048
    level: int = 19


def _identifiers() -> bytes:
    """Names of the language and words of its manual, which most identifiers are made of."""
    names = [*keyword.kwlist, *dir(builtins), *dir(str), *dir(dict), *dir(list), *dir(re)]
    return (" ".join(names) + " ".join(topics.values())[:DICTIONARY]).encode()


def _alphabet(value: str) -> str:
    """The characters that a random string like ``value`` is drawn from."""
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if set(value) <= set(digits):
            return string.digits if value.isdigit() else digits
    groups = (string.ascii_lowercase, string.ascii_uppercase, string.digits, *"+/_=-")
    return "".join(g for g in groups if any(c in g for c in value))


def _decoys(alphabet: str, length: int, count: int) -> list[bytes]:
    draw = random.Random(f"{alphabet} {length}")
    return ["".join(draw.choices(alphabet, k=length)).encode() for _ in range(count)]


class Meter:
    def __init__(self, rule: Novelty):
        words = zstandard.ZstdCompressionDict(_identifiers(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # some text ahead, as the compressor stores a short block as it is; several, as one cost is uneven by some bytes
        manual = " ".join(topics.values())[DICTIONARY : DICTIONARY + LEADS * LEAD]
        self.leads = [manual[i : i + LEAD].encode() + b"\n" for i in range(0, len(manual), LEAD)]
        self.rule, self.compressor = rule, zstandard.ZstdCompressor(level=rule.level, dict_data=words)

    def costs(self, text: str, start: int, end: int) -> tuple[float, float]:
        """Bytes per character by which the candidate, and decoys of it, lengthen its compressed surroundings."""
        r = self.rule
        near = (text[max(0, start - r.around) : start] + "\n" + text[end : end + r.around]).encode()
        value = text[start:end]
        decoys = _decoys(_alphabet(value), len(value), DECOYS)
        own = other = 0
        for lead in self.leads:
            around = lead + near
            alone = self._size(around)
            own += self._size(around + b"\n" + value.encode()) - alone
            other += sum(self._size(around + b"\n" + d) - alone for d in decoys)
        return own / len(self.leads) / len(value), other / len(self.leads) / len(decoys) / len(value)

    def _size(self, raw: bytes) -> int:
        return len(self.compressor.compress(raw))

    def novel(self, text: str, start: int, end: int) -> bool:
        own, decoys = self.costs(text, start, end)
        value = text[start:end]
        mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
        return own >= min(self.rule.cost, (self.rule.share if mixed else self.rule.share_plain) * decoys)


#: A worker builds its compressor once, not for each batch.
_meter = lru_cache(maxsize=2)(Meter)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return _ordered(found)


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Long parts between "=", as ``name=value`` may be known by its name, and then the candidate itself."""
    parts = [(start + m.start(), start + m.end()) for m in re.finditer("[^=]+", text[start:end])]
    if len(parts) > 1:
        yield from ((a, b) for a, b in parts if b - a >= LEAST_NOVEL)
    yield start, end


def novel_spans(text: str, base: list[tuple[str, int, int]], meter: Meter) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while m := CANDIDATE.search(text, at):
        start, end = m.span("value")
        at = start  # the value may name the context of the next
        for a, b in _parts(text, start, end):
            if a >= at and not any(x < b and a < y for _, x, y in base) and meter.novel(text, a, b):
                out.append(("novel", a, b))
                at = b
        if at == start:
            at = max(start, m.start() + 1)
    return out


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _found(texts: pa.Array, rule: Novelty) -> Iterator[tuple[list, list]]:
    """For each text its base and its added spans. Only texts that pass a sieve are looked at one by one."""
    meter = _meter(rule)
    likely = pc.fill_null(pc.match_substring_regex(texts, BASE_SIEVE), False).to_pylist()
    named = pc.fill_null(pc.match_substring_regex(texts, NOVEL_SIEVE), False).to_pylist()
    for i, (a, b) in enumerate(zip(likely, named)):
        if a or b:
            text = texts[i].as_py()
            base = base_spans(text) if a else []
            yield base, novel_spans(text, base, meter) if b else []
        else:
            yield [], []


def scan(docs: DataFrame, rule: Novelty = Novelty()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel.

    Spans are ``kind:start:end`` in characters of the whole text, end exclusive, by start and then kind; the
    digest is of the base spans alone. Null and empty texts have none. Repeated rows give repeated results; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, novel in _found(batch.column(1), rule):
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:3]]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((*counts, digest, _written(_ordered(base + novel)), len(novel)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    )


def redact(docs: DataFrame, rule: Novelty = Novelty(), mark: str = "<secret>") -> DataFrame:
    """``docs`` with all spans of ``text`` replaced by ``mark``; rows and other columns stay as they are.

    Where there is a column ``n_chars`` it is counted again in texts that change.
    """
    at = docs.columns.index("text")
    counted = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            changed = {
                i: redacted(columns[at][i].as_py(), base + novel, mark)
                for i, (base, novel) in enumerate(_found(columns[at], rule)) if base or novel
            }
            if changed:
                mask = pa.array([i in changed for i in range(batch.num_rows)])
                columns[at] = pc.replace_with_mask(columns[at], mask, pa.array(list(changed.values()), columns[at].type))
                if counted is not None:
                    sizes = pa.array([len(t) for t in changed.values()]).cast(columns[counted].type)
                    columns[counted] = pc.replace_with_mask(columns[counted], mask, sizes)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
