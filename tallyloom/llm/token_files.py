"""Token ids of all documents in files of Re-Pair grammars, in ascending doc_id order.

A file row is a block of about a million ids of consecutive documents. Pairs of symbols that are
frequent in the block become nonterminals, round by round until no pair is frequent; stored are the
rules, how many ids each nonterminal expands to, and the remaining symbols with the place of every
256th, so that any span of ids is decoded without the rest of the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.units import Pieces, tokenizer_of
from tallyloom.llm.words import slices
from tallyloom.session import scratch_path

#: Ids of a block, unless one document has more.
BLOCK = 1 << 20
#: Rules made in a round, or so, and uses that a pair needs for one.
RULES, LEAST = 2048, 8
#: Pairs are first counted in so many slots, and then truly in those that are full enough.
SLOTS = 1 << 19
#: So few places are counted truly at once.
FEW = 1 << 17
#: So few symbols are cut out of the others, more are masked.
CUTS = 512
ANCHOR = 256
#: Nonterminals of more ids are opened step by step when all ids are read.
LONG_RULE = 256
TOGETHER = 1 << 23

SCHEMA = (
    "shard int, block int, first_rule long, doc_ids array<long>, counts array<long>, n_ids long, "
    "rules binary, lengths binary, symbols binary, anchors binary"
)


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) & np.uint32(SLOTS - 1)).astype(np.intp)


def _numbers(pairs: np.ndarray, slot: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Where each of ``pairs`` is in ``kept``, or any number if it is not there."""
    own = _slots((kept >> 32).astype(np.uint32), kept.astype(np.uint32))
    table = np.zeros(SLOTS, np.int32)
    table[own] = np.arange(len(kept), dtype=np.int32)
    number = table[slot]
    # pairs that share a slot are searched for
    crowded = table[own] != np.arange(len(kept))
    if crowded.any():
        several = np.zeros(SLOTS, bool)
        several[own[crowded]] = True
        at = np.flatnonzero(several[slot])
        number[at] = np.minimum(np.searchsorted(kept, pairs[at]), len(kept) - 1)
    return number


def _frequent(places: np.ndarray, seq: np.ndarray, least: int, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``places`` those whose pair occurs ``least`` times there, the number of each, the pairs and their counts."""
    left, right = seq[places], seq[places + 1]
    pairs = (left.astype(np.int64) << 32) | right
    ordered = np.sort(pairs)
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    counts = np.diff(first, append=len(ordered))
    kept, counts = ordered[first[counts >= least]], counts[counts >= least]
    if not len(kept):
        return places[:0], places[:0], kept, counts
    if len(pairs) < SLOTS >> 4:
        number = np.minimum(np.searchsorted(kept, pairs), len(kept) - 1)
    else:
        number = _numbers(pairs, _slots(left, right) if slot is None else slot, kept)
    same = np.flatnonzero(kept[number] == pairs)
    return places[same], number[same], kept, counts


def _apart(places: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of overlapping places every other one, from the left."""
    # those that overlap the one before; of a run of them the first, third and so on go
    after = np.flatnonzero(np.diff(places) == 1) + 1
    if not len(after):
        return places, number
    run = np.flatnonzero(np.diff(after, prepend=-2) != 1)
    along = np.arange(len(after)) - np.repeat(run, np.diff(np.append(run, len(after))))
    stays = np.ones(len(places), bool)
    stays[after[along % 2 == 0]] = False
    return places[stays], number[stays]


def _without_common_symbols(number: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Which pairs to take where others overlap them: the most frequent first, no symbol in two pairs."""
    taken, chosen = set(), np.zeros(len(kept), bool)
    for i in np.argsort(-np.bincount(number, minlength=len(kept)), kind="stable").tolist():
        own = {int(kept[i]) >> 32, int(kept[i]) & 0xFFFFFFFF}
        if taken.isdisjoint(own):
            taken |= own
            chosen[i] = True
    return chosen


def _uses(places: np.ndarray, number: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that do not overlap, of pairs with LEAST of them: none only if no pair of ``kept`` has so many by itself."""
    at, which = _apart(places, number)
    used = np.bincount(which, minlength=len(kept)) >= LEAST
    if len(kept) and not used.any():
        # each pair by itself: runs of one symbol do not count twice
        twins = (kept >> 32) == (kept & 0xFFFFFFFF)
        single = twins[number]
        alone = np.bincount(_apart(places[single], number[single])[1], minlength=len(kept))
        able = ~twins | (alone >= LEAST)
        places, number = places[able[number]], number[able[number]]
        able &= _without_common_symbols(number, kept)
        at, which = _apart(places[able[number]], number[able[number]])
        used = np.bincount(which, minlength=len(kept)) >= LEAST
    stays = used[which]
    return at[stays], (np.cumsum(used) - 1)[which[stays]], kept[used]


def _round(seq: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places to replace, the number of the rule of each, and the pairs of the rules: none when no pair is frequent.

    ``live`` has the places of all pairs that may be frequent, and loses those that are not.
    """
    at = np.flatnonzero(live)
    if len(at) > FEW:
        slot = _slots(seq[at], seq[at + 1])
        counts = np.bincount(slot, minlength=SLOTS)
        level = counts.astype(np.int32)[slot]
        full = level >= LEAST
        live[at[~full]] = False
        # how full the fullest slots are, the RULES-th of them
        floor = int(np.searchsorted(np.cumsum(np.bincount(counts)), SLOTS - RULES, side="right"))
        if floor > LEAST:
            top = np.flatnonzero(level >= floor)
            found = _uses(*_frequent(at[top], seq, floor, slot[top])[:3])
            if len(found[2]):
                return found
        at = at[full]  # else full slots held rare pairs alone
    places, number, kept, counts = _frequent(at, seq, LEAST)
    live[at] = False
    live[places] = True
    if len(kept) > RULES:
        top = counts >= np.partition(counts, len(kept) - RULES)[len(kept) - RULES]
        stays = top[number]
        found = _uses(places[stays], (np.cumsum(top) - 1)[number[stays]], kept[top])
        if len(found[2]):
            return found
    return _uses(places, number, kept)


def _without(gone: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays without what is at the ascending places ``gone``."""
    if len(gone) < CUTS:
        bounds = list(zip([0, *(gone + 1).tolist()], [*gone.tolist(), len(arrays[0])]))
        return [np.concatenate([values[a:b] for a, b in bounds]) for values in arrays]
    stay = np.ones(len(arrays[0]), bool)
    stay[gone] = False
    return [values[stay] for values in arrays]


def repair(ids: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rule i replaces the pair ``rules[i]`` by ``first_rule + i``. In the end no pair has LEAST uses."""
    seq, rules, made = ids.astype(np.uint32), [], first_rule
    live = np.ones(len(seq), bool)
    while len(seq) > LEAST:
        live[-1] = False
        places, number, kept = _round(seq, live)
        if not len(kept):
            break
        rules.append(np.stack((kept >> 32, kept & 0xFFFFFFFF), axis=1))
        seq[places] = made + number
        made += len(kept)
        # only pairs with a new symbol can become frequent
        live[places] = live[np.maximum(places - 1, 0)] = True
        seq, live = _without(places + 1, seq, live)
    return seq.astype(np.int64), np.concatenate(rules) if rules else np.empty((0, 2), np.int64)


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each nonterminal stands for; rules only use earlier ones."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first_rule] if a >= first_rule else 1) + (out[b - first_rule] if b >= first_rule else 1))
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, first_rule: int) -> np.ndarray:
    """All ids that ``symbols`` stand for."""
    seq = symbols.astype(np.int64)
    # long rules are opened from above, as all their expansions could be much more than the ids
    sizes = rule_lengths(rules, first_rule)
    large = np.flatnonzero(sizes > LONG_RULE)
    while len(large) and (big := np.isin(seq, large + first_rule)).any():
        out = np.repeat(seq, 1 + big)
        at = np.flatnonzero(big) + np.arange(int(big.sum()))
        out[at], out[at + 1] = rules[seq[big] - first_rule].T
        seq = out
    # rules that only use ids or short rules
    short = np.flatnonzero(sizes <= LONG_RULE)
    if not len(short):
        return seq
    whole: dict[int, list[int]] = {}
    for i, (a, b) in zip((short + first_rule).tolist(), rules[short].tolist()):
        whole[i] = (whole[a] if a >= first_rule else [a]) + (whole[b] if b >= first_rule else [b])
    # the ids of each symbol as bytes: an id stands for itself, a long rule is not used any more
    lengths = np.ones(first_rule + len(rules), np.int64)
    lengths[first_rule:] = np.where(sizes <= LONG_RULE, sizes, 0)
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * 4, out=ends[1:])
    flat = np.arange(ends[-1] // 4, dtype=np.uint32)
    flat[first_rule:] = np.fromiter(chain.from_iterable(whole.values()), np.uint32, len(flat) - first_rule)
    opened = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    opened = opened.take(pa.array(seq))
    return np.frombuffer(opened.buffers()[2], np.uint32, int(lengths[seq].sum())).astype(np.int64)


def _pack(values: np.ndarray) -> bytes:
    """Little-endian unsigned numbers of 2 or 4 bytes, told by a leading byte."""
    wide = len(values) and values.max() > 0xFFFF
    return (b"\x04" + values.astype("<u4").tobytes()) if wide else (b"\x02" + values.astype("<u2").tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if raw[0] == 4 else "<u2", offset=1).astype(np.int64)


def span(block, start: int, count: int) -> np.ndarray:
    """``count`` ids of a file row from place ``start`` of it, expanding only the symbols that hold them."""
    symbols, lengths, anchors = _unpack(block["symbols"]), _unpack(block["lengths"]), _unpack(block["anchors"])
    rules, first = _unpack(block["rules"]).reshape(-1, 2), block["first_rule"]
    near = max(0, int(np.searchsorted(anchors, start, side="right")) - 1)
    at, place, out = near * ANCHOR, int(anchors[near]) if len(anchors) else 0, []
    while at < len(symbols) and place < start + count:
        todo = [int(symbols[at])]
        if todo[0] >= first and place + lengths[todo[0] - first] <= start:
            place, todo = place + int(lengths[todo[0] - first]), []
        while todo:
            s = todo.pop()
            if s >= first:
                todo += [int(rules[s - first][1]), int(rules[s - first][0])]
                continue
            if start <= place < start + count:
                out.append(s)
            place += 1
        at += 1
    return np.array(out, np.int64)


def _row(shard: int, block: int, first_rule: int, docs: list, ids: list[np.ndarray]) -> dict:
    flat = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
    symbols, rules = repair(flat, first_rule)
    lengths = rule_lengths(rules, first_rule)
    own = np.ones(len(symbols), np.int64)
    big = symbols >= first_rule
    own[big] = lengths[symbols[big] - first_rule]
    return {
        "shard": shard, "block": block, "first_rule": first_rule, "doc_ids": docs, "counts": [len(i) for i in ids],
        "n_ids": len(flat), "rules": _pack(rules.ravel()), "lengths": _pack(lengths), "symbols": _pack(symbols),
        "anchors": _pack((np.cumsum(own) - own)[::ANCHOR]),
    }


def _arrow(row: dict) -> pa.RecordBatch:
    kinds = {"shard": pa.int32(), "block": pa.int32(), "first_rule": pa.int64(), "doc_ids": pa.list_(pa.int64()),
             "counts": pa.list_(pa.int64()), "n_ids": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], list(row))


@lru_cache(maxsize=2)
def _pieces(text: str) -> Pieces:
    """One for each worker, which keeps what it has seen from task to task."""
    return Pieces(tokenizer_of(text), keep_space=False, lower=True)


def write_ids(docs: DataFrame, path: str, tokenizer_file: str, end_id: int | None = 2) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write blocks of ids below ``path``.

    Documents are dealt by ranges of (doc_id, text), null ids last, so that many rows of one id are
    spread too; each task writes the blocks of its range in order. Other columns are ignored. Of an
    empty table nothing is written but the schema.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shared.value)
        first_rule = pieces.tokenizer.get_vocab_size(with_added_tokens=True)
        shard, block, names, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for piece in slices(batch, 1, TOGETHER):
                flat, counts = pieces.encode_column(piece.column(1))
                if end_id is not None:
                    flat, counts = np.insert(flat, np.cumsum(counts), end_id), counts + 1
                ends = np.cumsum(counts)
                for key, lo, hi in zip(piece.column(0).to_pylist(), (ends - counts).tolist(), ends.tolist()):
                    if held and held + hi - lo > BLOCK:
                        yield _arrow(_row(shard, block, first_rule, names, ids))
                        block, names, ids, held = block + 1, [], [], 0
                    names.append(key)
                    ids.append(flat[lo:hi])
                    held += hi - lo
        if names:
            yield _arrow(_row(shard, block, first_rule, names, ids))
        pa.default_memory_pool().release_unused()  # Spark keeps the worker for later tasks

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SCHEMA).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, block, place, ids) of all documents in files that ``write_ids`` has written."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                ids = expand(_unpack(block["symbols"]), _unpack(block["rules"]).reshape(-1, 2), block["first_rule"])
                n = len(block["counts"])
                cut = np.concatenate(([0], np.cumsum(block["counts"]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], pa.int64()), pa.array([block["shard"]] * n, pa.int32()),
                        pa.array([block["block"]] * n, pa.int32()), pa.array(range(n), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))),
                    ],
                    ["doc_id", "shard", "block", "place", "ids"],
                )

    return read_blocks(spark, path).mapInArrow(run, "doc_id long, shard int, block int, place int, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                ids = expand(_unpack(block["symbols"]), _unpack(block["rules"]).reshape(-1, 2), block["first_rule"])
                ids = ids.astype("<u4")
                ends = np.cumsum(block["counts"])
                begins = ends - np.array(block["counts"], np.int64)
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                n = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], pa.int64()), pa.array([block["shard"]] * n, pa.int32()),
                        pa.array([block["block"]] * n, pa.int32()), pa.array(begins, pa.int64()),
                        pa.array(block["counts"], pa.int64()), pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "shard", "block", "begin", "n_tokens", "ids_crc32"],
                )

    blocks = read_blocks(spark, path)
    sizes = blocks.select("shard", "block", "n_ids")
    within = F.sum("n_ids").over(W.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    # one row for each task that wrote, however many documents there are
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    offsets = sizes.withColumn("within", within).join(before, "shard").select(
        "shard", "block", (F.col("before") + F.col("within")).alias("offset")
    )
    found = blocks.mapInArrow(run, "doc_id long, shard int, block int, begin long, n_tokens long, ids_crc32 long")
    return found.join(offsets, ["shard", "block"]).select(
        "doc_id", (F.col("offset") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int | None = 2) -> DataFrame:
    """Write the files below the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, path, tokenizer_file, end_id)
    return read_digests(docs.sparkSession, path)
