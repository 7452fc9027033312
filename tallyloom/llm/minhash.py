"""Near-duplicate documents by MinHash with tensored banding, every link verified on full shingle sets.

Two collections of ``m`` sketches, each of ``r`` minhashes, give ``m * m`` table keys by pairing a
sketch of one with a sketch of the other, so that ``2 * m * r`` minhashes do the work of ``2 * m * m * r``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.words import mix, shingle_sets, slices
from tallyloom.session import stored

#: Rows of one text's pairs that are verified together; larger groups are split.
TOGETHER = 64
#: Members of a part of a bucket; a block compares two parts.
PART = 200
SALTS = 16
#: Hashes of ids at most that are broadcast to thin out texts before a join.
SIEVE = 1 << 20


@dataclass(frozen=True)
class Banding:
    """A pair of similarity s shares a key with chance (1 - (1 - s^r)^m)^2: 0.997 at 0.85, 0.9997 at 0.9."""

    sketches: int = 7
    minhashes: int = 3
    percent: int = 85
    seed: int = 11


def _sketcher(b: Banding):
    random = np.random.default_rng(b.seed)
    shape = (2, b.sketches, b.minhashes)
    turn = random.integers(1, 1 << 63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = random.integers(1, 1 << 63, shape, dtype=np.uint64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingle_sets(part.column(1))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                sums = np.zeros((2, len(sets)), np.int64)
                sides = np.zeros((2, len(sets), b.sketches), np.uint64)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    begins = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
                    for k in range(2):
                        sums[k, full] = np.add.reduceat(mix(flat ^ np.uint64(0xA5A5 + k)), begins).view(np.int64)
                        for j in range(b.sketches):
                            key = np.full(len(full), j + 1, np.uint64)
                            for i in range(b.minhashes):
                                least = np.minimum.reduceat((flat ^ flip[k, j, i]) * turn[k, j, i], begins)
                                key = mix(key + least)
                            sides[k, full, j] = key
                lists = [
                    pa.FixedSizeListArray.from_arrays(pa.array(s.view(np.int64).ravel()), b.sketches).cast(pa.list_(pa.int64()))
                    for s in sides
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), *lists],
                    ["doc_id", "n_shingles", "sum_a", "sum_b", "left", "right"],
                )

    return sketch


def sketches(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """Per row of ``docs``: set size, two sums that tell its set, and both collections of sketches."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _sketcher(banding),
        "doc_id long, n_shingles long, sum_a long, sum_b long, left array<long>, right array<long>",
    )


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents that ``ids`` (id, possibly with others) names.

    Documents are first thinned by a set of at most ``SIEVE`` hashes, which is small enough to broadcast at any scale;
    ids grow with the corpus, so the join itself is by shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    slot = F.pmod(F.xxhash64("id"), F.lit(SIEVE))
    sieve = ids.select(slot.alias("slot")).distinct()
    thinned = texts.withColumn("slot", slot).join(F.broadcast(sieve), "slot", "left_semi").drop("slot")
    return thinned.hint("merge").join(ids.select("id").distinct(), "id", "left_semi")


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, part, b), the text of a first with b null: size of the intersection and of both sets."""
    current, own = None, []
    for batch in batches:
        for rows in slices(batch, 3):
            out = {"a": [], "b": [], "shared": [], "size_a": [], "size_b": []}
            sets = shingle_sets(rows.column(3))
            for a, part, b, s in zip(*(rows.column(i).to_pylist() for i in range(3)), sets):
                if (a, part) != current:
                    current, own = (a, part), []
                if b is None:
                    own.append(s)
                    continue
                for t in own:  # rows that share an id have several texts
                    small, big = (s, t) if len(s) <= len(t) else (t, s)
                    at = np.searchsorted(big, small)
                    at[at == len(big)] = 0
                    shared = int(np.count_nonzero(big[at] == small)) if len(big) else 0
                    for name, value in zip(out, (a, b, shared, len(t), len(s))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def overlaps(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of document ids: ``shared``, ``size_a``, ``size_b`` of their full shingle sets.

    The text of ``a`` goes once with each ``TOGETHER`` partners, so a hot ``a`` is spread over many tasks.
    """
    counted = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = stored(
        pairs.join(counted, "a").select(
            "a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / TOGETHER)).cast("long").alias("part")
        ),
        "minhash-pairs",
    )
    wanted = dealt.select("a", "part").distinct().select(F.col("a").alias("id"), "a", "part", F.lit(None).cast("long").alias("b"))
    wanted = wanted.unionByName(dealt.select(F.col("b").alias("id"), "a", "part", "b"))
    rows = _texts_of(docs, wanted).hint("merge").join(wanted, "id").select("a", "part", "b", "text")
    return (
        rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        .mapInArrow(_overlaps, "a long, b long, shared long, size_a long, size_b long")
    )


def _linked(percent: int) -> Column:
    return 100 * F.col("shared") >= percent * (F.col("size_a") + F.col("size_b") - F.col("shared"))


def _keys(reps: DataFrame) -> DataFrame:
    """(key, id, weight) for every pairing of a left with a right sketch."""
    return reps.select("id", "weight", F.posexplode("left").alias("i", "x"), "right").select(
        "id", "weight", "i", "x", F.posexplode("right").alias("j", "y")
    ).select(F.xxhash64("i", "j", "x", "y").alias("key"), "id", "weight")


def _weighted(reps: DataFrame) -> DataFrame:
    """Adds ``weight``: how many classes share a class's left sketches, then a hash.

    The original of a group of copies shares most, and as the pivot of a bucket it links most of it.
    """
    sides = reps.select("id", F.posexplode("left").alias("i", "x"))
    common = sides.groupBy("i", "x").agg(F.count("*").alias("n")).where("n > 1")
    shared = sides.join(common, ["i", "x"]).groupBy("id").agg(F.sum("n").alias("n"))
    weight = F.shiftleft(F.coalesce("n", F.lit(0)).cast("long"), 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    return reps.join(shared, "id", "left").withColumn("weight", weight).drop("n")


def near_duplicates(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Rows are linked if ``100 * intersection >= percent * union`` of their sets of five-word shingles;
    ``component_id`` is the least id that links reach, ``kept`` marks the row that has it.

    1. Equal sets collapse to one class, named by its least id, before any pair is made.
    2. Classes get their table keys; in each bucket every member is compared with one pivot.
    3. What the pivots' stars leave in different components, and the triangle inequality of the Jaccard
       distance does not rule out, is compared in blocks, so no bucket member goes untested.

    Rows without text or words have 0 shingles and link with nothing, nor do rows without an id (component
    null, kept). Repeated rows share their class; all rows of the least id are kept. Other columns are
    ignored. An empty table gives an empty result.
    """
    sets = stored(sketches(docs, banding), "minhash-sets")
    able = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "sum_a", "sum_b"]
    classes = able.groupBy(*same).agg(
        F.min("doc_id").alias("id"), F.any_value("left").alias("left"), F.any_value("right").alias("right")
    )
    reps = stored(_weighted(stored(classes, "minhash-classes")), "minhash-weighted")
    keys = _keys(reps)
    pivots = keys.groupBy("key").agg(F.count("*").alias("n"), F.max_by("id", "weight").alias("pivot")).where("n > 1")
    stars = stored(
        keys.join(pivots.select("key", "pivot"), "key").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(),
        "minhash-stars",
    )
    checked = stored(overlaps(docs, stars), "minhash-checked")
    links = checked.where(_linked(banding.percent)).select("a", "b")
    found = components(links, "minhash-links")
    more = stored(_rest(docs, reps, checked, found, banding.percent), "minhash-more")
    if not more.isEmpty():
        found = components(links.unionByName(more), "minhash-links")
    named = reps.join(found, reps["id"] == found["node"], "left").select(
        *same, F.coalesce("component", "id").alias("component_id")
    )
    return (
        sets.select("doc_id", *same).join(named, same, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, banding: Banding = Banding()) -> DataFrame:
    """The rows of ``docs`` but those that link to a row of a lesser id; all columns stay.

    Of rows that are equal in id and text one stays. Rows without an id or without words all stay.
    """
    found = stored(near_duplicates(docs, banding).select("doc_id", "kept"), "minhash-kept")
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    # ids grow with the corpus: joined by shuffle at any size
    kept = docs.hint("merge").join(dropped, "doc_id", "left_anti")
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = stored(again.select("doc_id"), "minhash-repeated")
    if not again.isEmpty():
        repeated = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(repeated)
    return kept.select(docs.columns)


def _rest(docs: DataFrame, reps: DataFrame, checked: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one pivot's buckets that the stars left in different components.

    With d the Jaccard distance, d(x, y) >= |d(x, pivot) - d(y, pivot)|: members go to the two bands of width 1 -
    percent/100 that their distance allows. A band with two components is cut into parts, and every
    two parts meet in one block.
    """
    width = 1 - percent / 100
    far = 1 - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
    near = checked.groupBy("a", "b").agg(F.min(far).alias("far"))
    placed = near.withColumnRenamed("b", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("a").alias("pivot"), "id", F.coalesce("component", "id").alias("component"), F.floor(F.col("far") / width).alias("low")
    ).withColumn("band", F.explode(F.array("low", F.col("low") + 1))).drop("low")
    mixed = (
        placed.groupBy("pivot", "band")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("n"))
        .where("least <> most").select("pivot", "band", F.ceil(F.col("n") / PART).cast("long").alias("parts"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # a hot pivot's members meet the number of their parts in many tasks
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    part = F.pmod(F.xxhash64("id", "pivot"), F.col("parts"))
    members = placed.join(mixed, ["pivot", "band", "salt"]).withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    )
    blocks = stored(
        members.select("pivot", "band", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "id", "component"),
        "minhash-blocks",
    )
    held = reps.select("id", "left", "right")
    rows = _texts_of(docs, blocks).hint("merge").join(blocks, "id").join(held, "id").select(
        "pivot", "band", "p", "q", "part", "id", "component", "left", "right", "text"
    )
    return (
        rows.repartition("pivot", "band", "p", "q").sortWithinPartitions("pivot", "band", "p", "q")
        .mapInArrow(_block_links(percent), "a long, b long").distinct()
    )


def _block_links(percent: int):
    """Links of each block: a spanning forest of them over the components it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            for piece in slices(batch, 9):
                sets = shingle_sets(piece.column(9))
                for key, rest, s in zip(zip(*(piece.column(i).to_pylist() for i in range(4))), zip(*(piece.column(i).to_pylist() for i in range(4, 9))), sets):
                    if key != block:
                        yield _links(rows, block, percent)
                        block, rows = key, []
                    rows.append((*rest, s))
        yield _links(rows, block, percent)

    return run


def _links(rows: list, block: tuple | None, percent: int) -> pa.RecordBatch:
    out: list[tuple[int, int]] = []
    if rows:
        p, q = block[2:]
        sides = [[r for r in rows if r[0] == part] for part in dict.fromkeys((p, q))]
        first, second = sides[0], sides[-1]
        if first and second:
            out = _forest(first, second, percent)
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _forest(first: list, second: list, percent: int) -> list[tuple[int, int]]:
    shared = _intersections([r[5] for r in first], [r[5] for r in second])
    sizes = [np.array([len(r[5]) for r in side]) for side in (first, second)]
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    apart = np.array([r[2] for r in first])[:, None] != np.array([r[2] for r in second])[None, :]
    for side in (3, 4):  # only pairs that a table key joins are candidates
        x, y = (np.array([r[side] for r in rows]) for rows in (first, second))
        apart &= (x[:, None, :] == y[None, :, :]).any(axis=2)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(apart & (100 * shared >= percent * union))):
        a, b = find(first[i][2]), find(second[j][2])
        if a != b:
            root[a] = b
            out.append((first[i][1], second[j][1]))
    return out


def _intersections(first: list[np.ndarray], second: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of their 0/1 rows over shared members."""
    common = np.intersect1d(np.unique(np.concatenate(first)), np.unique(np.concatenate(second)), assume_unique=True)
    total = np.zeros((len(first), len(second)), np.int64)
    for lo in range(0, len(common), 8192):
        part = common[lo : lo + 8192]
        grids = []
        for side in (first, second):
            grid = np.zeros((len(side), len(part)), np.float32)
            for i, s in enumerate(side):
                own = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                at = np.searchsorted(part, own)
                grid[i, at[part[at] == own]] = 1
            grids.append(grid)
        total += (grids[0] @ grids[1].T).astype(np.int64)
    return total
