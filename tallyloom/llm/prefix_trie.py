"""The trie of conversations' turns, from fingerprints that compose.

A sequence of turns has a fingerprint in a monoid: its length and, to two bases, the polynomial of its turns' hashes modulo a
prime, with (m, a) (n, b) = (m + n, a B^n + b). Products of parts give the product of the whole, so the running products of one
long conversation are made in parts, and a conversation rebuilt from another's head and an own tail is the product of the two:
neither texts nor lists of turns are ever put together. Equal prefixes have equal products. That unequal ones differ is
verified on the stored turns: all turns of one hash hold one text, and all rows of one node end in one hash; by induction over
the depth a node then is one sequence. Should that ever fail, other hashes are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import stored

PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0A5B85A5F3C9D2E7 % PRIME)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
KEY = ["depth", "f1", "f2"]
#: Depths of one owner that a window takes together, and conversations that are joined to one text.
BLOCK, CHUNK_BITS = 1024, 12


@dataclass(frozen=True)
class Rebuild:
    """Which conversation gives the head, and how long it is: crc32 of the decimal id modulo ``heads``."""

    group: int = 100
    heads: int = 6

    def base(self, conv: Column) -> Column:
        return conv - conv % self.group

    def head(self, conv: Column) -> Column:
        return F.crc32(conv.cast("string").cast("binary")) % self.heads


class _Powers:
    """Powers of a base, kept for the exponents that recur."""

    def __init__(self, base: int):
        self.base, self.kept = base, [1]

    def __call__(self, n: int) -> int:
        if n < 1 << 16:
            while len(self.kept) <= n:
                self.kept.append(self.kept[-1] * self.base % PRIME)
            return self.kept[n]
        return pow(self.base, n, PRIME)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and running products within the run of a conversation that lies in this partition."""
    part, conv, pos, f1, f2 = TaskContext.get().partitionId(), None, 0, 0, 0
    for batch in batches:
        positions, firsts, seconds = [], [], []
        for own, t1, t2 in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "t1", "t2"))):
            if own != conv:
                conv, pos, f1, f2 = own, 0, 0, 0
            pos, f1, f2 = pos + 1, (f1 * BASES[0] + t1) % PRIME, (f2 * BASES[1] + t2) % PRIME
            positions.append(pos)
            firsts.append(f1)
            seconds.append(f2)
        kept = [batch.column(c) for c in ("conv_id", "chars", "t1", "t2")]
        made = [pa.array(x, pa.int64()) for x in (positions, firsts, seconds)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array([part] * len(positions), pa.int32()), *made], ["conv_id", "chars", "t1", "t2", "part", "pos", "f1", "f2"]
        )


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the runs of a conversation what stands before each: turns and their product."""
    powers = [_Powers(b) for b in BASES]
    for batch in batches:
        rows = []
        for conv, runs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "runs"))):
            before = c1 = c2 = 0
            for run in runs:
                rows.append((conv, run["part"], before, c1, c2))
                n = run["n"]
                c1, c2 = (c1 * powers[0](n) + run["f1"]) % PRIME, (c2 * powers[1](n) + run["f2"]) % PRIME
                before += n
        columns = list(zip(*rows)) or [[]] * 5
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "part", "before", "c1", "c2"])


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """f becomes c B^k + f, the product of what c stands for and the k turns of f; g is that without its last turn."""
    powers = [_Powers(b) for b in BASES]
    for batch in batches:
        lengths, names, arrays = batch.column("k").to_pylist(), [], []
        for i, (power, inverse) in enumerate(zip(powers, INVERSES), 1):
            before, own, last = (batch.column(f"{c}{i}").to_pylist() for c in "cft")
            whole = [(c * power(k) + f) % PRIME if c else f for c, k, f in zip(before, lengths, own)]
            names += [f"f{i}", f"g{i}"]
            arrays += [pa.array(whole, pa.int64()), pa.array([(f - t) * inverse % PRIME for f, t in zip(whole, last)], pa.int64())]
        kept = [n for n in batch.schema.names if n not in ("k", "c1", "c2", "f1", "f2")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *arrays], kept + names)


def _composed(rows: DataFrame) -> DataFrame:
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("k", "c1", "c2", "f1", "f2")]
    return rows.mapInArrow(_compose, ", ".join(kept + ["f1 long", "g1 long", "f2 long", "g2 long"]))


def _hashed(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns with two hashes; role and text stay for the columns that ask for them."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    hashes = [F.pmod(F.xxhash64(F.lit(2 * seed + i), role, text), F.lit(PRIME)).alias(f"t{i + 1}") for i in (0, 1)]
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), *hashes
    )


def _products(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, chars, t1, t2, f1, f2): each stored turn at its place, with the product of all turns up to it.

    Turns are dealt by ranges of their order, so a long conversation lies in several parts, each scanned alone; one row per part
    and conversation then tells what stands before.
    """
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest", "row"]
    dealt = turns.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("chars"),
        "t1", "t2", F.monotonically_increasing_id().alias("row"),
    ).repartitionByRange(*order).sortWithinPartitions(*order)
    runs = stored(dealt.mapInArrow(_scan, "conv_id long, chars long, t1 long, t2 long, part int, pos long, f1 long, f2 long"), "trie-runs")
    ends = runs.groupBy("conv_id", "part").agg(F.max("pos").alias("n"), F.max_by(F.struct("f1", "f2"), "pos").alias("f"))
    lists = ends.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "f.f1", "f.f2"))).alias("runs"))
    before = lists.mapInArrow(_carry, "conv_id long, part int, before long, c1 long, c2 long")
    rows = runs.join(before, ["conv_id", "part"]).select(
        "conv_id", (F.col("before") + F.col("pos")).alias("pos"), "chars", "t1", "t2", F.col("pos").alias("k"), "c1", "c2", "f1", "f2"
    )
    return stored(_composed(rows).drop("g1", "g2"), "trie-products")


def _plans(products: DataFrame, rule: Rebuild) -> DataFrame:
    """One row per conversation: how it is rebuilt.

    ``head`` holds the turns it takes from its base, at most ``heads`` - 1; (c1, c2) is what, times the base's power for the
    own turns, turns the product of an own turn into that of the rebuilt conversation.
    """
    turn = F.struct("pos", "chars", "t1", "t2", "f1", "f2")
    firsts = F.array_sort(F.collect_list(F.when(F.col("pos") < rule.heads, turn)))
    convs = products.groupBy("conv_id").agg(F.max("pos").alias("n"), firsts.alias("firsts"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("firsts").alias("lent"))
    head = F.coalesce(F.slice("lent", F.lit(1), F.col("h").cast("int")), F.array().cast(convs.schema["firsts"].dataType))
    lent, replaced = F.get("head", F.size("head") - 1), F.get("firsts", F.col("h").cast("int") - 1)
    product = [F.coalesce(lent[f], F.lit(0).cast("long")) - F.coalesce(replaced[f], F.lit(0).cast("long")) for f in ("f1", "f2")]
    return (
        convs.withColumn("base", rule.base(F.col("conv_id")))
        .withColumn("h", rule.head(F.col("conv_id")))
        .join(bases, "base", "left")
        .withColumn("head", head)
        .select(
            "conv_id", "base", "h", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("size"),
            *(F.pmod(p, F.lit(PRIME)).alias(c) for p, c in zip(product, ("c1", "c2"))),
        )
    )


def _members(products: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, depth, f1, f2, g1, g2, chars, t1, t2, turn_conv_id, turn_pos, size): every prefix of every rebuilt conversation.

    (turn_conv_id, turn_pos) refers to the stored turn that the prefix ends in, g is the fingerprint of its parent.
    """
    zero = F.lit(0).cast("long")
    heads = plans.select("conv_id", "size", F.col("base").alias("turn_conv_id"), F.explode("head").alias("x")).select(
        "conv_id", F.col("x.pos").alias("depth"), "x.chars", "x.t1", "x.t2", "turn_conv_id", F.col("x.pos").alias("turn_pos"), "size",
        zero.alias("k"), zero.alias("c1"), zero.alias("c2"), "x.f1", "x.f2",
    )
    tails = products.join(plans.select("conv_id", "h", F.size("head").alias("lent"), "size", "c1", "c2"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("lent") + F.col("pos") - F.col("h")).alias("depth"), "chars", "t1", "t2",
        F.col("conv_id").alias("turn_conv_id"), F.col("pos").alias("turn_pos"), "size", (F.col("pos") - F.col("h")).alias("k"), "c1", "c2", "f1", "f2",
    )
    return stored(_composed(heads.unionByName(tails)), "trie-members")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 per node of texts that come sorted by node and chunk, joined by commas as they stream by."""
    node, state = None, None
    for batch in batches:
        done = []
        for depth, f1, f2, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if (depth, f1, f2) != node:
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (depth, f1, f2), hashlib.sha256(text.encode())
            else:
                state.update(("," + text).encode())
        yield _sum_rows(done)
    if node:
        yield _sum_rows([(*node, state.hexdigest())])


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*KEY, "ends_sha256"])


def _ends(members: DataFrame, plans: DataFrame) -> DataFrame:
    """(depth, f1, f2, ends_sha256) of the nodes that conversations end at.

    A digest of one long list can only be taken in order. Ids are joined to texts in chunks of at most 4,096 beforehand, and
    what is left for the one task of a hot node streams through it.
    """
    zero = F.lit(0).cast("long")
    last = members.where("depth = size").select(*KEY, "conv_id").unionByName(
        plans.where("size = 0").select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "conv_id")
    )
    chunks = last.groupBy(*KEY, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(_sums, "depth long, f1 long, f2 long, ends_sha256 string")


def _verified(turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether each turn hash stands for one text and each node ends in one turn hash."""
    content = F.struct("role", "text")
    texts = turns.groupBy("t1", "t2").agg(F.min(content).alias("least"), F.max(content).alias("most"))
    return texts.where("least <> most").isEmpty() and nodes.where("t1 <> u1 OR t2 <> u2").isEmpty()


def prefix_trie(conversations: DataFrame, rule: Rebuild = Rebuild()) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv_id, turn_pos.

    The last two refer to a stored turn (its conversation, and its place there from 1) that holds the node's last turn. Rows
    without conv_id are no conversation. Equal turns are ordered by role and MD5 of the text, repeated rows are turns of their
    own, other columns are ignored; without conversations there is no node, not even a root.

    Sums over subtrees need no walk: each node belongs to its least member, the owner. Below a node lie, of every other member,
    all nodes that it owns, and of the owner those at the same depth or deeper.
    """
    seed = 0
    while True:
        turns = _hashed(conversations, seed)
        products = _products(turns)
        plans = stored(_plans(products, rule), "trie-plans")
        members = _members(products, plans)
        nodes = stored(members.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
            *(f("t" + i).alias(a + i) for f, a in ((F.min, "t"), (F.max, "u")) for i in "12"), F.min("g1").alias("g1"), F.min("g2").alias("g2"),
            F.min(F.struct("turn_conv_id", "turn_pos")).alias("turn"),
        ), "trie-nodes")
        if _verified(turns, nodes):
            break
        seed += 1
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("g1").alias("f1"), F.col("g2").alias("f2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = stored(
        nodes.join(children, KEY, "left").na.fill(0, ["n_children"]).withColumn("weight", (F.col("n_convs") - 1) * F.col("chars")), "trie-children"
    )
    owners = stored(
        nodes.groupBy("conv_id").agg(F.sum("weight").alias("owned"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf")), "trie-owners"
    )
    below = members.select(*KEY, "conv_id").join(owners, "conv_id").groupBy(*KEY).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("conv_id").alias("parent_conv_id"))
    ends = stored(_ends(members, plans), "trie-ends")
    nothing = hashlib.sha256().hexdigest()
    root_id = plans.agg(F.min("conv_id")).first()[0]
    inner = (
        _above(nodes).join(below, KEY).join(ends, KEY, "left").join(parents, ["depth", "g1", "g2"], "left")
        .join(owners.select("conv_id", F.col("owned").alias("own")), "conv_id")
        .select(
            "conv_id", "depth", F.when(F.col("depth") == 1, F.lit(root_id).cast("long")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children", "n_leaves", (F.col("owned") - F.col("own") + F.col("deeper")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "turn.turn_conv_id", "turn.turn_pos",
        )
    )
    return inner.unionByName(_root(plans, nodes, owners, ends, nothing))


def _above(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``deeper``: the weight of the owner's nodes at the same depth or deeper.

    Summed by blocks of depths first, so that no window holds a long conversation.
    """
    nodes = nodes.withColumn("block", F.expr(f"depth div {BLOCK}"))
    blocks = nodes.groupBy("conv_id", "block").agg(F.sum("weight").alias("sum"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("later"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("inside", F.sum("weight").over(inside)).join(blocks, ["conv_id", "block"]).withColumn("deeper", F.col("inside") + F.col("later"))


def _root(plans: DataFrame, nodes: DataFrame, owners: DataFrame, ends: DataFrame, nothing: str) -> DataFrame:
    """The textless node that all conversations start with; no row without conversations."""
    null = F.lit(None).cast("long")
    return plans.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), null.alias("parent_conv_id"), "n_convs",
        nodes.where("depth = 1").agg(F.count(F.lit(1))).scalar().alias("n_children"),
        F.greatest(owners.agg(F.coalesce(F.sum("leaf"), F.lit(0))).scalar(), F.lit(1)).alias("n_leaves"),
        owners.agg(F.coalesce(F.sum("owned"), F.lit(0))).scalar().alias("saved_tokens"),
        F.coalesce(ends.where("depth = 0").agg(F.max("ends_sha256")).scalar(), F.lit(nothing)).alias("ends_sha256"),
        null.alias("turn_conv_id"), null.alias("turn_pos"),
    )


SQL = """
WITH RECURSIVE steps AS (
  SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS bit FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, bit + 1 FROM steps WHERE bit < 8
), crcs AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE bit = 8),
turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT conv_id, list(said ORDER BY pos) AS own FROM turns GROUP BY conv_id),
cuts AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295)) % 6 AS h
  FROM convs, crcs
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS path
  FROM cuts c LEFT JOIN convs b ON b.conv_id = c.base
), members AS (
  SELECT conv_id, d AS depth, path[1:d] AS prefix, len(path) AS size FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix
), families AS (
  SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), weighed AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.prefix[-1].text) END AS weight
  FROM nodes n LEFT JOIN families f ON f.depth = n.depth AND f.prefix = n.prefix
), above AS (
  SELECT d AS depth, prefix[1:d] AS prefix, sum(weight)::BIGINT AS saved_tokens, count_if(n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM weighed) GROUP BY ALL
)
SELECT w.conv_id, w.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, w.ends_sha256
FROM weighed w JOIN above a ON a.depth = w.depth AND a.prefix = w.prefix
LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.prefix = w.prefix[1:w.depth - 1]
"""
