"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Each document has a 60-bit hash. A source's documents below a threshold get one more copy than the
rest. The threshold is found by summing words per hash bucket, then again inside the one bucket
that the budget runs out in, until that bucket holds a single hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.session import stored

WORD = "[^\\x20\\x09-\\x0D]+"
HASH_BITS = 60


def size_of(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of a digest of id and text, so that rows tie only if both are equal."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long")


def _weighted(totals: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds ``weight``: the weights repeat over the sources by code point, null last.

    Places are counted within ranges of sources and added up over the ranges.
    """
    ranged = stored(
        totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources"
    )
    before = ranged.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before")
    )
    place = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    choice = F.element_at(F.array(*(F.lit(w) for w in weights)), (place % len(weights) + 1).cast("int"))
    return stored(ranged.join(before, "part").select("source", "source_size", choice.cast("long").alias("weight")), "mix-weights")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target): words shared by weight, at most ``most`` times a source's own.

    What a full source cannot take is shared again by weight among the others, until none is above.
    """
    sources = _weighted(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    cap = F.col("source_size") * most
    whole = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, shares = int(whole[0] or 0), int(whole[1] or 0)
    left, open_shares = total, shares
    while True:
        full = cap.cast("decimal(20,0)") * open_shares <= F.col("weight").cast("decimal(20,0)") * left
        taken = sources.where(full).agg(F.sum(cap), F.sum("weight")).first()
        state = total - int(taken[0] or 0), shares - int(taken[1] or 0)
        if state == (left, open_shares):
            break
        left, open_shares = state
    share = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(max(open_shares, 1)))
    return sources.select("source", "source_size", F.when(full, cap.cast("double")).otherwise(share).alias("target"))


def plan(sized: DataFrame, wanted: DataFrame, bits: int = 12) -> DataFrame:
    """(source, source_size, target, base, threshold): copies of all, and below which hash one more."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = wanted.withColumn("base", base.cast("long")).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    goals = stored(goals, "mix-goals")
    rows = sized.where("size > 0").select("source", "size", "hash")
    open_goals = goals.where("need > 0").select("source", "need", F.lit(0.0).alias("done"), F.lit(0).cast("long").alias("prefix"))
    edges = None
    for depth in range(1, HASH_BITS // bits + 1):
        shift = HASH_BITS - bits * depth
        inside = rows.alias("r").join(
            open_goals.alias("g"),
            F.expr(f"r.source <=> g.source AND shiftright(r.hash, {shift + bits}) = g.prefix"),
        ).select("r.source", "r.size", "r.hash", "g.need", "g.done")
        if depth > 1:
            inside = stored(inside, "mix-boundary")
            rows = inside.select("source", "size", "hash")
        sums = inside.groupBy("source", "need", "done", F.shiftright("hash", shift).alias("prefix")).agg(
            F.sum("size").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        upto = F.col("done") + F.sum("n").over(W.partitionBy("source").orderBy("prefix"))
        boundary = stored(
            sums.withColumn("upto", upto).withColumn("done", F.col("upto") - F.col("n"))
            .where("done <= need AND need < upto"),
            "mix-level",
        )
        single = boundary.where("low = high")
        # the hash that the budget ends in is taken if that brings the sum nearer
        found = single.select(
            "source", F.when(2 * (F.col("need") - F.col("done")) >= F.col("n"), F.col("low") + 1).otherwise(F.col("low")).alias("threshold")
        )
        edges = found if edges is None else edges.unionByName(found)
        open_goals = boundary.where("low <> high").select("source", "need", "done", "prefix")
        if open_goals.isEmpty():
            break
    picked = goals.alias("g").join(edges.alias("e"), F.expr("g.source <=> e.source"), "left").select(
        "g.source", "source_size", "target", "base", F.coalesce("threshold", F.lit(0)).cast("long").alias("threshold")
    )
    return stored(picked, "mix-plan")


def sized_rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return stored(
        docs.select("doc_id", F.col("source").cast("string"), size_of(text).alias("size"), hash_of(F.col("doc_id"), text).alias("hash")),
        "mix-sized",
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken words, copies.

    Sources of no words have target 0. Documents without words count 0 and follow their hash. Rows that are
    equal in id and text get equal numbers of copies. Null sources are one source, the last. An
    empty table gives an empty result. Other columns are ignored.
    """
    sized = sized_rows(docs)
    chosen = plan(sized, targets(sized, weights, most))
    copies = F.col("base") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return (
        sized.alias("s").join(chosen.alias("p"), F.expr("s.source <=> p.source"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns stay."""
    sized = sized_rows(docs)
    chosen = plan(sized, targets(sized, weights, most))
    hashed = docs.withColumn("_mix_hash", hash_of(F.col("doc_id"), F.col("text").cast("string")))
    counted = hashed.alias("d").join(chosen.alias("p"), F.expr("CAST(d.source AS STRING) <=> p.source")).withColumn(
        "_mix_copies", F.col("p.base") + F.when(F.col("d._mix_hash") < F.col("p.threshold"), 1).otherwise(0)
    )
    return (
        counted.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_mix_copies")))
        .select(*(F.col(f"d.`{c}`") for c in docs.columns))
    )


#: The same mix over whole tables with one running sum per source.
SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source),
weighted AS (SELECT source, s, 3 * s AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM totals),
ordered AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST) AS k FROM weighted),
whole AS (SELECT sum(s) AS t, sum(w) AS ws FROM weighted),
prefixes AS (
  SELECT 0 AS k, t AS r, ws AS u FROM whole
  UNION ALL
  SELECT k, t - sum(cap) OVER (ORDER BY k), ws - sum(w) OVER (ORDER BY k) FROM ordered, whole),
filled AS (
  SELECT min(p.k) AS k FROM prefixes p LEFT JOIN ordered o ON o.k = p.k + 1
  WHERE o.k IS NULL OR o.cap * p.u > o.w * p.r),
goals AS (
  SELECT o.source, o.s, CASE WHEN o.k <= f.k THEN o.cap::DOUBLE ELSE (o.w * p.r)::DOUBLE / p.u::DOUBLE END AS target
  FROM ordered o, filled f, prefixes p WHERE p.k = f.k),
based AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS base FROM goals),
hashes AS (SELECT source, h, sum(size)::BIGINT AS n FROM sized GROUP BY source, h),
upto AS (SELECT source, h, n, sum(n) OVER (PARTITION BY source ORDER BY h)::BIGINT AS c FROM hashes)
SELECT z.doc_id, z.size, b.s AS source_size, b.target,
  z.size * (b.base + CASE WHEN u.c <= b.target - b.base * b.s
    OR (u.c - u.n <= b.target - b.base * b.s AND 2 * (b.target - b.base * b.s - (u.c - u.n)) >= u.n AND u.n > 0)
    THEN 1 ELSE 0 END) AS taken
FROM sized z JOIN based b ON z.source IS NOT DISTINCT FROM b.source
JOIN upto u ON z.source IS NOT DISTINCT FROM u.source AND z.h = u.h
"""
