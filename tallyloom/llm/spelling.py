"""Spelling variants: words at one inserted, deleted or replaced character, by pairs of trie nodes.

Every prefix of a word is a node of the trie of all words, every suffix one of the trie of the reversed words. Nodes are
numbered where the sorted words are streamed: a word adds the nodes beyond what it shares with the word before it. A word
that skips one position is then a pair of integers, the nodes before and after it; whole, it is the pairs at its cuts. Words
with one skip pair differ in that position alone, and a skip pair that is a cut pair of another word leads to that word with
the position deleted. No text is compared or hashed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import stored

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Nodes that one partition may number.
NODES = 1 << 40


@dataclass(frozen=True)
class Spelling:
    """Which words are compared, which runs are damaged, and how much more common a form must be."""

    least_length: int = 5
    least_count: int = 3
    damage: int = 97
    factor: int = 2


def vocabulary(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """(word, n): the letter runs of all texts that occur often enough, lower-cased in A-Z.

    Of every run whose crc32 with its document is divisible by ``damage``, one character is missing. Null texts hold no
    runs; a null doc_id counts as empty text. Counts are combined before they move, so no frequent word is a hot key.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit("([a-zÀ-ÿ]+)"))).alias("run"),
    )
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", F.crc32(F.concat_ws(":", "doc", "run").cast("binary"))).select(
        F.when(F.col("h") % rule.damage == 0, cut).otherwise(F.col("run")).alias("word")
    )
    counts = words.where(F.length("word") >= rule.least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= rule.least_count)


def _shared(a: str, b: str) -> int:
    """How many characters two texts begin with in common."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    if hi <= 64:
        while lo < hi and a[lo] == b[lo]:
            lo += 1
        return lo
    while lo < hi:
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if a[lo:middle] == b[lo:middle] else (lo, middle - 1)
    return lo


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of words that come sorted by ``key``: for each word one number per prefix, the empty one first."""
    part = TaskContext.get().partitionId()
    following, before, path = part * NODES + 1, "", [part * NODES]
    for batch in batches:
        paths = []
        for key in batch.column(batch.schema.get_field_index("key")).to_pylist():
            common = _shared(before, key)
            added = len(key) - common
            path = path[: common + 1] + list(range(following, following + added))
            following, before = following + added, key
            paths.append(path)
        parts = pa.array([part] * len(paths), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(paths, pa.list_(pa.int64())), parts], [*batch.schema.names, "nodes", "part"]
        )


def _bridges(ends: list) -> list[tuple[int, list[int], list[int]]]:
    """Per partition the nodes it numbered anew although an earlier partition has them, and their first numbers.

    ``ends`` has one row per partition, so this is as long as there are partitions: what a partition's first word shares with
    the last word before it are the only nodes that two partitions can both hold.
    """
    rows, last, path = [], "", None
    for end in ends:
        common = -1 if path is None else _shared(last, end["first"])
        local, known = list(end["first_nodes"][: common + 1]), [] if path is None else path[: common + 1]
        if known:
            rows.append((end["part"], local, known))
        last, path = end["last"], list(end["last_nodes"])
        for i, (mine, first) in enumerate(zip(local, known)):
            if i < len(path) and path[i] == mine:
                path[i] = first
    return rows


def number_nodes(words: DataFrame, key: Column, name: str) -> DataFrame:
    """``words`` with an array ``name``: the trie node of each prefix of ``key``, the empty prefix first.

    Words are dealt by ranges of ``key``; equal prefixes have equal numbers wherever they lie.
    """
    dealt = words.withColumn("key", key).repartitionByRange("key").sortWithinPartitions("key")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    numbered = stored(dealt.mapInArrow(_number, f"{columns}, nodes array<long>, part int"), f"nodes-{name}")
    ends = numbered.groupBy("part").agg(
        F.min("key").alias("first"), F.max("key").alias("last"),
        F.min_by("nodes", "key").alias("first_nodes"), F.max_by("nodes", "key").alias("last_nodes"),
    )
    bridges = numbered.sparkSession.createDataFrame(
        _bridges(ends.orderBy("part").collect()), "part int, local array<long>, known array<long>"
    )
    node = F.transform("nodes", lambda x, i: F.when((i < F.size("local")) & (x == F.get("local", i)), F.get("known", i)).otherwise(x))
    joined = numbered.join(bridges, "part", "left")
    return joined.withColumn(name, F.when(F.col("local").isNull(), F.col("nodes")).otherwise(node)).drop(
        "key", "nodes", "part", "local", "known"
    )


SKIP, REPEAT, WHOLE = 0, 1, 2


def pair_dictionary(words: DataFrame) -> DataFrame:
    """(prefix, suffix, id, kind) of ranked ``words`` (id, word): all skip pairs and all cut pairs of every word.

    A skip whose character equals the one before it is a REPEAT: deleting either leaves the same word, which counts once.
    """
    numbered = number_nodes(number_nodes(words, F.col("word"), "heads"), F.reverse("word"), "tails")
    size = F.size("heads") - 1
    skips = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda i: F.struct(
            F.get("heads", i).alias("prefix"), F.get("tails", size - 1 - i).alias("suffix"),
            F.when((i > 0) & (F.get("letters", i) == F.get("letters", i - 1)), F.lit(REPEAT)).otherwise(F.lit(SKIP)).alias("kind"),
        ),
    )
    cuts = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.struct(F.get("heads", i).alias("prefix"), F.get("tails", size - i).alias("suffix"), F.lit(WHOLE).alias("kind")),
    )
    numbered = numbered.withColumn("letters", F.split("word", ""))
    return numbered.select("id", F.inline(F.concat(skips, cuts)))


def neighbours(pairs: DataFrame) -> DataFrame:
    """(id, n_near, best): how many words are near, and the near word of least rank; words without any are left out.

    Rows that share a pair are one word at most that it cuts and words that differ in one letter, so no window is larger than
    the alphabet. A row needs only the count and the two least ranks of its window; no pairs of words are made.
    """
    skip = F.col("kind") != WHOLE
    pair = Window.partitionBy("prefix", "suffix")
    ranked = pair.orderBy(F.col("kind") == WHOLE, "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = pairs.select(
        "id", "kind",
        F.count_if(skip).over(ranked).alias("skips"),
        F.count_if(F.col("kind") == SKIP).over(ranked).alias("deletions"),
        F.min(F.when(F.col("kind") == SKIP, F.col("id"))).over(ranked).alias("longer"),
        F.max(F.when(~skip, F.col("id"))).over(ranked).alias("shorter"),
        F.nth_value("id", 1).over(ranked).alias("first"),
        F.nth_value("id", 2).over(ranked).alias("second"),
    )
    replaced = F.col("skips") - 1
    other = F.when(replaced > 0, F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first")))
    deleted = F.when(F.col("kind") == SKIP, F.col("shorter"))
    near = F.when(skip, replaced + deleted.isNotNull().cast("long")).otherwise(F.col("deletions"))
    best = F.when(skip, F.least(other, deleted)).otherwise(F.col("longer"))
    found = rows.select("id", near.alias("near"), best.alias("best")).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) for (id, form): the end of each chain of forms, by doubling.

    Counts grow along a chain by ``factor`` at least, so a chain has as many steps as a count has digits to that base, and
    the rounds are the logarithm of that.
    """
    chains = stored(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = chains.alias("a").join(chains.select(F.col("id").alias("at"), F.col("root").alias("next")), F.col("root") == F.col("at"), "left")
        if further.where("next IS NOT NULL").isEmpty():
            return chains
        chains = stored(further.select("id", F.coalesce("next", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, rule: Spelling = Spelling()) -> DataFrame:
    """Per word of ``vocabulary``: word, form, root, n, n_near, form_n.

    ``form`` is the most common near word (ties: least in code-point order) if it is ``factor`` times as common as the
    word; ``root`` is where the forms end. Tables without words give no rows. Other columns of ``docs`` are ignored,
    repeated rows count as often as they stand, and words may be of any length.
    """
    ranked = vocabulary(docs, rule).orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id())
    words = stored(ranked, "spelling-words")
    near = stored(neighbours(pair_dictionary(words.select("id", "word"))), "spelling-near")
    counts = words.select(F.col("id").alias("best"), F.col("n").alias("form_n"))
    links = stored(words.join(near, "id", "left").join(counts, "best", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        *(F.when(F.col("form_n") >= rule.factor * F.col("n"), F.col(c)).alias(a) for c, a in (("best", "form"), ("form_n", "form_n"))),
    ), "spelling-links")
    formed = links.where("form IS NOT NULL")
    names = words.select(F.col("id").alias("named"), F.col("word").alias("name"))
    ends = _roots(formed.select("id", "form")).join(names, F.col("root") == F.col("named")).select("id", F.col("name").alias("root"))
    forms = formed.join(names, F.col("form") == F.col("named")).join(ends, "id").select(
        "word", F.col("name").alias("form"), "root", "n", "n_near", "form_n"
    )
    alone = links.where("form IS NULL").select(
        "word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n"
    )
    return forms.unionByName(alone)


SQL = """
WITH RECURSIVE steps AS (
  SELECT n::BIGINT AS n, n::BIGINT AS v, 0 AS bit FROM range(256) r(n)
  UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, bit + 1 FROM steps WHERE bit < 8
), crcs AS (SELECT list(v ORDER BY n) AS t FROM steps WHERE bit = 8),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), keyed AS (SELECT run, doc || ':' || run AS k, count(*) AS c FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
    flatten(list_transform(string_split(k, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
      ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END)),
    lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1]), 4294967295)) AS h
  FROM keyed, crcs
), words AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word,
    sum(c)::BIGINT AS n
  FROM hashed GROUP BY 1
), vocab AS (SELECT word, n FROM words WHERE length(word) >= 5 AND n >= 3),
skips AS (
  SELECT word, n, substr(word, 1, i) AS l, substr(word, i + 2) AS r
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM skips a JOIN skips b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM skips a JOIN vocab b ON b.word = a.l || a.r
  UNION SELECT b.word, a.word, a.n FROM skips a JOIN vocab b ON b.word = a.l || a.r
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
    CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n
  FROM vocab v LEFT JOIN best USING (word)
), chains AS (
  SELECT word, word AS at, form AS following FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.following
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word AND c.following IS NULL
"""
