import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import spelling
from tests.llm.conftest import documents

LOWER = str.maketrans(spelling.CAPITALS, spelling.SMALL)


def brute(rows, rule=spelling.Spelling()):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % rule.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= rule.least_length and n >= rule.least_count}
    letters = {c for w in words for c in w}
    near = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            for other in {w[:i] + w[i + 1 :], *(w[:i] + c + w[i + 1 :] for c in letters)}:
                if other != w and other in words:
                    near[w].add(other)
                    near[other].add(w)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= rule.factor * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), words.get(forms[w])))
    return sorted(out, key=lambda r: r[0])


def check(df, rule=spelling.Spelling()):
    got = spelling.variants(df, rule).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == brute([(r["doc_id"], r["text"]) for r in df.collect()], rule)
    return got


def test_table(spark, sf_dir):
    got = check(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert any(r["form"] and r["root"] != r["form"] for r in got) or any(r["form"] for r in got)


@pytest.mark.parametrize("parts", [1, 5])
def test_few_letters(spark, parts):
    """Short words of few letters have many neighbours, runs of one letter, and long chains of forms."""
    words = ["".join("abç"[(i // 3**k) % 3] for k in range(5 + i % 3)) for i in range(900)]
    rows = [(i, " ".join([w.upper() if i % 2 else w] * (3 + i * i % 40)), "s") for i, w in enumerate(words)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges become one partition
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = check(documents(spark, rows).repartition(parts))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["n_near"] for r in got) > 10 and any(r["form"] not in (None, r["root"]) for r in got)


def test_nodes_are_those_of_the_trie(spark):
    """Equal prefixes have one number, unequal ones two, over all partitions."""
    words = sorted({f"{a}{b}{c}" for a in ("x", "xy", "zebra") for b in range(40) for c in ("", "q", "qq")})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spelling.number_nodes(df, F.col("word"), "heads").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    numbers = defaultdict(set)
    for r in rows:
        for d, node in enumerate(r["heads"]):
            numbers[r["word"][:d]].add(node)
    assert all(len(v) == 1 for v in numbers.values())
    assert len({next(iter(v)) for v in numbers.values()}) == len(numbers)


def test_odd_and_empty(spark, odd):
    got = check(odd.unionByName(odd).unionByName(odd))
    assert any(len(r["word"]) > 100_000 for r in got)  # a word of 300,000 characters
    assert spelling.variants(odd.limit(0)).collect() == []
    assert spelling.variants(documents(spark, [(1, "ab cd", "s"), (2, None, None)])).collect() == []


def test_multiplication_sign_counts_as_a_letter(spark):
    check(documents(spark, [(i, "abc×def abc÷def ÀBCDEF àbcdef ABCDEÀ abcdeà straße", "s") for i in range(5)]))
