import hashlib
import random
from collections import defaultdict
from zlib import crc32

import pytest

from tallyloom.llm import prefix_trie
from tests.llm.conftest import CLASHING

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for conv, turns in own.items():
        h, base = crc32(str(conv).encode()) % 6, conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        rebuilt[conv] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1]) if node else 0
    return sorted((
        min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children.get(node, 0), leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node)))).encode()).hexdigest(),
    ) for node, convs in members.items())


def check(df):
    nodes = prefix_trie.prefix_trie(df)
    got = nodes.select(COLUMNS).collect()
    expected = brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    return got


def test_table(spark, sf_dir):
    assert len(check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))) > 20


@pytest.mark.parametrize("seed", [1, 2])
def test_generated(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-250, 900), 300):
        rows += [(conv, t, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "", None, "é𝄞"])) for t in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_odd_rows(spark):
    long_text = "word " * 100_000
    rows = [
        (0, None, None, None), (0, None, "user", "x"), (0, 1, "user", long_text), (0, 1, "user", long_text), (1, 5, "user", long_text),
        (None, 1, "user", "lost"), (7, 3, "b", "y"), (7, 3, "a", "y"), (7, 3, "a", "x"), (205, 0, "user", ""), (2**40, 1, "user", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in [*CLASHING, "f1", "depth", "pos", "k"]:
        df = df.selectExpr("*", f"'x' AS `{name}`")
    check(df)


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_turnless(spark):
    """Conversations that keep no turn end at the root."""
    convs = [c for c in range(1, 400) if crc32(str(c).encode()) % 6 and c % 100]
    got = check(spark.createDataFrame([(c, 1, "user", "x") for c in convs], SCHEMA))
    assert [(r["depth"], r["n_convs"], r["n_leaves"]) for r in got] == [(0, len(convs), 1)]


def test_hot_conversation_lies_in_parts(spark):
    """One conversation holds most rows, many of them equal; its running product is made in several parts."""
    rows = [(100, t // 3, "user", f"t{t % 2}") for t in range(6000)] + [(c, t, "user", f"t{t % 2}") for c in range(101, 140) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    products = prefix_trie._products(prefix_trie._hashed(df, 0))
    assert products.where("conv_id = 100").selectExpr("count(DISTINCT pos)", "max(pos)").first() == (6000, 6000)
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.prefix_trie(df).collect()}
    assert max(d for _, d in got) >= 6000 and got[100, 6000]["n_leaves"] == 1 and got[100, 1]["saved_tokens"] == got[100, 0]["saved_tokens"]


def test_references_lead_to_the_turn(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    stored = {(r["conv_id"], r["turn"] + 1): r["text"] for r in table.collect()}
    for r in prefix_trie.prefix_trie(table).where("depth > 0").collect():
        assert (r["turn_conv_id"], r["turn_pos"]) in stored


def test_a_collision_of_hashes_is_found(spark, monkeypatch):
    """Hashes that tell nothing apart at first are taken anew."""
    taken, hashed = [], prefix_trie._hashed

    def poor(conversations, seed):
        taken.append(seed)
        turns = hashed(conversations, seed)
        return turns.selectExpr("conv_id", "turn", "role", "text", "1L AS t1", "1L AS t2") if seed == 0 else turns

    monkeypatch.setattr(prefix_trie, "_hashed", poor)
    check(spark.createDataFrame([(c, t, "user", f"{c % 3} {t}") for c in range(300, 320) for t in range(6)], SCHEMA))
    assert taken == [0, 1]
