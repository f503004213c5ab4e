"""The prefix trie of conversations against a plain walk over all prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from tierflow.llm import prefix_trie
from tierflow.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        # Columns that bear names the operator uses itself.
        *[T.StructField(n, T.StringType()) for n in "d key n w size total parent name leaf".split()],
    ]
)
NAMES = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(turns.get(c - int(abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def walk(node):
        leaves, saved = (0, 0) if children[node] else (1, 0)
        if node:
            saved = (len(members[node]) - 1) * len(node[-1][1].encode())
        for child in children[node]:
            more = walk(child)
            leaves, saved = leaves + more[0], saved + more[1]
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if paths[c] == node))
        out.append(
            (
                min(members[node]),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(members[node]),
                len(children[node]),
                leaves,
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
        return leaves, saved

    if paths:
        walk(())
    return sorted(out, key=repr)


def found(spark, rows, **sizes):
    wide = [(*r, *["junk"] * (len(SCHEMA) - len(r))) for r in rows]
    df = spark.createDataFrame(wide, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **sizes).select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("seed, block_rows", [(1, None), (2, 7)])
def test_random_conversations(spark, seed, block_rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SALT_TURNS", 3)
    monkeypatch.setattr(prefix_trie, "HOT_CHILDREN", 2)
    monkeypatch.setattr(prefix_trie, "RANGE_IDS", 10)
    monkeypatch.setattr(prefix_trie, "LIST_IDS", 3)
    rng = random.Random(seed)
    rows = []
    for c in range(-6, 40):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            text = rng.choice(["", "a", "é", None, "long text"]) if turn > 1 else "same"
            rows.append((c, turn, rng.choice(["user", None]) if turn % 3 == 2 else "user", text))
    assert found(spark, rows, block_rows=block_rows) == plain_trie(rows)


def test_many_copies_and_one_long_conversation(spark, monkeypatch):
    """Copies share one sequence; a long conversation is cut into ranges."""
    monkeypatch.setattr(prefix_trie, "SALT_TURNS", 50)
    rows = [(c, t, "user", f"text {t}") for c in range(100) for t in range(10)]
    rows += [(200, t, "user", f"turn {t % 7}") for t in range(600)]
    assert found(spark, rows, block_rows=100) == plain_trie(rows)


def test_nulls_repeats_and_ties(spark):
    rows = [
        (None, 0, "user", "lost"),
        (None, None, None, None),
        (0, None, "user", "first"),
        (0, None, "user", "first"),
        (0, 1, None, None),
        (0, 1, "", ""),
        (1, 0, "user", "x" * 100_000),
        (7, 0, "user", "no lender"),
        (9, None, None, None),
    ]
    assert found(spark, rows) == plain_trie(rows)


def test_empty(spark):
    assert found(spark, []) == []


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ours = QUERIES["op11_conversation_trie"](spark, SMALL).select(*NAMES).collect()
    assert sorted((tuple(r) for r in ours), key=repr) == plain_trie(rows)
