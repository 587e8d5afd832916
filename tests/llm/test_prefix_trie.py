"""The prefix trie against plain dictionaries, with hot turns, long conversations and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from perdura.llm import prefix_trie as trie

KIND = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return out


def brute(rows):
    seqs = rebuilt(rows)
    members = {}
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        if node:
            up = node[:-1]
            kids[up] = kids.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(convs), len(node), parent, len(convs), kids.get(node, 0), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def nodes(spark, rows, **more):
    frame = spark.createDataFrame(rows, KIND).withColumn("lo", F.lit("mine")).withColumn("depth", F.lit(-1))
    return sorted(map(tuple, trie.prefix_trie(frame.repartition(5), **more).collect()), key=str)


def talk(rng, c, turns, texts):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(turns)]


def odd_rows(seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "é", "some words", "more of them"]
    rows = []
    for c in [*range(-12, 40), 10**17, 10**17 + 3]:
        rows += talk(rng, c, rng.randint(1, 12), texts)
    rows += [(50 + i, t, "user", "the very same") for i in range(60) for t in range(5)]  # a hot conversation
    rows += [(200, None, "x", "null turn"), (200, None, None, None), (200, 1, "b", "tie"), (200, 1, "a", "tie"), (200, 1, "a", "tie")]
    rows += [(None, 1, "user", "no id"), rows[0], rows[1]]
    rows += [(300, t, "user", rng.choice("ab")) for t in range(700)]  # a long conversation
    rows += [(1000 + i, 0, "user", "short") for i in range(200)]  # many ends
    rows += [(5001 + 5 * i, 0, "user", "no base") for i in range(40)]  # many of them left without a turn
    return rows


def test_against_dictionaries(spark):
    rows = odd_rows(1)
    assert any(not seq for seq in rebuilt(rows).values())
    assert nodes(spark, rows) == brute(rows)


def test_shards_spills_blocks_and_split_conversations(spark, monkeypatch):
    """Several shards and heavy levels; runs of ends in blocks of three; conversations over several partitions."""
    monkeypatch.setattr(trie, "MEMORY", 3)
    monkeypatch.setattr(trie, "BLOCK", 3)
    monkeypatch.setattr(trie, "READ", 2)
    monkeypatch.setattr(trie.math, "isqrt", lambda n: 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = odd_rows(2)
        assert nodes(spark, rows, small=4) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_empty_table_and_one_turn(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 1, "a", "b")]) == []
    one = [(5, 1, "a", "b")]
    assert nodes(spark, one) == brute(one)


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_spilling_queue_gives_all_in_order(most):
    rng = random.Random(most)
    queue, waiting, got = trie.SpillingQueue(3, most), [], []
    for level in range(-5, 1):
        for item in sorted(i for i in waiting if i[0] == level):
            if not got or got[-1][:2] != item[:2]:
                got += sorted(queue.pop(item[:2]))
        for _ in range(60):
            item = (level + 1, rng.randint(0, 9), rng.randint(0, 99))
            waiting.append(item)
            queue.push(item)
    assert got == sorted(i for i in waiting if i[0] <= 0)
