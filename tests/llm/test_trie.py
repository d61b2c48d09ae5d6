"""The prefix trie against SQL, a plain trie and odd rows."""

import hashlib
import random
import zlib

import pytest

from spanloom.llm import queries, trie
from tests.parity import same

SCHEMA = "conv_id long, turn int, role string, text string, key string, n int, depth int"


def brute(rows, family=5, cycle=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest())
    own = {c: [t[1:] for t in sorted(ts, key=order)] for c, ts in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % cycle, c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[:-1] == p for q in below) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(path))
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(-6, n):
        for turn in range(r.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", r.choice(["a", "b", "ü"]) if turn < 12 else f"end {c % 3}"))
    return rows


ODD = [(900, None, None, None), (900, None, "user", "x"), (900, 1, "user", None), (901, 1, None, "x"), (901, 1, None, "x"), (None, 1, "user", "lost"), (902, 3, "user", "é" * 100_000), (905, 1, "user", "tie b"), (905, 1, "user", "tie a"), (905, 1, "a", "tie")]


@pytest.mark.parametrize("block", [1, 3, 8])
def test_equals_a_plain_trie(spark, block):
    rows = conversations(block, 60) + ODD
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, trie.prefix_trie(df, block=block).collect()), key=str) == brute(rows)


def test_groups_of_equal_conversations_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "_CHUNK", 7)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(90) for t in range(4)] + [(5 * c, 4, "user", "more") for c in range(0, 90, 30)]
    df = spark.createDataFrame([(*x, "k", 1, 2) for x in rows], SCHEMA)
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == brute(rows)


def test_one_conversation_and_none(spark):
    df = spark.createDataFrame([(7, t, "user", "x", "", 0, 0) for t in range(3)], SCHEMA)
    assert sorted(map(tuple, trie.prefix_trie(df).collect()), key=str) == brute([(7, t, "user", "x") for t in range(3)])
    assert trie.prefix_trie(df.limit(0)).count() == 0


def test_long_tails_come_in_runs(spark):
    rows = [(c, t, "user", f"{t}" if t < 3 else f"{c} {t}") for c in (10, 20) for t in range(9_000)]
    df = spark.createDataFrame([(*x, "", 0, 0) for x in rows], SCHEMA)
    got = trie.prefix_trie(df)
    assert got.count() == 4 + 2 * (9_000 - 3) and got.where("n_children = 0").count() == 2
    assert got.agg({"depth": "max"}).first()[0] == 9_000


def test_query_equals_sql(spark):
    more, fewer = same(spark, "/root/testdata/sf0.001", queries.op13_prefix_trie, queries.SQL["op13_prefix_trie"])
    assert not more and not fewer
