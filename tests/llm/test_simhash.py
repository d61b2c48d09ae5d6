"""SimHash fingerprints and vantage-point trees against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import queries, simhash

DOCS = "doc_id long, text string, code string, component string"


def brute_fingerprint(text, words=3):
    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(codes, radius):
    """Smallest position reachable from each position."""
    codes, label = np.array(codes, np.uint64), np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius
    while True:
        new = np.where(near, label[None, :], len(codes)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def clustered(r, n, spread):
    """Fingerprints of which most lie close to others."""
    out, centres = [], [r.getrandbits(64) for _ in range(max(1, n // 40))]
    for _ in range(n):
        x = r.choice(centres) if r.random() < 0.8 else r.getrandbits(64)
        for _ in range(r.randint(0, spread)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return sorted(set(out))


def test_fingerprints_follow_the_definition(monkeypatch):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "a b c a b c d É x\x00y", "tick tock " * 500, "\x0bx\x0cy z" * 90]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want and want[:3] == [0, 0, 0]
    monkeypatch.setattr(simhash, "_PIECE", 16)
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert [simhash.fingerprint(t) for t in texts] == want
    assert simhash.fingerprint("w " * 40 + "v" * 40, 5) == brute_fingerprint("w " * 40 + "v" * 40, 5)


@pytest.mark.parametrize("trees", [1, 2, 3])
def test_trees_lose_no_pair(trees):
    r = random.Random(trees)
    codes = np.array(clustered(r, 900, 5), np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    met = np.zeros_like(near)
    for part in simhash._parts(trees, 3):
        tree = simhash.Tree(codes[::3], simhash._tests(part, 3), 6)
        assert tree.leaves > 4
        homes = tree.homes(codes)
        met |= homes[:, None] == homes[None, :]
        who, where = tree.visits(codes, homes)
        for leaf in range(tree.leaves):
            met[np.ix_(who[where == leaf], homes == leaf)] = True
    assert not (near & ~(met | met.T)).any()


@pytest.mark.parametrize("cells", [64, 1 << 12])
def test_shards_are_settled_in_full(monkeypatch, cells):
    monkeypatch.setattr(simhash, "_CELLS", cells)
    r = random.Random(cells)
    centre = r.getrandbits(64)
    ball = {centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)}
    codes = sorted({*ball, *clustered(r, 300, 6)})
    classes, everyone = simhash._Classes(len(codes)), np.arange(len(codes))
    simhash.settle(np.array(codes, np.uint64), everyone, everyone, 3, [(2**32 - 1, 1), (simhash.ALL, 3)][1:], classes)
    assert classes.roots(everyone).tolist() == brute_classes(codes, 3)


@pytest.mark.parametrize("trees", [1, 2])
def test_links_equal_brute_force(spark, trees):
    codes = clustered(random.Random(9), 1500, 4)
    signed = np.array(codes, np.uint64).view(np.int64)
    table = spark.createDataFrame([(int(c),) for c in signed], "code long")
    found = simhash.links(table, trees=trees, shard_size=60, sample=400).collect()
    place, label = {int(c): i for i, c in enumerate(signed)}, simhash._Classes(len(codes))
    label.unite(np.array([place[x.a] for x in found]), np.array([place[x.b] for x in found]))
    assert label.roots(np.arange(len(codes))).tolist() == brute_classes(codes, 3)


def test_documents_equal_brute_force(spark):
    r = random.Random(2)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randint(0, 9)) for _ in range(r.randint(1, 200))) for _ in range(40)]
    rows = [(i, base[i % 40]) for i in range(60)]
    for i in range(60, 140):
        words = r.choice(base).split()
        words[r.randrange(len(words))] = "Changed"
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \t"), (None, None), (None, base[3]), (None, "all alone here"), rows[5], rows[5], (7, "another text of seven"), (600, "very long " * 200_000)]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in rows], DOCS).repartition(3)
    got = simhash.near_duplicates(docs, shard_size=20, sample=50)
    codes = [brute_fingerprint(t) for _, t in rows]
    labels = brute_classes(codes, 3)
    ids = {k: min((i for (i, _), l in zip(rows, labels) if l == k and i is not None), default=None) for k in labels}
    want = sorted(((i, f"{c:016x}", ids[l]) for (i, _), c, l in zip(rows, codes, labels)), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    labels = brute_classes([brute_fingerprint(x.text) for x in docs], 3)
    got = queries.op12_simhash(spark, sf).orderBy("doc_id").collect()
    assert [(x.doc_id, x.component_id) for x in got] == [(x.doc_id, docs[l].doc_id) for x, l in zip(docs, labels, strict=True)]
    assert got[0].fingerprint == f"{brute_fingerprint(docs[0].text):016x}"


def test_native_hash_agrees(spark):
    shown = spark.range(1).select(F.xxhash64(F.lit("ab cd ef"))).first()[0]
    assert simhash.fingerprint("AB cd  ef") == shown % 2**64
