"""Hubs and cut vertices against brute force on small random inputs."""

import random

import pytest

from spanloom.operators import cuts, splits


def pieces_of(ids, near):
    out, left = [], set(ids)
    while left:
        seen = {min(left)}
        while more := {y for x in seen for y in near[x] & left} - seen:
            seen |= more
        left -= seen
        out.append(seen)
    return out


def by_hand(nodes, links, least=7, parts=3):
    """Part and role of each node of one group."""
    near = {i: {a if b == i else b for a, b in links if i in (a, b)} for i in nodes}
    rows, rest = {}, set()
    for piece in pieces_of(nodes, near):
        work, any_hub = [piece], False
        while work:
            ids, found = work.pop(), []
            keeps = lambda v, p: len(p) > 1 and any(nodes[m][0] != nodes[v][0] for m in p)
            for v in ids if len(ids) >= least else ():
                n = sum(keeps(v, p) and any((m, v) in links for m in p) for p in pieces_of(ids - {v}, near))
                if n >= parts:
                    found.append((n, nodes[v][1], -v))
            if not found:
                if ids == piece:
                    rest |= ids
                else:
                    rows |= {m: (min(ids), "member") for m in ids}
                continue
            hub = -max(found)[2]
            rows |= {m: (hub, "absorbed") for m in ids} | {hub: (hub, "hub")}
            work += [p for p in pieces_of(ids - {hub}, near) if keeps(hub, p)]
    return rows | {m: (min(rest), "member") for m in rest}


def random_group(r, g, n, dense, files=10):
    nodes = {g * 1000 + i: (f"f{r.randint(0, files - 1)}", r.randint(0, 3)) for i in range(n)}
    links = set()
    for i in list(nodes)[1:]:
        for _ in range(r.choice([1, 1, 1, 2]) if dense else 1):
            if r.random() < 0.94:
                other = r.choice(range(max(g * 1000, i - 12), i))
                links.add((i, other) if r.random() < 0.7 else (other, i))
    return nodes, links


@pytest.mark.parametrize("seed", [8])
def test_hubs_equal_brute_force(spark, seed):
    r = random.Random(seed)
    members, edges, want = [], set(), {}
    for g, (n, dense) in enumerate([(60, False), (45, True), (8, False), (50, False)]):
        nodes, links = random_group(r, g, n, dense)
        want |= {(g, i): v for i, v in by_hand(nodes, links).items()}
        members += [(g, i, *v) for i, v in nodes.items()]
        edges |= links
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    got = splits.at_hubs(spark.createDataFrame(members, "grp long, id long, path string, score int"), e).collect()
    assert {x.role for x in got} == {"hub", "member", "absorbed"}
    assert len(got) == len(want) and {(x.grp, x.id): (x.part, x.role) for x in got} == want


def test_pieces_without_a_hub_stay_together(spark):
    """Eight members in four pairs are one group."""
    members = [(1, i, f"f{i}", 0) for i in range(8)]
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 8, 2)], "src long, dst long")
    got = splits.at_hubs(spark.createDataFrame(members, "grp long, id long, path string, score int"), e).collect()
    assert {(x.id, x.part, x.role) for x in got} == {(i, 0, "member") for i in range(8)}
    assert splits.at_hubs(spark.createDataFrame(members, "grp long, id long, path string, score int").limit(0), e).count() == 0


def test_text_ids(spark):
    """A router and three features of two files each; ids are text."""
    rows = [("r", "router.js", 1)] + [(f"{f}{k}", f"{f}{k}.js", 0) for f in "abc" for k in (1, 2)]
    calls = [(f"{f}1", "r") for f in "abc"] + [(f"{f}2", f"{f}1") for f in "abc"]
    members = spark.createDataFrame([("g", *x) for x in rows], "grp string, id string, path string, score int")
    got = {(x.id, x.part, x.role) for x in splits.at_hubs(members, spark.createDataFrame(calls, "src string, dst string")).collect()}
    assert got == {("r", "r", "hub")} | {(f"{f}{k}", f"{f}1", "member") for f in "abc" for k in (1, 2)}


def test_pieces_of_every_node(spark):
    """Sizes, files and calls of what each node's removal leaves, and the number of blocks of a ring with tails."""
    r = random.Random(3)
    nodes, links = random_group(r, 0, 40, True, files=3)
    near = {i: {a if b == i else b for a, b in links if i in (a, b)} for i in nodes}
    comps = pieces_of(nodes, near)
    table = spark.createDataFrame([(v, min(c)) for c in comps for v in c], "v long, comp long")
    pairs = spark.createDataFrame(sorted({(min(x), max(x)) for x in links}), "a long, b long")
    found = cuts.blocks(table, pairs)
    got = {}
    for x in cuts.pieces(found, spark.createDataFrame([(v, f) for v, (f, _) in nodes.items()], "v long, file string"), spark.createDataFrame([(b, a) for a, b in links], "v long, x long"), 2).collect():
        got.setdefault(x.v, []).append((x.size, x.other, x.called))
    want = {}
    for c in comps:
        for v in c:
            left = pieces_of(c - {v}, near)
            if len(left) >= 2:
                want[v] = sorted((len(p), any(nodes[m][0] != nodes[v][0] for m in p), any((m, v) in links for m in p)) for p in left)
    assert {v: sorted(p) for v, p in got.items()} == want
