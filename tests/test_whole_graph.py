"""Queries over the whole order graph against brute force on the smallest tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.operators import graph
from spanloom.plans import answer_queries, catalogue, graph_queries
from tests.parity import connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def edges(con, item):
    out = defaultdict(set)
    last = None
    for k, x in con.execute(f"SELECT l_orderkey, {item} FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_extendedprice, l_discount, l_tax").fetchall():
        if last and last[0] == k and last[1] != x:
            out[last[1]].add(x)
        last = k, x
    return out


def depths(out, start, most=None, stops=()):
    seen, level = {start: 0}, [start]
    while level and (most is None or seen[level[0]] < most):
        new = []
        for x in level:
            for y in out[x] if x not in stops else ():
                if y not in seen:
                    seen[y] = seen[x] + 1
                    new.append(y)
        level = new
    return seen


def got(spark, name):
    return [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()]


def nodes_of(out):
    return set(out) | {y for ys in out.values() for y in ys}


def strong(out):
    reached = {n: set(depths(out, n)) for n in nodes_of(out)}
    return {n: min(m for m in reached[n] if n in reached[m]) for n in reached}


def test_components(spark, con):
    out = edges(con, "l_partkey")
    both = defaultdict(set)
    for x, ys in list(out.items()):
        for y in ys:
            both[x].add(y)
            both[y].add(x)
    assert sorted(got(spark, "q14_components")) == sorted((n, min(depths(both, n))) for n in both)


def test_reach_states_and_entries(spark, con):
    out = edges(con, "l_suppkey")
    facts = {k: (nation, balance) for k, nation, balance in con.execute("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier").fetchall()}
    found = {s: depths(out, s, 2) for s in facts}
    assert sorted(got(spark, "q15_reach")) == sorted((s, n, d) for s in facts for n, d in found[s].items() if d)
    want = []
    for s, near in found.items():
        tests = [d + 1 for n, d in near.items() if d < 2 and any(facts[m][0] == 3 for m in out.get(n, ()))]  # the start itself, too, if it is met on a cycle
        state = "covered" if tests else "unknown" if any(d < 2 and facts[n][1] < 0 for n, d in near.items()) else "uncovered"
        want.append((s, state, min(tests, default=None)))
    assert sorted(got(spark, "q15b_reach_states")) == sorted(want)
    low = {n for n, f in facts.items() if f[0] < 5}
    assert sorted(got(spark, "q16_entries")) == sorted((s, n, d) for s in facts for n, d in depths(out, s, 3, low).items() if d and n in low)


def test_paths(spark, con):
    out, want = edges(con, "l_suppkey"), []

    def walk(path, cycle):
        want.append((">".join(map(str, path)), len(path) - 1, cycle, max(len(out[path[-1]]) - 8, 0)))
        if not cycle and len(path) <= 3:
            for y in sorted(out[path[-1]])[:8]:
                walk([*path, y], y in path)

    for (s,) in con.execute("SELECT s_suppkey FROM supplier").fetchall():
        walk([s], False)
    assert sorted(got(spark, "q17_paths")) == sorted(want)


def test_strong_components_and_roots(spark, con):
    out = edges(con, "l_partkey")
    scc = strong(out)
    assert sorted(got(spark, "q18b_strong_components")) == sorted(scc.items())
    ranks = {k: (-size, name, k) for k, size, name in con.execute("SELECT p_partkey, p_size, p_name FROM part").fetchall()}
    outward = {scc[y] for x, ys in list(out.items()) for y in ys if scc[x] != scc[y]}
    groups = defaultdict(list)
    for n, c in scc.items():
        groups[c].append(n)
    assert sorted(got(spark, "q18_roots")) == sorted((min(ns, key=ranks.get), len(ns) > 1) for c, ns in groups.items() if c not in outward)


def test_seams(spark, con):
    brand = dict(con.execute("SELECT p_partkey, p_brand FROM part").fetchall())
    pairs = defaultdict(list)
    for x, ys in edges(con, "l_partkey").items():
        for y in ys:
            if brand[x] != brand[y]:
                pairs[min(brand[x], brand[y]), max(brand[x], brand[y])].append((x, y))
    assert sorted(got(spark, "q20_seams")) == sorted((*k, len(v), " ".join(f"{x}-{y}" for x, y in sorted(v)[:3])) for k, v in pairs.items())


def test_placement_covers_every_node(spark, con, monkeypatch):
    monkeypatch.setattr(graph_queries.graph, "components", lambda e: e.limit(0).select(F.col("src").alias("node"), F.col("src").alias("component")))
    assert got(spark, "q45b_members_placed") == [(len(nodes_of(edges(con, "l_partkey"))), 0)]


@pytest.mark.parametrize("name, operator, times", [("q74_commit_split", "by_commits", 2), ("q75_hubs", "at_hubs", 1)])
def test_splits_see_every_edge(spark, con, monkeypatch, name, operator, times):
    seen = []
    monkeypatch.setattr(answer_queries.splits, operator, lambda members, links, **_: seen.append(links) or members)
    catalogue.QUERIES[name](spark, SF)
    assert seen[0].count() == times * sum(map(len, edges(con, "l_suppkey").values()))


def closure_components(edges):
    out, nodes = defaultdict(set), {x for e in edges for x in e}
    for a, b in edges:
        out[a].add(b)
    near = {n: set(depths(out, n)) for n in nodes}
    return sorted((n, min(m for m in near[n] if n in near[m])) for n in nodes)


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_of_chains_rings_and_what_hangs_on_them(spark, seed):
    r = random.Random(seed)
    edges = [(i, i + 1) for i in range(30)] + [(40 + i, 40 + (i + 1) % 9) for i in range(9)] + [(60, 41), (61, 60), (70, 70), (80, 81), (81, 82), (82, 80), (82, 90), (90, 91), (91, 81)]
    edges += [(r.randrange(100), r.randrange(100)) for _ in range(40 * seed)]
    got = graph.strong_components(spark.createDataFrame(edges, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == closure_components(edges)


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    rounds = []
    keep = graph.stored_with_count
    monkeypatch.setattr(graph, "stored_with_count", lambda df, name, c: rounds.append(name) or keep(df, name, c))
    n = 100_000
    chain = spark.range(n).select("id", (F.col("id") + 1).alias("dst")).toDF("src", "dst")
    ring = spark.range(n).select((F.col("id") + 2 * n).alias("src"), ((F.col("id") + 1) % n + 2 * n).alias("dst"))
    found = graph.strong_components(chain.union(ring))
    assert found.where("node < 150000").where("node = scc").count() == n + 1
    assert found.where(f"scc = {2 * n}").count() == n
    assert len(rounds) < 25
