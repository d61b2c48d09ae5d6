"""Operators on hand-made rows, with results worked out by hand, and properties over random inputs."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from spanloom.functions import alignment
from spanloom.functions import text as t
from spanloom.operators import evidence, graph, intervals, matching, ranking, retention, review, sets
from spanloom.sources import changes


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def spans(spark, *values):
    return spark.createDataFrame(list(values), "k int, lo int, hi int")


def test_merge_joins_overlapping_and_adjacent(spark):
    s = spans(spark, (1, 1, 3), (1, 4, 6), (1, 8, 9), (2, 5, 5), (1, 2, 2), (1, 1, 3))
    merged = intervals.merge_spans(s, ["k"])
    assert rows(merged, "k", "lo") == [(1, 1, 6), (1, 8, 9), (2, 5, 5)]
    assert rows(intervals.merge_spans(merged, ["k"]), "k", "lo") == rows(merged, "k", "lo")


def test_subtract_equals_point_sets(spark):
    r = random.Random(4)
    draw = lambda: [(r.randint(1, 4), a, a + r.randint(0, 6)) for a in [r.randint(1, 40) for _ in range(30)]]
    left, right = draw(), draw()
    points = lambda xs: {(k, p) for k, lo, hi in xs for p in range(lo, hi + 1)}
    got = rows(intervals.subtract(spans(spark, *left), spans(spark, *right), ["k"]))
    assert points(got) == points(left) - points(right)
    assert sum(hi - lo + 1 for _, lo, hi in got) == len(points(got))


def test_innermost_and_outside(spark):
    s = spark.createDataFrame([(1, 1, 10, 1), (1, 3, 5, 2), (1, 3, 5, 3)], "k int, lo int, hi int, id int")
    p = spark.createDataFrame([(1, 4), (1, 9), (1, 20)], "k int, at int")
    assert rows(intervals.innermost(p, s, ["k"]), "at") == [(1, 4, 3, 5, 2), (1, 9, 1, 10, 1), (1, 20, None, None, None)]


def test_call_sites(spark):
    sites = spark.createDataFrame([(1, 1, 5, 6), (1, 2, 9, 9), (1, 3, None, None)], "k int, site int, lo int, hi int")
    got = intervals.site_states(sites, spans(spark, (1, 6, 7)), ["k"])
    assert {(r.site, r.state) for r in got.collect()} == {(1, "updated"), (2, "untouched"), (3, "unknown")}


def test_nearest_line_prefers_the_earlier(spark):
    w = spark.createDataFrame([(1, 10), (2, 10)], "k int, preferred int")
    assert rows(intervals.nearest_line(w, spans(spark, (1, 1, 8), (1, 12, 20)), ["k"]), "k") == [(1, 10, 8), (2, 10, None)]


def test_full_outer_match(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "key string, d string")
    head = spark.createDataFrame([("b", "2"), ("c", None), ("e", "1")], "key string, d string")
    got = {r.key: r.status for r in matching.match_sides(base, head, ["key"], "d").collect()}
    assert got == {"a": "deleted", "b": "changed", "c": "same", "e": "added"}


def test_greedy_moves_first_candidate_wins_ties(spark):
    c = spark.createDataFrame([("n", 1, 10, 6, 10), ("n", 1, 11, 3, 5), ("n", 2, 10, 9, 10), ("n", 2, 11, 6, 10)], "g string, left_id long, right_id long, common int, total int")
    assert [(r.left_id, r.right_id) for r in matching.greedy_moves(c, ["g"]).orderBy("left_id").collect()] == [(1, 10), (2, 11)]


def test_similar_pairs_and_members_give_every_link(spark):
    r = random.Random(3)
    data = [(i, r.sample("abcdef", r.randint(0, 5))) for i in range(50)]
    df = spark.createDataFrame(data, "id long, tokens array<string>")
    of = {x.id: x.representative for x in sets.set_members(df).collect()}
    pairs = {(x.a, x.b) for x in sets.similar_sets(df, 60).collect()}
    words = {i: set(w) for i, w in data if w}
    assert set(of) == set(words)
    for a in words:
        for b in words:
            link = of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in pairs
            assert link == (len(words[a] & words[b]) * 100 >= len(words[a] | words[b]) * 60), (a, b)


def test_similar_sets_equal_brute_force(spark):
    r = random.Random(2)
    data = [(i, r.sample("abcdefghij", r.randint(0, 6))) for i in range(60)]
    got = {(x.a, x.b) for x in sets.similar_sets(spark.createDataFrame(data, "id long, tokens array<string>"), 60).collect()}
    first = {}
    for i, w in data:
        if w:
            first.setdefault(frozenset(w), i)
    want = {(min(i, j), max(i, j)) for x, i in first.items() for y, j in first.items() if i < j and len(x & y) * 100 >= len(x | y) * 60}
    assert got == want


def test_contained_equals_brute_force(spark):
    r = random.Random(3)
    draw = lambda n: [(i, sorted(set(r.choices("abcdefghijkl", k=r.randint(1, 8))))) for i in range(n)]
    a, b = draw(20), draw(40)
    make = lambda d: spark.createDataFrame(d, "id long, tokens array<string>")
    got = {(x.small_id, x.large_id) for x in sets.contained(make(a), make(b), 80).collect()}
    assert got == {(i, j) for i, x in a for j, y in b if len(set(x) & set(y)) * 100 >= min(len(x), len(y)) * 80}


def test_new_throws_allows_reworded_ones(spark):
    schema = "f string, k string, x string"
    base = spark.createDataFrame([("f", "E", "E(a)")], schema)
    head = spark.createDataFrame([("f", "E", "E(b)"), ("f", "E", "E(c)"), ("f", "G", "G()"), ("g", "E", "E(x)")], schema)
    # one of two new texts is the old one reworded; which cannot be told, so both are reported
    assert sorted(r.x for r in sets.new_throws(base, head, ["f"], "k", "x", base).collect()) == ["E(b)", "E(c)", "G()"]
    reworded = head.where("x = 'E(b)'")
    assert sets.new_throws(base, reworded, ["f"], "k", "x").count() == 0
    keys = spark.createDataFrame([("new a.Error('x')",), ("fail<T>(x)",), ("err",), ("new  X",)], "x string").select(t.throw_key(F.col("x")))
    assert [r[0] for r in keys.collect()] == ["new a.Error", "fail(…)", "err", "new X"]


def test_placement_errors(spark):
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id int")
    assert {tuple(r) for r in sets.placement_errors(ids(1, 2, 3), ids(1, 3, 3, 4), "id").collect()} == {(2, "missing"), (4, "unknown"), (3, "duplicate")}


def edges(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src string, dst string")


def test_components_and_order_of_rows(spark):
    e = edges(spark, "ab bc de fe gg hi ij jk kl lm")
    want = {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "d", "g": "g", **dict.fromkeys("hijklm", "h")}
    assert dict(rows(graph.components(e))) == want
    assert dict(rows(graph.components(e.orderBy(F.desc("src"))))) == want


def test_components_have_small_plans_and_compute_edges_once(spark, monkeypatch):
    """Each round was one plan of about forty scans, which filled the driver; the edges were computed again for the result."""
    scans, made = [], spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def noted(df, name, stored=graph.stored):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return stored(df, name)

    monkeypatch.setattr(graph, "stored", noted)
    pairs = spark.range(0, 90, 1, 1).selectExpr("id AS src", "id + 1 + id % 3 AS dst").where("src % 10 < 7").mapInArrow(counted, "src long, dst long")
    got = {x.node: x.component for x in graph.components(pairs).collect()}
    assert made.value == 63 and len(scans) > 4 and max(scans) < 8, (made.value, scans)
    label = {n: n for n in range(92)}
    for i in [i for i in range(90) if i % 10 < 7] * 90:
        label[i] = label[i + 1 + i % 3] = min(label[i], label[i + 1 + i % 3])
    assert got == {n: label[n] for n in got} and set(got) == {n for i in range(90) if i % 10 < 7 for n in (i, i + 1 + i % 3)}


def test_components_with_hubs_loops_and_nulls(spark, monkeypatch):
    """Hubs, which are broadcast, beside loops at nodes with and without other edges; an end that is null is left out."""
    monkeypatch.setattr(graph, "_HUBS", 3)
    pairs = [(1000, i) for i in range(500)] + [(2000 + i, 3000) for i in range(300)] + [(7, 7), (5000, 5000), (3000, 3000), (None, 5001), (None, None)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys([1000, *range(500)], 0), **dict.fromkeys([3000, *range(2000, 2300)], 2000), 5000: 5000, 5001: 5001}


def test_components_of_chains_and_stars(spark):
    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(300, 340)] + [(5, 5), (400, 401), (401, 400)]
    r.shuffle(pairs)
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = {**dict.fromkeys(range(61), 0), **dict.fromkeys([200, *range(300, 340)], 200), 400: 400, 401: 400}
    assert got == want


def test_reach_uses_the_shortest_depth(spark):
    starts = spark.createDataFrame([("R",)], "start string")
    assert {(r.node, r.depth) for r in graph.reach(starts, edges(spark, "RA RB AB BX"), 2).collect()} == {("A", 1), ("B", 1), ("X", 2)}


@pytest.mark.parametrize("tests,open_,depth,want", [("T", "", 3, "covered"), ("", "B", 2, "unknown"), ("", "B", 1, "uncovered"), ("", "", 2, "uncovered")])
def test_reach_states(spark, tests, open_, depth, want):
    facts = spark.createDataFrame([(n, n in tests, n not in open_) for n in "ABT"], "node string, is_test boolean, complete boolean")
    starts = spark.createDataFrame([("R",)], "start string")
    assert graph.reach_states(starts, edges(spark, "RA RB BC CT AT"), facts, depth).first().state == want


def test_roots_promote_one_of_a_cycle(spark):
    # b calls a (a -> b); c and d call each other and nothing else; e calls c
    ranks = spark.createDataFrame([(n, s, n) for n, s in zip("abcde", (1, 1, 5, 9, 1), strict=True)], "node string, score int, label string")
    assert {tuple(r) for r in graph.roots(edges(spark, "ab cd dc ce"), ranks).collect()} == {("a", False), ("d", True)}


def test_chains(spark):
    a = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "name string, target string")
    assert {(r.name, r.target) for r in graph.resolved(a, 6).collect()} == {("a", "c"), ("b", "c"), ("x", None), ("y", None)}


def test_path_tree_cuts_cycles_and_children(spark):
    starts = spark.createDataFrame([("a",)], "start string")
    got = {("".join(r.path), r.cycle, r.more) for r in graph.path_tree(starts, edges(spark, "ab ba ac ad"), 3, 2).collect()}
    assert got == {("a", False, 1), ("ab", False, 0), ("ac", False, 0), ("aba", True, 1)}


def test_severity(spark):
    df = spark.createDataFrame([(["optional-param", "body"], 1), (["body"], 1), (["body"], 0), (["new-throw"], 30)], "kinds array<string>, stale int")
    assert [r[0] for r in df.select(evidence.severity(F.col("kinds"), F.col("stale"))).collect()] == [72, 12, 10, 100]


def test_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 5), ("g", 2, 6), ("g", 3, 1)], "g string, o int, size int")
    assert [r.o for r in ranking.within_budget(df, ["g"], ["o"], "size", 10).collect()] == [1]


def test_upper_median(spark):
    df = spark.createDataFrame([("g", v) for v in (5.0, 1.0, 3.0, 9.0)], "g string, v double")
    assert ranking.upper_median(df, ["g"], "v").first().median == 5.0


def test_page_and_wrap(spark):
    df = spark.createDataFrame([("g", i) for i in range(1, 8)], "g string, id int")
    assert [(r.id, r.position, r.total, r.pages) for r in ranking.page(df, [F.col("id")], 2, 3).orderBy("id").collect()] == [(4, 4, 7, 3), (5, 5, 7, 3), (6, 6, 7, 3)]
    around = {r.id: (r.previous_id, r.next_id) for r in ranking.neighbours(df, ["g"], ["id"], "id").collect()}
    assert around[1] == (7, 2) and around[7] == (6, 1)


def test_ages_are_strict(spark):
    df = spark.createDataFrame([(0,), (1,)], "c long")
    assert [r[0] for r in df.select(retention.older_than(F.col("c"), F.lit(10), 9)).collect()] == [True, False]


def test_cleanup_rules(spark):
    day = 86_400_000
    schema = "id int, sha string, round int, branch string, created_ms long"
    now = 100 * day
    s = spark.createDataFrame([
        (1, "c", None, "x", 0), (2, "r", None, "x", now - 3_600_001), (3, "n", None, "x", now - 3_600_000), (4, "a", 4, "gone", now - 2 * day), (5, "b", 3, "x", now - 3 * day),
        (6, "d", 2, "x", now - 31 * day), (7, "e", 2, "gone", now - 4 * day), (8, "f", 1, None, now - 30 * day), (9, "g", 1, "x", now - 30 * day)], schema)
    live = spark.createDataFrame([("x",)], "branch string")
    got = {r.id: r.reason for r in retention.cleanup_plan(s, live, now_ms=now, current="c").collect()}
    # the newest rounds stay though their branch is gone; age comes before the branch; exactly as old as the limit is not older
    assert got == {1: "current", 2: "replaced", 3: "just replaced", 4: "newest", 5: "newest", 6: "too old", 7: "branch gone", 8: "kept", 9: "kept"}
    unknown = {r.id: (r.action, r.reason) for r in retention.cleanup_plan(s, None, now_ms=now, current="c", include_current=True).collect()}
    assert unknown[7] == ("keep", "kept") and unknown[1] == ("delete", "current")
    keys = spark.createDataFrame([("k1", "gone", None), ("k2", "x", 0), ("k3", None, now - 90 * day), ("k4", "gone", 0)], "key string, branch string, last_used_ms long")
    assert {r.key: r.reason for r in retention.key_plan(keys, live, now_ms=now, active="k4").collect()} == {"k1": "branch gone", "k2": "unused", "k3": "kept", "k4": "active"}


def test_verdicts(spark):
    cases = [(True, 1, True, "resolved", 0), (True, 0, True, "none", 2), (True, 0, False, "resolved", 1), (True, 0, None, "di", 1), (True, 0, None, "resolved", 2), (False, 0, True, "none", 4), (False, 0, False, "none", 3), (False, 0, True, "unknown", 3), (False, 3, True, "resolved", 3)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "risky boolean, stale int, complete boolean, state string, want int, i int")
    got = df.select("want", review.verdict_level(*[F.col(c) for c in ("risky", "stale", "complete", "state")]).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_statuses_and_agreement(spark):
    lines = ["", "  **done**, thanks", "donefor", "Skipped - *no need*", "skipped", "__skipped__: x", "maybe"]
    got = [tuple(r.s) for r in spark.createDataFrame([(x,) for x in lines], "x string").select(t.status_line(F.col("x")).alias("s")).collect()]
    assert got == [("none", None), ("done", None), ("unreadable", "unrecognised status: donefor"), ("skipped", "*no need"), ("skipped", None), ("unreadable", "unrecognised status: skipped__: x"), ("unreadable", "unrecognised status: maybe")]
    said = spark.createDataFrame([(1, "none", None), (1, "done", None), (2, "skipped", "a"), (2, "skipped", "b"), (3, "skipped", "a"), (3, "skipped", "a"), (4, "none", None), (5, "unreadable", "x"), (6, "unreadable", "x"), (6, "unreadable", "x")], "g int, status string, reason string")
    assert {r.g: (r.status, r.reason) for r in review.agreed(said, ["g"], "status", "reason").collect()} == {
        1: ("done", None), 2: ("unreadable", "conflicting status lines"), 3: ("skipped", "a"), 4: ("none", None), 5: ("unreadable", "x"), 6: ("unreadable", "conflicting status lines")}


def test_settled_records(spark):
    rows = [(i, 0, f"g{i % 2}", "a b → c", None) for i in range(5)] + [(i, 1, f"g{i % 2}", f"x{i} → y", "$ → true") for i in range(5)]
    rows += [(5, 0, "g0", "a b → c", "$ → true"), (5, 0, "g0", None, "$ → true"), (6, 0, "g0", "→ )", None)] + [(i, 2, f"g{i % 2}", "→ )", None) for i in range(5)]
    df = spark.createDataFrame(rows, "item int, record int, grp string, lit string, shape string")
    got = {(r.item, r.record): r.level for r in evidence.settled_keys(df, "item", "record", "lit", "shape", "grp").collect()}
    # `→ )` repeats but says nothing; a record with one key that does not repeat falls back to its shape
    assert got == {**{(i, 0): "literal" for i in range(5)}, **{(i, 1): "shape" for i in range(5)}, (5, 0): "shape", (6, 0): None, **{(i, 2): None for i in range(5)}}


def test_commits_say_little_or_are_broad(spark):
    df = spark.createDataFrame([("chore: bump all deps",), ("docs fix two words",), ("add it",), ("reverts nothing at all",), (None,), ("Lint everything once more",)], "s string")
    assert [r[0] for r in df.select(evidence.weak_commit(F.col("s"))).collect()] == [True, True, True, False, True, True]
    assert [r[0] for r in spark.createDataFrame([(6, 10), (5, 10), (6, 9), (6, None)], "a int, b int").select(evidence.broad_commit(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_merge_states(spark):
    pull = "number int, state string, loaded boolean, is_draft boolean, mergeable string, merge_status string, review_decision string, checks_read boolean, queue boolean, head_moved boolean"
    rows = [(1, "MERGED", False, None, None, None, None, None, None, None), (2, "OPEN", False, None, None, None, None, None, None, None), (3, "OPEN", True, True, "MERGEABLE", "BLOCKED", None, True, False, True),
            (4, "OPEN", True, False, "CONFLICTING", "CLEAN", None, True, False, False), (5, "OPEN", True, False, "UNKNOWN", "CLEAN", None, True, False, False), (6, "OPEN", True, False, "MERGEABLE", "BLOCKED", "REVIEW_REQUIRED", True, False, False),
            (7, "OPEN", True, False, "MERGEABLE", "BLOCKED", None, False, True, False), (8, "OPEN", True, False, "MERGEABLE", "BEHIND", None, True, False, False), (9, "OPEN", True, False, "MERGEABLE", "CLEAN", None, True, False, False)]
    checks = spark.createDataFrame([(6, "lint", "pending", True, 0), (6, "test", "failed", True, 1), (6, "extra", "failed", False, 2)], "number int, name string, state string, required boolean, ord int")
    got = {r.number: (r.tone, r.reasons, r.retry) for r in review.merge_state(spark.createDataFrame(rows, pull), checks).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "done", 2: "unknown", 3: "blocked", 4: "conflict", 5: "unknown", 6: "blocked", 7: "blocked", 8: "blocked", 9: "clean"}
    assert got[6][1] == ["Required check test failed", "Required check lint has not finished", "An approving review is required"]
    assert got[7][1] == ["The required checks could not all be read", "Merge through the queue"] and got[2][2] and got[5][2] and not got[9][2] and len(got[3][1]) == 2


def test_owners_of_ranges_and_gaps(spark):
    spans_ = spark.createDataFrame([("f", 1, 2, 40), ("f", 2, 6, 12), ("f", 3, 20, 20), ("f", 4, 22, 22)], "path string, id int, lo int, hi int")  # doubled lines
    ranges = spark.createDataFrame([("f", 8, 10), ("f", 20, 22), ("f", 13, 13), ("f", 7, 7), ("f", 21, 21), ("f", 2, 40), ("f", 60, 70), ("f", 41, 41)], "path string, lo int, hi int")
    got = {}
    for r in intervals.owners_of_ranges(ranges, spans_, ["path"]).collect():
        got.setdefault((r.lo, r.hi), set()).add(r.id)
    # a gap belongs to a span that holds both neighbours, not to one that ends before or begins after it
    assert got == {(8, 10): {2}, (20, 22): {3, 4}, (13, 13): {1}, (7, 7): {2}, (21, 21): {1}, (2, 40): {1, 2, 3, 4}}


def test_one_key_with_many_spans(spark):
    """A hundred thousand spans under one key: what is compared is near each other, not all pairs."""
    many = spark.range(100_000).select(F.lit(1).alias("k"), (F.col("id") * 10).cast("int").alias("lo"), (F.col("id") * 10 + F.col("id") % 15).cast("int").alias("hi"), F.col("id").cast("int").alias("id"))
    points = spark.range(50_000).select(F.lit(1).alias("k"), (F.col("id") * 20 + 3).cast("int").alias("at"))
    found = intervals.innermost(points, many, ["k"])
    assert found.count() == 50_000
    want = sum(1 for i in range(50_000) if any(10 * j <= 20 * i + 3 <= 10 * j + j % 15 for j in (2 * i, 2 * i - 1) if j >= 0))
    assert found.where("id IS NOT NULL").count() == want
    assert intervals.site_states(points.select("k", F.col("at").alias("lo"), F.col("at").alias("hi")), many, ["k"]).where("state = 'updated'").count() == want
    assert intervals.nearest_line(points.withColumnRenamed("at", "preferred"), many, ["k"]).count() == 50_000


def test_joins_of_points_and_spans_equal_brute_force(spark):
    r = random.Random(12)
    left = [(r.randint(1, 2), a, a + r.choice([0, 1, 3, 40])) for a in [r.randint(-20, 60) for _ in range(40)]]
    right = [(r.randint(1, 2), a, a + r.choice([0, 2, 9, 70])) for a in [r.randint(-20, 60) for _ in range(25)]]
    got = {tuple(x) for x in intervals.overlapping(spans(spark, *left), spans(spark, *right), ["k"], tolerance=2).collect()}
    assert got == {x for x in left if any(x[0] == y[0] and x[1] <= y[2] + 2 and x[2] >= y[1] - 2 for y in right)}
    leaves = {tuple(x) for x in intervals.holders_without_smaller(spans(spark, *right), ["k"]).collect()}
    assert leaves == {x for x in right if not any(x[0] == y[0] and y[1] >= x[1] and y[2] <= x[2] and y[2] - y[1] < x[2] - x[1] for y in right)}
    wanted = [(k, p) for k in (1, 2, 3) for p in range(-30, 140, 7)]
    near = {(x.k, x.preferred): x.line for x in intervals.nearest_line(spark.createDataFrame(wanted, "k int, preferred int"), spans(spark, *right), ["k"]).collect()}
    for k, p in wanted:
        lines = [min(max(p, lo), hi) for q, lo, hi in right if q == k]
        assert near[k, p] == min(lines, key=lambda x: (abs(x - p), x), default=None)


def test_moves_need_class_name_and_likeness(spark):
    schema = "id long, path string, class_name string, name string, tokens array<string>"
    deleted = spark.createDataFrame([(1, "a/x.ts", "C", "f", list("abcdef")), (2, "b/y.ts", None, "g", None), (3, "c.ts", "C", "f", list("abcdef")), (4, "d/z.ts", None, "h", list("ab"))], schema)
    added = spark.createDataFrame([(10, "n/x.ts", "C", "f", list("abcdxy")), (11, "m.ts", "C", "f", list("abcde")), (12, "q/y.ts", "", "g", ["t"]), (13, "q/w.ts", "", "g", ["t"]), (14, "e/z.ts", None, "h", list("xy")), (15, "a/x.ts", "C", "f", list("abcdef"))], schema)
    got = {(r.left_id, r.right_id) for r in matching.symbol_moves(deleted, added).collect()}
    assert got == {(1, 11), (3, 15), (2, 12)}


def test_states_after_a_filter(spark):
    before = spark.createDataFrame([(1, True), (2, False), (3, True)], "id int, complete boolean")
    got = {r.id: r.state for r in review.rederived_state(before, spark.createDataFrame([(3,)], "id int"), "id").collect()}
    assert got == {1: "none", 2: "unknown", 3: "resolved"}


def test_folders(spark):
    f = spark.createDataFrame([("a/b/x", 2, 1), ("a/y", 1, 0), ("z", 0, 5)], "path string, level int, attention int")
    assert {tuple(r) for r in review.folder_rollup(f).collect()} == {("a", 2, 1, 1), ("a/b", 1, 2, 1)}


def test_text_functions(spark):
    df = spark.createDataFrame([Row(s='f(a, "x y")  + 1.5', l="**Skipped — not needed**", p="src/a/b.ts", n=1536)])
    got = df.select(t.tokens(F.col("s")).alias("k"), t.status_line(F.col("l")).alias("st"), t.tail(F.col("p")).alias("tail"), t.formatted_bytes(F.col("n")).alias("b"), t.utf16_length(F.lit("😀a")).alias("u")).first()
    assert got.k == ["f", "(", "a", ",", '"x y"', ")", "+", "1.5"] and tuple(got.st) == ("skipped", "not needed")
    assert got.tail == "a/b.ts" and got.b == "2 KB" and got.u == 3


def test_token_edits():
    assert alignment.edits(["interface", "{", "}"], ["any"]) == [{"removed": ["interface", "{", "}"], "added": ["any"]}]
    assert alignment.edits(list("a(x)"), list("a(x,c)")) == [{"removed": [], "added": [",", "c"]}]
    assert alignment.edits([f"x{i}" for i in range(600)], [f"y{i}" for i in range(600)]) is None
    r = random.Random(1)
    for _ in range(200):
        a, b = [r.choices("abc", k=r.randint(0, 9)) for _ in range(2)]
        found = alignment.edits(a, b)
        kept = len(a) - sum(len(e["removed"]) for e in found)
        assert kept == len(b) - sum(len(e["added"]) for e in found)
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert kept == table[-1][-1]


def test_parameter_costs():
    assert alignment.parameter_cost(["a", "b"], ["a", "c", "b"]) == 1
    assert alignment.parameter_cost(["a"], ["b"]) == 1


def test_signature_kinds(spark):
    p = lambda name, type_="T", optional=False, rest=False, default=None: {"name": name, "type": type_, "optional": optional, "rest": rest, "default": default}
    sig = lambda *params, returns=None, async_=False: {"params": list(params), "returns": returns, "async": async_}
    cases = [
        (sig(p("a"), p("b")), sig(p("a"), p("c"), p("b")), ["required-param"]), (sig(p("a")), sig(p("a"), p("b", optional=True)), ["optional-param"]), (sig(p("a")), sig(p("a"), p("r", rest=True)), ["optional-param"]),
        (sig(p("a"), p("b")), sig(p("b")), ["param-removed"]), (sig(p("a")), sig(p("z")), []), (sig(p("a")), sig(p("a", "U", True)), ["type-changed", "optional-param-changed"]),
        (sig(p("a", optional=True)), sig(p("a")), ["required-param"]), (sig(p("a", default="1")), sig(p("a", default="2")), ["default-changed"]), (sig(p("a", default="1")), sig(p("a")), []),
        (sig(returns="A"), sig(returns="B", async_=True), ["async-changed", "return-changed"]), (sig(returns=""), sig(), []), (None, sig(p("a")), [])]
    for base, head, want in cases:
        assert alignment.signature_changes(base, head) == want, (base, head)
    shape = "struct<params:array<struct<name:string,type:string,optional:boolean,rest:boolean,default:string>>,returns:string,async:boolean>"
    df = spark.createDataFrame([(i, b, h) for i, (b, h, _) in enumerate(cases)], f"i int, base {shape}, head {shape}")
    assert [r.k for r in df.select("i", alignment.signature_kinds("base", "head").alias("k")).orderBy("i").collect()] == [w for *_, w in cases]
    shown = df.where("i = 5").select(t.signature(F.col("head.params"), F.col("head.returns")).alias("s")).first().s
    assert shown == "(a?: U)"


def test_globs_also_match_below():
    import re

    hit = lambda g, path: bool(re.search(t.glob_regex(g), path))
    assert hit("src", "src/a/b.py") and hit("src/", "src") and not hit("src", "src2/a") and hit("**/test_*", "a/b/test_x/c.py") and hit("a/**", "a/b/c")
    assert hit(".", "x") and hit("./a?c", "abc/d") and not hit("a*c", "a/c") and hit("a.b", "a.b") and not hit("a.b", "axb") and not hit("b", "a/b")


def test_pages(spark):
    df = spark.createDataFrame([(i, "x" * 10) for i in range(1, 8)], "id int, s string")
    assert [r.pages for r in ranking.page_count(df.limit(0)).collect()] == [1]
    with pytest.raises(ValueError, match="page size"):
        ranking.page(df, [F.col("id")], 1, 201)
    with pytest.raises(ValueError, match="page must be"):
        ranking.page(df, [F.col("id")], 0)
    got = ranking.page(df, [F.col("id")], 2, 4, text=F.col("s"), most_chars=25).collect()  # four rows of ten characters do not fit, two do
    assert [(r.id, r.page_size, r.pages) for r in got] == [(3, 2, 4), (4, 2, 4)]


def test_next_unreviewed_wraps_once(spark):
    df = spark.createDataFrame([("g", i, i in (2, 3, 5)) for i in range(1, 6)] + [("h", 9, False)], "g string, id int, done boolean")
    got = {r.id: (r.previous_id, r.next_id) for r in ranking.next_unreviewed(df, ["g"], ["id"], "id", "done").collect()}
    assert got == {1: (4, 4), 2: (1, 4), 3: (1, 4), 4: (1, 1), 5: (4, 1), 9: (None, None)}


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -2,2 +2,1 @@ def f
-old
-@@ -9,9 +9,9 @@
+new
@@ -7,1 +5,0 @@
-gone
diff --git a/y.py b/y.py
--- /dev/null
+++ b/y.py
@@ -0,0 +1,2 @@
+a
+b
"""


def test_hunks_take_bodies_by_count(spark):
    hunks = changes.hunks(spark.createDataFrame([("r", DIFF)], "run_id string, text string"))
    got = [(r.path, r.hunk_no, r.removed, r.added) for r in hunks.orderBy("path", "hunk_no").collect()]
    assert got == [("x.py", 0, ["old", "@@ -9,9 +9,9 @@"], ["new"]), ("x.py", 1, ["gone"], []), ("y.py", 0, [], ["a", "b"])]
    assert [(r.path, r.lo, r.hi) for r in changes.changed_ranges(hunks).orderBy("path", "lo").collect()] == [("x.py", 4, 4), ("x.py", 11, 11), ("y.py", 2, 4)]


def test_patch_with_context_gives_the_same_ranges(spark):
    """A patch with context lines marks the same places as the diff without."""
    patch = "@@ -1,8 +1,6 @@\n one\n-old\n-older\n+new\n four\n five\n six\n-gone\n eight"
    got = changes.patch_ranges(spark.createDataFrame([("r", "x.py", patch), ("r", "b.bin", None)], "run_id string, path string, patch string"))
    assert {(r.path, r.known, r.lo, r.hi) for r in got.collect()} == {("x.py", True, 4, 4), ("x.py", True, 11, 11), ("b.bin", False, None, None)}


def test_name_status(spark):
    text = "M\0a.py\0R087\0b.py\0c.py\0C100\0d\0e\0D\0f\0"
    got = changes.changed_files(spark.createDataFrame([("r", text)], "run_id string, text string"))
    assert [(r.path, r.old_path, r.status, r.similarity) for r in got.orderBy("ord").collect()] == [("a.py", None, "modified", None), ("c.py", "b.py", "renamed", 87), ("e", None, "added", 100), ("f", None, "deleted", None)]


def test_commits_tell_what_was_cut(spark):
    log = "\x01s1\x02first\na\nb\n\x01s2\x02second\nc\n"
    df = spark.createDataFrame([("r", log)], "run_id string, text string")
    assert [(r.sha, r.files, r.truncated) for r in changes.commits(df).orderBy("ord").collect()] == [("s1", ["a", "b"], False), ("s2", ["c"], False)]
    assert [r.truncated for r in changes.commits(df, 1).collect()] == [True]


def test_bad_records_carry_reasons(spark):
    good, bad = changes.valid_and_rejected(spark.createDataFrame([(1, "x"), (None, "")], "id int, name string"), {"id": "id IS NOT NULL", "name": "name <> ''"})
    assert good.count() == 1 and bad.first().reasons == ["id", "name"]


def test_unquoted_paths():
    assert changes.unquoted('"a\\303\\251\\t\\"b"') == 'aé\t"b' and changes.unquoted("plain") == "plain"


def test_viewed_sync_stream(spark, tmp_path):
    from spanloom.streaming import sync

    events = [("a", "local", True), ("b", "remote", True), ("c", "local", True), ("c", "remote", True)]
    spark.createDataFrame(events, "key string, side string, viewed boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, side string, viewed boolean").parquet(str(tmp_path / "in"))
    query = sync.viewed_sync(stream).writeStream.format("memory").queryName("synced").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.key, r.action) for r in spark.table("synced").collect()} == {("a", "write"), ("b", "take"), ("c", "settled")}
