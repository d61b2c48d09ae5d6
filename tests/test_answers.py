"""Answers, splits and source lines on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from spanloom.functions import code
from spanloom.operators import filters, splits
from spanloom.plans import answers


@pytest.fixture(scope="module")
def review(spark):
    cards = spark.createDataFrame([("K1", "prices", "card"), ("K2", "rest", "card")], "id string, label string, kind string")
    members = spark.createDataFrame([("K1", "a", 0), ("K1", "b", 1), ("K2", "c", 0)], "card string, change string, ord int")
    changes = spark.createDataFrame(
        [("a", "Q.quoteFor", "x.ts", 1, 20, ["optional-param"], "f()", "f(a)", 72, True, None, False), ("b", "inner", "x.ts", 5, 8, ["body"], "g", "g", 10, False, "timed out", False), ("c", "old", "y.ts", 1, 2, ["body"], "h", None, 10, True, None, True)],
        "id string, label string, path string, start_line int, end_line int, kinds array<string>, base_sig string, head_sig string, score int, callers_complete boolean, reason string, deleted boolean")
    callers = spark.createDataFrame([("a", "z.ts", 4, "buildInvoice", False, "unchanged"), ("a", "z.ts", 9, "createOrder", False, "updated-at-call"), ("a", "t.ts", 1, "test", True, "unchanged")], "change string, path string, line int, label string, is_test boolean, call_state string")
    lines = spark.createDataFrame([("head", "x.ts", i, f"line {i} call(foo{i})") for i in range(1, 501)] + [("head", "z.ts", 4, "return quoteFor(1)"), ("base", "x.ts", 1, "quoteFor")], "side string, path string, line int, text string")
    return cards, members, changes, callers, lines


def test_cards(spark, review):
    cards, members, changes, callers, _ = review
    got = answers.list_cards(cards, members, changes, callers).orderBy("position").collect()
    assert [(r.id, r.members, r.callers, r.stale, r.tests, r.risky, r.incomplete) for r in got] == [("K1", 2, 2, 1, 1, 1, 1), ("K2", 1, 0, 0, 0, 0, 0)]
    assert [r.id for r in answers.get_card("K1", members, changes).orderBy("position").collect()] == ["a", "b"]


def test_changes_tell_why_they_are_incomplete(spark, review):
    _, _, changes, callers, _ = review
    row = lambda c: answers.get_change(c, changes, callers).first()
    assert (row("a").callers, row("a").stale, row("a").complete, row("a").reasons) == (2, 1, True, [])
    assert row("b").reasons == ["timed out"] and not row("c").complete and "deleted" in row("c").reasons[0]


def test_callers_of_the_innermost_change(spark, review):
    _, _, changes, callers, _ = review
    assert [r.label for r in answers.callers_of("x.ts", 2, changes, callers).collect()] == ["buildInvoice", "createOrder", "test"]
    assert answers.callers_of("x.ts", 6, changes, callers).count() == 0
    assert answers.callers_of("x.ts", 6, changes, callers, "quoteFor").count() == 3


def test_source_search_and_evidence(spark, review):
    *_, lines = review
    got = answers.get_source(lines, "x.ts", 10, 600)
    assert got.count() == 400 and got.first().cut and not answers.get_source(lines, "x.ts", 1, 3).first().cut
    hits = answers.search_code(lines, "call(foo1)")
    assert hits.count() == 1 and not hits.first().capped and answers.search_code(lines, "call", most=5).first().capped
    assert {(r.path, r["lines"]) for r in answers.list_files(lines).collect()} == {("x.ts", 500), ("z.ts", 1)}
    claims = spark.createDataFrame([("z.ts", 5, "quoteFor"), ("z.ts", 6, "quoteFor"), ("z.ts", 4, "quote")], "path string, line int, callee string")
    assert {(r.line, r.callee): r.ok for r in answers.check_evidence(claims, lines).collect()} == {(5, "quoteFor"): True, (6, "quoteFor"): False, (4, "quote"): False}


def test_validation_and_submission(spark):
    answer = spark.createDataFrame([("1", "T", "a"), ("2", " ", "a"), ("2", " ", "z")], "card string, title string, change string")
    required = spark.createDataFrame([("a",), ("b",)], "change string")
    assert {tuple(r) for r in answers.validate_cards(answer, required).collect()} == {("a", "duplicate"), ("b", "missing"), ("z", "unknown"), ("2", "no title")}
    schema = "head string, kind string, payload string, stored_at long, ord int, digest string"
    store = answers.submitted(spark.createDataFrame([], schema), spark.createDataFrame([("h", "cards", "p", 5, 1), ("h", "cards", "q", 5, 2)], schema.rsplit(",", 1)[0]))
    again = answers.submitted(store, spark.createDataFrame([("h", "cards", "p", 9, 3)], schema.rsplit(",", 1)[0]))
    assert again.count() == 2 and answers.latest(again).first().payload == "q"


def test_folder_split(spark):
    m = spark.createDataFrame([(1, i, p) for i, p in enumerate(["a/b/c/1", "a/b/2", "a/b/3", "a/d/4", "a/5", "e/6", "7"])], "grp int, id int, path string")
    got = {r.id: r.part for r in splits.by_folder(m, 2).collect()}
    assert got == {0: "a/b", 1: "a/b", 2: "a/b", 3: "a", 4: "a", 5: "", 6: ""}
    assert {r.part for r in splits.by_folder(m, 4).collect()} == {"a", ""}


def test_commit_split(spark):
    m = spark.createDataFrame([(1, i, c) for i, c in enumerate([["x"], ["x"], ["x"], ["y"], ["y"], []])] + [(2, i + 10, ["z"]) for i in range(6)], "grp int, id int, commits array<string>")
    e = spark.createDataFrame([(5, 3), (3, 5), (5, 0), (0, 5), (5, 4), (4, 5)], "src int, dst int")
    got = {r.id: r.part for r in splits.by_commits(m, e).collect()}
    assert [got[i] for i in range(6)] == [1, 1, 1, 2, 2, 2] and {got[i] for i in range(10, 16)} == {None}


def test_hub_split(spark):
    m = spark.createDataFrame([(1, 0, "hub.ts", 5)] + [(1, i, f"f{(i - 1) // 2}.ts", 1) for i in range(1, 7)] + [(1, 7, "hub.ts", 1)], "grp long, id long, path string, score int")
    e = spark.createDataFrame([(1, 0), (1, 2), (3, 0), (3, 4), (5, 0), (5, 6), (7, 0)], "src long, dst long")  # the hub calls 1, 3, 5 and 7
    got = {r.id: (r.part, r.role) for r in splits.at_hubs(m, e).collect()}
    assert got == {0: (0, "hub"), 7: (0, "absorbed"), 1: (1, "member"), 2: (1, "member"), 3: (3, "member"), 4: (3, "member"), 5: (5, "member"), 6: (5, "member")}


def test_code_lines(spark):
    text = 'a(1) // b(2)\n/* c(3)\nd(4) */ e(5)\nf("g(6)", `h(7)`)\nfunction own(x) {'
    got = {r.line: r.calls for r in code.code_lines(spark.createDataFrame([("x.ts", text), ("y.py", "k() # l()\ndef m(): n()")], "path string, text string")).where("path = 'x.ts'").collect()}
    assert got == {1: ["a"], 2: [], 3: ["e"], 4: ["f"], 5: []}
    py = code.code_lines(spark.createDataFrame([("y.py", "k() # l()\ndef m(): n()")], "path string, text string"))
    assert [r.calls for r in py.orderBy("line").collect()] == [["k"], ["n"]]


def test_call_changes(spark):
    side = lambda *xs: spark.createDataFrame([("f", i, x) for i, x in enumerate(xs)], "fn string, line int, calls array<string>")
    r = code.call_changes(side(["a", "b"], ["c"]), side(["b"], ["d", "a2"]), ["fn"]).first()
    assert (r.added, r.removed, r.added_more) == (["d", "a2"], ["a", "c"], 0)


def test_bitmap_reduction_decides_nothing(spark):
    df = spark.createDataFrame([(i if i % 7 else None, i) for i in range(200)], "k long, v int")
    keys = spark.range(0, 400, 3).withColumnRenamed("id", "k")
    want = {(r.k, r.v) for r in df.join(keys, "k", "left_anti").collect()}
    assert {(r.k, r.v) for r in filters.without(df, "k", keys, "k").collect()} == want
    assert filters.possibly_in(df, "k", keys, "k").join(keys, "k", "left_semi").count() == df.join(keys, "k", "left_semi").count()
    assert filters.without(df, "k", keys.limit(0), "k").count() == 200
    assert filters.with_hint(df, "k", keys, "k").where("__maybe").count() < 90


def test_a_change_with_all_that_is_known_of_it(spark, review):
    _, _, changes, callers, _ = review
    hunks = spark.createDataFrame([("a", "@@ -1 +1 @@\n+x", True), ("c", "@@", True)], "id string, text string, complete boolean")
    calls = spark.createDataFrame([("a", ["f"], 2, [], 0)], "id string, added array<string>, added_more int, removed array<string>, removed_more int")
    reach = spark.createDataFrame([("a", "covered", 1, None), ("b", "unknown", None, "why")], "start string, state string, test_depth int, reason string")
    paths = spark.createDataFrame([("a", 2, "budget", ["a", "z"], False), ("a", 1, "entry", ["a", "y"], True)], "id string, position int, end string, via array<string>, through_stale boolean")
    row = lambda c: answers.get_change(c, changes, callers, hunks, calls, reach, paths).first()
    a, b, c = row("a"), row("b"), row("c")
    assert (a.callers, a.hunk, a.hunk_complete, a.calls_added, a.calls_added_more, a.test_state) == (2, "@@ -1 +1 @@\n+x", True, ["f"], 2, "covered")
    assert [(p.end, p.via, p.through_stale) for p in a.paths] == [("entry", ["a", "y"], True), ("budget", ["a", "z"], False)]
    assert (b.hunk, b.hunk_complete, b.calls_added, b.test_state, b.test_reason, b.paths) == (None, False, None, "unknown", "why", None)
    assert (c.hunk, c.hunk_complete, c.test_state, c.paths) == (None, False, None, None) and "deleted" in c.reasons[0]


def test_what_a_card_has_beside_its_members(spark):
    from spanloom.operators import impact

    members = spark.createDataFrame([("K1", "a"), ("K1", "b"), ("K2", "c")], "card string, change string")
    rows = [("a", "n1", "entry", None, None, "http", "GET /x", "f", 2, ["a", "n1"], False), ("b", "n2", "entry", None, None, "http", "GET /x", "g", 1, ["b", "n2"], True), ("b", "n3", "entry", None, None, "job", "nightly", "g", 1, ["b", "n3"], False), ("c", "n4", "budget", "limit", None, None, None, "h", 3, ["c", "n4"], False)]
    ends = spark.createDataFrame(rows, "id string, node string, end string, reason string, top_kind string, entry_type string, entry_name string, file string, depth int, via array<string>, through_stale boolean")
    visited = spark.createDataFrame([("a", 4), ("b", 2)], "id string, visited long")
    summaries = impact.summary(ends, visited=visited)
    assert {r.id: (r.entry_types, r.visited) for r in summaries.collect()} == {"a": ({"http": 1}, 4), "b": ({"http": 1, "job": 1}, 2), "c": (None, 0)}
    cards = impact.card_impact(members, summaries, ends)
    seams = spark.createDataFrame([("type", ["K1", "K2"], "p", 1), ("call", ["K1", "K10"], "q", 2), ("call", ["K1", "K2"], "q", 3), ("call", ["K2", "K3"], "q", 3)], "type string, cards array<string>, place string, via_count int")
    together = spark.createDataFrame([("K1", "K2", 3, [f"e{i}" for i in range(9)], 1), ("K2", "K3", 1, [], 2)], "a string, b string, strength int, evidence array<string>, position int")
    facts = answers.card_facts("K1", cards, ends, members, seams, together)
    one = facts["impact"].first()
    assert (one.members, one.walked, one.entry_points, one.entry_types, one.complete) == (2, 2, 2, {"http": 1, "job": 1}, True)
    assert [(r.type, r.name, r.file, r.change) for r in facts["entries"].collect()] == [("http", "GET /x", "g", "b"), ("job", "nightly", "g", "b")]
    assert [r.via for r in facts["paths"].collect()] == [["b", "n2"], ["a", "n1"], ["b", "n3"]]
    assert [(r.type, r.cards) for r in facts["seams"].collect()] == [("call", ["K1", "K2"]), ("call", ["K1", "K10"]), ("type", ["K1", "K2"])]
    assert [(r.a, r.b, len(r.evidence)) for r in facts["hints"].collect()] == [("K1", "K2", 6)]


def test_hunks_of_functions_of_one_long_file(spark):
    """Thousands of functions and hunks in one file meet by cells; each gets just its own hunks."""
    from spanloom.sources import changes as sources

    n = 3_000
    functions = spark.createDataFrame([(i, "x", 10 * i + 1, 10 * i + 5) for i in range(n)] + [(n, "y", 1, 2)], "id int, path string, start_line int, end_line int")
    text = "diff --git a/x b/x\n" + "\n".join(f"@@ -1 +{10 * i + 5},2 @@\n+{i}" for i in range(0, n, 2))
    got = {r.id: (r.text, r.complete) for r in sources.function_hunks(functions, spark.createDataFrame([("x", text)], "path string, text string")).collect()}
    assert len(got) == n + 1 and got[n] == (None, False)
    assert got[0] == ("@@ -1 +5,2 @@\n+0", True) and got[1] == ("", True) and got[2998][0] == "@@ -1 +29985,2 @@\n+2998"
