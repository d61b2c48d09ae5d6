"""Landed diffs, rounds, answers, walks and hints on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import code
from spanloom.functions import text as t
from spanloom.operators import hints, impact, matching, review, sets
from spanloom.plans import answers
from spanloom.sources import changes, rounds

PATCH = "@@ -1,8 +1,6 @@\n one\n-old\n-older\n+new\n four\n five\n six\n-gone\n eight\n\\ No newline at end of file\n@@ -20,0 +19,1 @@\n+last"


def test_patches_without_context_read_as_diffs(spark):
    patches = spark.createDataFrame([("r", "x.py", None, "modified", PATCH), ("r", "n.py", None, "added", "@@ -0,0 +1,2 @@\n+a\n+b"), ("r", "b.bin", None, "modified", None)], "run_id string, path string, old_path string, status string, patch string")
    diffs = changes.zero_context(patches)
    got = {r.path: (r.text, r.known) for r in diffs.collect()}
    assert got["b.bin"] == (None, False)
    assert got["x.py"][0].split("\n")[3:] == ["@@ -2,2 +2,1 @@", "-old", "-older", "+new", "@@ -7,1 +5,0 @@", "-gone", "@@ -20,0 +19,1 @@", "+last"]
    # the same places as the patch itself marks
    ranges = {tuple(r) for r in changes.changed_ranges(changes.hunks(diffs.where("known"))).select("path", "lo", "hi").collect()}
    assert ranges == {tuple(r) for r in changes.patch_ranges(patches).where("known").select("path", "lo", "hi").collect()}
    whole = spark.createDataFrame([("r", "junk\n" + got["x.py"][0] + "\n" + got["n.py"][0])], "run_id string, text string")
    assert [r.text.split("\n")[0] for r in changes.file_diffs(whole).orderBy("n").collect()] == ["diff --git a/x.py b/x.py", "diff --git a/n.py b/n.py"]


def test_hunks_of_a_function(spark):
    diff = "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-a\n+b\n@@ -9,1 +8,0 @@\n-gone\n@@ -20 +18 @@\n-x\n+y"
    fns = spark.createDataFrame([("A", "f", 1, 5), ("B", "f", 7, 18), ("C", "f", 30, 31), ("D", "g", 1, 2)], "id string, path string, start_line int, end_line int")
    diffs = spark.createDataFrame([("f", diff)], "path string, text string")
    got = {r.id: (r.text, r.complete) for r in changes.function_hunks(fns, diffs).collect()}
    assert got["A"] == ("@@ -1,1 +1,1 @@\n-a\n+b", True) and got["B"][0].count("@@ -") == 2 and got["C"] == ("", True) and got["D"] == (None, False)
    cut = {r.id: (r.text, r.complete) for r in changes.function_hunks(fns, diffs, 10).collect()}
    assert cut["A"] == ("@@ -1,1 +1\n… (cut at 10 characters)", False)


def test_added_words_and_where_they_occur(spark):
    lines = ['const tokenLimit = "rate-limit"; // commented', "/* blocked", "inside */ afterBlock(x)", "short"]
    rows = spark.createDataFrame([("r", "a.ts", 0, lines[:2]), ("r", "a.ts", 1, lines[2:]), ("r", "b.py", 0, ['"""docstring', "hidden words", '"""', "visible_name = 1  # comment_word"])], "run_id string, path string, hunk_no int, added array<string>")
    got = {(r.path, r.token) for r in code.added_words(rows, ["short"]).collect()}
    assert got == {("a.ts", "tokenLimit"), ("a.ts", "rate-limit"), ("a.ts", "afterBlock"), ("b.py", "visible_name")}
    files = spark.createDataFrame([("p", "tokenLimit rate-limit"), ("q", "xtokenLimit rate-limits tokenLimit"), ("s", "nothing")], "path string, text string")
    counts = {r.token: r.files for r in code.word_files(spark.createDataFrame([("tokenLimit",), ("rate-limit",), ("absent",)], "token string"), files).collect()}
    assert counts == {"tokenLimit": 2, "rate-limit": 1, "absent": 0}


def test_calls_leave_helpers_out():
    assert code.calls_on("a.b?.c(rows.map(f), Effect.map(g), JSON.parse(s), new Foo<T>(x), if (y), f().g(1))") == ["a.b.c", "Effect.map", "Foo", "f"]
    assert code.calls_on("function own(x) { other('f(') /* g( */ + own(1) } // h(", "own") == ["other"]
    state = code.Open()
    assert [code.without_comments(x, "a.ts", state) for x in ['s = "// no" /* a', "b */ c // d", "`x /* y`"]] == ['s = "// no" ', " c ", "`x /* y`"]
    assert code.without_comments("keep // this", "notes.txt", state) == "keep // this"


def test_rounds_are_written_and_read_back(spark):
    r = spark.createDataFrame([(3, "main", "branch", None)], "round int, branch string, mode string, checkpoint string").withColumn("sent", F.timestamp_seconds(F.lit(0)))
    items = spark.createDataFrame([(3, 0, "i1", "a.ts", 4, "f", "quoted\nlines", "## not a heading\n<!-- item id=zz -->\nStatus: done"), (3, 1, "i2", "b.ts", None, None, "", "please")], "round int, ord int, item string, path string, line int, symbol string, quote string, body string")
    text = rounds.written(r, items).first().text
    assert text.startswith("# Feedback round 3 · 1970-01-01 00:00\n<!-- review feedback v1 round=3 checkpoint=none -->\n")
    answered = text.replace("Status:\n\n## 2", "Status: **done**\n\n## 2")
    bad = ["no header", "<!-- review feedback v2 round=1 checkpoint=none -->", "<!-- review feedback v1 round=0 checkpoint=none -->", None]
    twice = answered + "<!-- item id=i1 -->\nStatus: done\n"
    files = spark.createDataFrame([("ok", answered), ("twice", twice), *[(f"bad{i}", b) for i, b in enumerate(bad)]], "path string, text string")
    read, rejected = rounds.read(files)
    got = {(x.path, x.item): (x.round, x.status, x.reason) for x in read.collect()}
    assert got == {("ok", "i1"): (3, "done", None), ("ok", "i2"): (3, "none", None), ("twice", "i1"): (3, "unreadable", "duplicate item marker"), ("twice", "i2"): (3, "none", None)}
    assert {x.path: x.reason for x in rejected.collect()} == {"bad0": "header marker missing", "bad1": "unknown format version", "bad2": "malformed header", "bad3": "not text"}


def test_submitted_callers_need_evidence(spark):
    lines = spark.createDataFrame([("head", "a.ts", i, x) for i, x in enumerate(["x", "quote(1)", "y", "// quote", "z"], 1)], "side string, path string, line int, text string")
    fns = spark.createDataFrame([("q", "quote", False), ("d", "gone", True)], "id string, name string, deleted boolean")
    rows = [("q", "a.ts", 3, None), ("q", "a.ts", 1, "reference"), ("q", "a.ts", 5, None), ("q", "a.ts", 9, None), ("q", "../a.ts", 1, None), ("q", "a.ts", 0, None), ("q", "a.ts", 1, "odd"), ("d", "a.ts", 1, None), ("?", "a.ts", 1, None)]
    good, bad = answers.checked_callers(spark.createDataFrame(rows, "function string, path string, line int, kind string"), fns, lines)
    assert {tuple(r) for r in good.collect()} == {("q", "a.ts", 3, "call"), ("q", "a.ts", 1, "reference")}
    assert sorted(r.error for r in bad.collect()) == sorted(["the function is not named there", "no such file or line", "not a repository-relative path", "not a line number", "unknown kind", "callers of a deleted function are not accepted", "unknown function"])


FACTS = "node string, label string, file string, entry_type string, entry_name string, passes boolean, module_level boolean, starts_app boolean, complete boolean, reason string, caller_state string, test_callers int"


def walk(spark, edges, facts, **limits):
    starts = spark.createDataFrame([("S", "S", True)], "id string, node string, risky boolean")
    rows = [(a, b, i, x == "t", x == "u") for i, (a, b, x) in enumerate(edges)]
    known = [tuple(f.get(c.split()[0]) for c in FACTS.split(", ")) for f in facts]
    return impact.walked(starts, spark.createDataFrame(rows, "src string, dst string, ord int, is_test boolean, updated boolean"), spark.createDataFrame(known, FACTS), **limits)


def test_walks_end_with_reasons(spark):
    edges = [("S", "A", ""), ("S", "B", "u"), ("S", "T", "t"), ("A", "H", ""), ("B", "H", ""), ("B", "M", ""), ("A", "D", ""), ("D", "S", ""), ("A", "P", ""), ("P", "R", ""), ("A", "V", "")]
    facts = [{"node": "H", "entry_type": "http", "entry_name": "GET /"}, {"node": "M", "module_level": True}, {"node": "D", "complete": False, "reason": "timed out"}, {"node": "P", "entry_type": "server-action", "entry_name": "act", "passes": True}, {"node": "R", "test_callers": 2}, {"node": "V", "caller_state": "di"}]
    ends = walk(spark, edges, facts)
    got = {(r.node, r.end, r.top_kind or r.reason, r.depth, "".join(r.via), r.through_stale) for r in ends.collect()}
    assert got == {
        ("H", "entry", None, 2, "SAH", True), ("M", "top-unidentified", "module", 2, "SBM", False), ("D", "unknown", "timed out", 2, "SAD", True), ("P", "entry", "passed", 2, "SAP", True),
        ("R", "top-unidentified", "test-only", 3, "SAPR", True), ("V", "unknown", impact.DI_REASON, 2, "SAV", True)}
    one = impact.summary(ends).first()
    assert (one.entry, one.top_unidentified, one.unknown, one.budget, one.entries, one.nearest_entry, one.complete, one.test_only) == (1, 2, 2, 0, 2, 2, False, False)
    assert [r.end for r in impact.top_paths(ends).orderBy("position").collect()] == ["entry", "top-unidentified", "unknown"]


def test_walks_stop_at_their_limits(spark):
    chain = [("S", "A", ""), ("A", "B", ""), ("B", "C", "")]
    ends = walk(spark, chain, [{"node": "x"}], max_depth=2).collect()
    assert [(r.node, r.end, r.reason) for r in ends] == [("B", "budget", "depth limit of 2 caller levels")]
    wide = [("S", x, "") for x in "ABCDE"] + [("A", "F", "")]
    cut = {(r.node, r.end) for r in walk(spark, wide, [{"node": "B", "entry_type": "http", "entry_name": "b"}], max_nodes=3).collect()}
    # three callers are let in; the start and those still in the queue are cut, the entry among them is found
    assert cut == {("S", "budget"), ("A", "budget"), ("C", "budget"), ("B", "entry")}
    ring = walk(spark, [("S", "A", ""), ("A", "S", "")], [{"node": "x"}])
    assert ring.count() == 0
    starts = spark.createDataFrame([("S",)], "id string")
    assert impact.summary(ring, starts=starts).first().complete


def test_hints_count_what_counts(spark):
    files = spark.createDataFrame([("K1", "a"), ("K2", "b"), ("K10", "c")], "card string, path string")
    commits = spark.createDataFrame([("s1", "chore: all of it", "a"), ("s1", "chore: all of it", "b"), ("s2", "Fix the thing properly", "b"), ("s2", "Fix the thing properly", "c")], "sha string, subject string, path string")
    evidence = [hints.commit_evidence(commits, files, None), hints.shared_evidence(spark.createDataFrame([("K1", "d"), ("K2", "d"), ("K10", "d")], "card string, folder string"), "folder", "folder", counted=False),
                hints.shared_evidence(spark.createDataFrame([("K2", f"p{i}") for i in range(5)] + [("K10", f"p{i}") for i in range(5)], "card string, pattern string"), "pattern", "pattern")]
    got = [(r.a, r.b, r.strength, r.pieces, r.evidence) for r in hints.hints(evidence).orderBy("position").collect()]
    # K1 and K2 share a weak commit and a folder only; K2 comes before K10 by number
    assert got == [("K2", "K10", 2, 5, ["commit:s2", "pattern:p0", "pattern:p1", "pattern:p2", "folder:d"])]


def test_edits_go_to_the_functions_that_hold_them(spark):
    fns = spark.createDataFrame([("f", "x", 1, 4), ("g", "x", 5, 9)], "id string, path string, start_line int, end_line int")
    hunks = spark.createDataFrame([("x", 0, 4, ["old"], ["a", "b"]), ("x", 1, 20, ["gone"], ["c"]), ("x", 2, 6, ["del"], [])], "path string, hunk_no int, new_start int, removed array<string>, added array<string>")
    got = {(r.id, r.hunk_no): (r.removed, r.added) for r in matching.edits_by_function(fns, hunks).collect()}
    assert got == {("f", 0): (["old"], ["a"]), ("g", 0): ([], ["b"]), ("g", 2): (["del"], [])}


def test_review_json_is_read_or_rejected(spark):
    good = '{"number": 5, "state": "OPEN", "threads": [{"id": "t", "path": "a", "side": "RIGHT", "line": 3, "resolved": true, "comments": [{"id": "c", "body": "hi", "pending": true}]}]}'
    landed = spark.createDataFrame([(good,), ("{}",), ("no json",), (good.replace("RIGHT", "UP"),)], "text string")
    rows, rejected = review.review_rows(landed)
    assert [(r.number, r.thread, r.line, r.resolved, r.comment, r.pending, r.outdated) for r in rows.collect()] == [(5, "t", 3, True, "c", True, False)]
    assert rejected.count() == 3


def test_small_text_functions(spark):
    df = spark.createDataFrame([("# 482", "a\nbc\n", "Fix\n```suggestion\nx = 1\ny\n```\n~~~suggestion\n~~~\n```ts\nno\n```", '{"b": 1, "a": [1]}')], "q string, s string, body string, j string")
    r = df.select(t.pull_number(F.col("q")).alias("n"), t.whole_range(F.col("s")).alias("w"), t.offset_of(F.col("s"), F.lit(2), F.lit(1)).alias("o"), t.offset_of(F.col("s"), F.lit(9), F.lit(1)).alias("far"), t.suggestion_blocks(F.col("body")).alias("b"), t.canonical_json(F.col("j")).alias("j"),
                  t.round_file(F.lit("2024-05-06").cast("timestamp"), F.lit(2)).alias("f"), t.model_version(F.lit("gpt-5.1-codex"), [("^gpt.*codex", "gpt-codex"), ("^gpt", "gpt")]).alias("m"), sets.union_sorted(F.array(F.lit("b")), F.lit(None).cast("array<string>")).alias("u")).first()
    assert (r.n, tuple(r.w), r.o, r.far, r.b, r.f, tuple(r.m), r.u) == (482, (1, 2), 3, 5, ["x = 1\ny", None], "2024-05-06-2.md", ("gpt-codex", "5.1"), ["b"])
    assert r.j.index('"a"') < r.j.index('"b"')
    names = spark.createDataFrame([("2024-01-01-3.md",), ("2024-01-02-10.md",), ("notes.md",)], "n string")
    assert names.agg(t.next_round(F.col("n"))).first()[0] == 11 and names.limit(0).agg(t.next_round(F.col("n"))).first()[0] == 1
    assert spark.createDataFrame([("x = ['a',\n # no\n \"b\"]\ny=1",)], "t string").select(changes.toml_strings(F.col("t"), "x")).first()[0] == ["a", "b"]


@pytest.mark.parametrize("budget,cut", [(100, 0), (27, 8), (5, 28)])
def test_facts_shrink_by_steps(spark, budget, cut):
    rows = spark.createDataFrame([(0, "ab", "x" * 14), (1, "c", "y" * 14)], "ord int, text string, hunk string")
    assert answers.facts_within(rows, budget, (20, 10, 0)).agg(F.sum("cut")).first()[0] == cut


def plain_walk(starts, edges, facts, max_depth, max_nodes):
    """Ends ``(start, node, end)`` of a walk with a queue, one start after the other."""
    out = []
    for start in starts:
        queue, seen, admitted = [(start, 0)], {start}, 0
        while queue:
            node, depth = queue.pop(0)
            fact = facts.get(node, {})
            if fact.get("module_level"):
                out.append((start, node, "top-unidentified"))
                continue
            if depth == max_depth:
                out.append((start, node, "budget"))
                continue
            callers = [d for s, d in edges if s == node]
            if not fact.get("complete", True):
                out.append((start, node, "unknown"))
            elif not callers:
                out.append((start, node, "top-unidentified"))
            full = False
            for c in callers:
                if c in seen:
                    continue
                if admitted >= max_nodes:
                    full = True
                    break
                seen.add(c)
                admitted += 1
                if facts.get(c, {}).get("entry_type"):
                    out.append((start, c, "entry"))
                else:
                    queue.append((c, depth + 1))
            if full:
                out += [(start, n, "budget") for n in [node, *(q for q, _ in queue)]]
                break
    return out


@pytest.mark.parametrize(("max_depth", "max_nodes"), [(4, 3), (4, 6), (3, 9), (2, 100)])
def test_walks_with_limits_equal_a_queue(spark, max_depth, max_nodes):
    r = random.Random(max_nodes)
    names = [f"n{i:02}" for i in range(26)]
    edges = sorted({(a, b) for a in names for b in r.sample(names, 2) if a != b})
    facts = {n: {"node": n, "entry_type": "http" if i % 9 == 0 else None, "entry_name": n, "module_level": i % 7 == 3, "complete": i % 5 != 1} for i, n in enumerate(names)}
    starts = [n for n in names if not facts[n]["entry_type"]]
    ord_of = {e: k for k, e in enumerate(edges)}
    e = spark.createDataFrame([(a, b, ord_of[a, b], False, False) for a, b in edges], "src string, dst string, ord int, is_test boolean, updated boolean")
    f = spark.createDataFrame([(x["node"], x["node"], "f", x["entry_type"], x["entry_name"], False, x["module_level"], False, x["complete"], None, "none", 0) for x in facts.values()],
                              "node string, label string, file string, entry_type string, entry_name string, passes boolean, module_level boolean, starts_app boolean, complete boolean, reason string, caller_state string, test_callers int")
    s = spark.createDataFrame([(n, n, False) for n in starts], "id string, node string, risky boolean")
    got = sorted((x.id, x.node, x.end) for x in impact.walked(s, e, f, max_depth, max_nodes).collect())
    assert got == sorted(plain_walk(starts, edges, facts, max_depth, max_nodes))


def test_entries_are_ordered_as_people_order_names(spark):
    ends = spark.createDataFrame([(1, n, "entry", None, None, "http", n, "f", 2, ["x"], False) for n in ("beta", "Alpha", "alpha", "Zeta", "Beta2")], "id int, node string, end string, reason string, top_kind string, entry_type string, entry_name string, file string, depth int, via array<string>, through_stale boolean")
    assert [x.name for x in impact.entries(ends).orderBy("position").collect()] == ["alpha", "Alpha", "beta", "Beta2", "Zeta"]


def test_card_numbers_of_any_size(spark):
    own = spark.createDataFrame([("s", "K1234567"), ("s", "K1234568"), ("s", "K9"), ("s", "Kx")], "item string, card string")
    got = {(x.a, x.b) for x in hints.in_pairs(own, ["item"]).collect()}
    assert got == {("K9", "K1234567"), ("K9", "K1234568"), ("K1234567", "K1234568"), ("Kx", "K9"), ("Kx", "K1234567"), ("Kx", "K1234568")}


def test_json_values_in_one_form(spark):
    texts = ['{"a": 1}', '{"a": "1"}', '{"b": {"y": [2, {"q": 1, "p": null}], "x": 1.50}, "a": true}', '{"a":true,"b":{"x":1.5,"y":[2,{"p":null,"q":1}]}}', "[3, 1]", "no json", None, '"é\\"/* no */"']
    got = [x.j for x in spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", t.canonical_json(F.col("s")).alias("j")).orderBy("i").collect()]
    assert got == ['{"a":1}', '{"a":"1"}', '{"a":true,"b":{"x":1.5,"y":[2,{"p":null,"q":1}]}}', '{"a":true,"b":{"x":1.5,"y":[2,{"p":null,"q":1}]}}', "[3,1]", None, None, '"é\\"/* no */"']
    config = '{ // first\n "paths": {"@/*": ["src/*",], /* a, b */}, "url": "http://x/*y*/", }'
    read = spark.createDataFrame([(config,), ("{",)], "s string").select(F.to_json(t.commented_json(F.col("s"))).alias("j")).collect()
    assert [x.j for x in read] == ['{"paths":{"@/*":["src/*"]},"url":"http://x/*y*/"}', None]


def test_commits_keep_every_file(spark):
    text = "\x01abc\x02Many files\n" + "\n".join(f"f{i}" for i in range(3)) + "\n\x01def\x02None\n"
    got = changes.commits(spark.createDataFrame([(1, text)], "run_id int, text string")).orderBy("ord").collect()
    assert [(x.sha, x.subject, x.files) for x in got] == [("abc", "Many files", ["f0", "f1", "f2"]), ("def", "None", [])]


def test_edits_are_limited_by_the_product_of_lengths():
    from spanloom.functions import alignment

    side = int(alignment.MOST_CELLS**0.5)
    a, b = [f"a{i}" for i in range(side)], [f"b{i}" for i in range(side)]
    assert alignment.edits(a, b) is not None and alignment.edits([*a, "x"], b) is None


def test_phrases_are_verified_on_their_words(spark):
    files = {"a": "rate-limit and rate - limit", "b": "prelimit -limit\nx", "c": "rate-limited (rate-limit)", "d": "rate-limit", "e": "", "f": None, "g": "rate-\nlimit say: rate-limit, twice rate-limit,,", "h": "é rate-limité ok"}
    table = spark.createDataFrame(list(files.items()), "path string, text string")
    wanted = ["rate-limit", "-limit", "limit", "rate-limit,", "(rate", "rate-limit)", "rate", "twice rate-limit", "absent", "a b c", "=>", "rate-\nlimit"]
    import re

    def brute(token):
        return sum(bool(re.search(r"(?<!\w)" + re.escape(token) + r"(?!\w)", x or "", re.ASCII)) for x in files.values())

    for index in (None, code.postings(table)):
        got = {x.token: (x.files, x.partial) for x in code.word_files(spark.createDataFrame([(w,) for w in wanted], "token string"), table, index=index).collect()}
        assert got == {w: (0, True) if w in ("=>", "rate-\nlimit") else (brute(w), False) for w in wanted}
    plan = code.word_files(spark.createDataFrame([("rate-limit",)], "token string"), table)._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan.split("Join")[1].split("Generate")[0]


def test_folder_chains_are_one_row(spark):
    paths = ["a/b/c/x.py", "a/b/c/y.py", "a/b/d/e/f/z.py", "q/r/s.py", "q/t.py", "u/v/w/k.py", "top.py"] + ["/".join(f"d{i}" for i in range(60)) + "/deep.py"]
    files = spark.createDataFrame([(p, 1, 0) for p in paths], "path string, level int, attention int")
    direct = files.where("path LIKE '%/%'").groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))
    got = {x.folder: (x.name, x.shown_parent, x.depth) for x in review.compacted_folders(review.folder_rollup(files), direct).collect()}
    deep = "/".join(f"d{i}" for i in range(60))
    assert got == {"a/b": ("a/b", None, 0), "a/b/c": ("c", "a/b", 1), "a/b/d/e/f": ("d/e/f", "a/b", 1), "q": ("q", None, 0), "q/r": ("r", "q", 1), "u/v/w": ("u/v/w", None, 0), deep: (deep, None, 0)}
