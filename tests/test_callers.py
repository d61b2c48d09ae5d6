"""Caller lists on hand-made rows."""

from pyspark.sql import functions as F

from spanloom.operators import callers


def test_merge_keeps_a_label_only_if_all_agree(spark):
    df = spark.createDataFrame([("c", "p", 1, "f", [3, 1], True, None), ("c", "p", 1, "f", [1, 2], True, None), ("c", "p", 2, "g", [1], True, None), ("c", "p", 2, "h", [1], False, "timeout")], "change string, path string, pos int, label string, sites array<int>, complete boolean, reason string")
    got = {r.pos: (r.label, r.sites, r.complete, r.reasons) for r in callers.merged(df).collect()}
    assert got == {1: ("f", [1, 2, 3], True, []), 2: (None, [1], False, ["timeout"])}


def test_first_answer_wins(spark):
    make = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    assert sorted(tuple(r) for r in callers.preferred(make((1, "a")), make((1, "b"), (2, "c")), ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_inherited_callers_go_only_when_determined(spark):
    closure = spark.createDataFrame([("Dog", "Animal"), ("Cat", "Animal")], "sub string, sup string")
    targets = spark.createDataFrame([("Dog",)], "target string")
    related = callers.related_types(targets, closure, spark.createDataFrame([], "target string, type string"))
    assert {r.type for r in related.collect()} == {"Dog", "Animal"}
    rows = spark.createDataFrame([("c", "p", i, "Dog") for i in range(4)], "change string, path string, pos int, target string")
    types = spark.createDataFrame([("c", "p", 0, "Cat"), ("c", "p", 1, "Animal"), ("c", "p", 2, "Cat"), ("c", "p", 2, None)], "change string, path string, pos int, type string")
    assert sorted(r.pos for r in callers.without_inherited(rows, types, targets, related).collect()) == [1, 2, 3]
    assert callers.without_inherited(rows, types, targets.limit(0), related).count() == 4


def test_bus(spark):
    handlers = spark.createDataFrame([("h", "C")], "handler string, command string")
    sent = spark.createDataFrame([("x", "C"), ("y", "D")], "caller string, command string")
    direct = spark.createDataFrame([("h", "false"), ("o", "z")], "src string, dst string")
    assert {tuple(r) for r in callers.bus_edges(handlers, sent, direct).collect()} == {("h", "x"), ("o", "z")}


def test_unseen_users_count_what_was_not_checked(spark):
    names = spark.createDataFrame([("c", "f", "m")], "change string, name string, module string")
    mentions = spark.createDataFrame([(f"p{i}", "f") for i in range(5)], "path string, name string")
    imports = spark.createDataFrame([("p1", "m"), ("p4", "m"), ("p2", "n")], "path string, module string")
    listed = spark.createDataFrame([("c", "p0")], "change string, path string")
    assert [tuple(r) for r in callers.unseen_users(names, mentions, imports, listed, 2).collect()] == [("c", "p1", 2)]
    assert {r.path for r in callers.unseen_users(names, mentions, imports, listed).collect()} == {"p1", "p4"}


def test_unlisted_hits_and_cards(spark):
    site = "name string, path string, offset int"
    hits = spark.createDataFrame([("f", "p", 1), ("f", "p", 2), ("f", "p", 3)], site)
    got = callers.unlisted_hits(hits, spark.createDataFrame([("f", "p", 1)], site), spark.createDataFrame([("p", 2, "other")], "path string, offset int, target string")).first()
    assert (got.unresolved, got.elsewhere) == (1, 1)
    card = "card string, change string"
    answer, cards = spark.createDataFrame([("A", "1"), ("A", "2"), ("B", "3")], card), spark.createDataFrame([("K1", "1"), ("K1", "2"), ("K2", "2"), ("K2", "3")], card)
    assert [tuple(r) for r in callers.covered_cards(answer, cards).collect()] == [("K1", "A")]


def test_requests_through_parent_teams(spark):
    schema = "number int, author string, reviewers array<string>, teams array<struct<id: long, name: string>>"
    prs = spark.createDataFrame([(1, "a", ["ME"], []), (2, "a", [], [(7, "core")]), (3, "Me", ["me"], [(7, "core")]), (4, "a", [], [(9, "web")]), (5, None, ["me"], [(5, "ui"), (7, "core")])], schema)
    teams = spark.createDataFrame([(5, 7)], "id long, parent_id long")
    got = {r.number: (r.grp, r.via) for r in callers.grouped_requests(prs, teams, "me").collect()}
    assert got == {1: ("requested", ["you"]), 2: ("requested", ["core"]), 3: ("own", []), 4: ("others", []), 5: ("requested", ["you", "ui", "core"])}
    alone = {r.number: r.grp for r in callers.grouped_requests(prs, None, "me").collect()}
    assert alone == {1: "requested", 2: "others", 3: "own", 4: "others", 5: "requested"}


def test_generated_files(spark):
    cases = [("a.pb.go", "", True), ("a.go", "// Code generated by x. DO NOT EDIT.\npackage a", True), ("a.go", "package a\n// Code generated by x. DO NOT EDIT.", False), ("x_pb2.pyi", "", True), ("a.py", "#!/bin/sh\n\n# Generated by y\nimport z", True),
             ("a.py", "import z\n# Generated by y", False), ("A.Designer.cs", "", True), ("A.cs", "using X;\n// <auto-generated />\nclass A {}", True), ("A.cs", "class A { } // <auto-generated", False), ("a.ts", "// @generated", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, path string, text string, want boolean")
    got = df.select("i", "want", callers.is_generated(F.col("path"), F.col("text")).alias("got")).orderBy("i").collect()
    assert all(r.got == r.want for r in got), [cases[r.i] for r in got if r.got != r.want]


def test_changed_keys_and_edges(spark):
    symbols = spark.createDataFrame([("m", "f", 10, None, False, 0), ("c", "f", 20, 5, True, 1), ("d", "f", 5, None, False, 2)], "id string, path string, name_pos int, class_name_pos int, is_constructor boolean, ord int")
    keys = callers.changed_keys(symbols)
    assert {(r.key, r.id) for r in keys.collect()} == {("f#10", "m"), ("f#20", "c"), ("f#5", "d")}
    rows = spark.createDataFrame([("m", "f", 20, False), ("m", "f", 10, False), ("m", "f", 5, True), ("c", "f", 10, False), ("c", "f", 10, False)], "change string, path string, pos int, is_test boolean")
    assert {tuple(r) for r in callers.change_edges(rows, keys).collect()} == {("m", "c"), ("c", "m")}
