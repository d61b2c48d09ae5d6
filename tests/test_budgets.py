"""Walks with budgets against plain level-by-level walks, and what a run publishes."""

import random

import pytest

from spanloom.operators import graph
from spanloom.streaming import sync


def graph_of(seed, n=30, degree=3):
    r = random.Random(seed)
    return sorted({(a, b) for a in range(n) for b in r.sample(range(n), r.randint(0, degree)) if a != b} | {(0, b) for b in range(1, n - 5)})


def plain_within(start, edges, depth, budget):
    seen, level = set(), {start}
    for _ in range(depth):
        level = {b for a, b in edges if a in level} - seen
        seen |= level
        if len(seen) >= budget:
            return budget, True
    return len(seen), False


@pytest.mark.parametrize(("depth", "budget"), [(1, 4), (3, 12), (6, 100), (2, 1)])
def test_reach_within_a_budget(spark, depth, budget):
    edges = graph_of(depth)
    starts = spark.createDataFrame([(i,) for i in [*range(30), 99, 4]], "start long")
    got = {x.start: (x.reached, x.capped) for x in graph.reach_within(starts, spark.createDataFrame(edges, "src long, dst long"), depth, budget).collect()}
    assert got == {s: plain_within(s, edges, depth, budget) for s in [*range(30), 99]}


def plain_state(start, edges, tests, partial, depth, budget):
    seen, level, noted = {start}, {start}, False
    for d in range(1, depth + 1):
        callers = {b for a, b in edges if a in level}
        if callers & tests:
            return "covered", d, None
        noted = noted or bool(level & partial)
        level = callers - seen
        seen |= level
        if len(seen) - 1 > budget:
            return "unknown", None, graph.UNFINISHED if noted else f"the budget of {budget} visited callers stopped the walk"
    return ("unknown", None, graph.UNFINISHED) if noted else ("uncovered", None, None)


@pytest.mark.parametrize(("depth", "budget"), [(2, 5), (4, 9), (3, 1000)])
def test_test_reach_with_a_budget(spark, depth, budget):
    edges, r = graph_of(depth + 40, degree=2), random.Random(budget)
    tests, partial = set(r.sample(range(30), 3)), set(r.sample(range(30), 4))
    facts = spark.createDataFrame([(i, i in tests, None if i % 6 == 5 and i not in partial else i not in partial) for i in range(25)] + [(i, i in tests, i not in partial) for i in range(25, 30)], "node long, is_test boolean, complete boolean")
    starts = spark.createDataFrame([(i,) for i in range(30)] + [(77,)], "start long")
    got = {x.start: (x.state, x.test_depth, x.reason) for x in graph.reach_states(starts, spark.createDataFrame(edges, "src long, dst long"), facts, depth, budget).collect()}
    assert got == {s: plain_state(s, edges, tests, partial, depth, budget) for s in [*range(30), 77]}


def _publish(spark, path, rows):
    spark.createDataFrame(list(rows), "run string, stage string, payload string, ts timestamp").coalesce(1).write.mode("append").parquet(str(path / "in"))
    stream = spark.readStream.schema("run string, stage string, payload string, ts timestamp").parquet(str(path / "in"))
    out = []
    query = sync.published(stream, "1 minute", 3_600_000).writeStream.foreachBatch(lambda df, _: out.extend((x.run, x.stage, x.payload) for x in df.collect())).outputMode("update").option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(out)


def test_a_run_over_midnight_is_one_row_and_restarts(spark, tmp_path):
    from datetime import datetime

    at = lambda day, hour, minute=0: datetime(2024, 5, day, hour, minute)
    publish = lambda *rows: _publish(spark, tmp_path, rows)
    assert publish(("a", "pending", "p1", at(1, 23, 59)), ("b", "resolved", "q1", at(1, 23, 58)), ("b", "noise", "x", at(1, 23, 58))) == [("a", "pending", "p1"), ("b", "resolved", "q1")]
    # A new query on the same checkpoint, after midnight: one row a run; a stage that comes late changes nothing and has no row.
    assert publish(("a", "final", "p2", at(2, 0, 3)), ("b", "pending", "q0", at(2, 0, 4))) == [("a", "final", "p2")]
    assert publish(("b", "resolved", "q2", at(2, 0, 5)), ("a", "resolved", "late", at(2, 0, 6))) == [("b", "resolved", "q2")]
    # Hours later both runs are forgotten, and a stage of theirs is a new run's.
    publish(("c", "pending", "r", at(2, 3)))
    publish(("c", "resolved", "r", at(2, 3, 1)))
    assert publish(("a", "pending", "again", at(2, 3, 2))) == [("a", "pending", "again")]
