"""Distributed positions against plain sorting."""

import random

from pyspark.sql import functions as F

from spanloom.operators.ranks import positioned


def test_positions_without_a_group(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, *range(40)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {x.id: x.position for x in positioned(df, [F.desc("v"), F.col("id")]).collect()}
    want = sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [got[i] for i, _ in want] == list(range(1, 3001))


def test_positions_in_groups_that_span_ranges(spark):
    r = random.Random(4)
    rows = [(i, r.choice(["hot", "hot", "hot", None, "a", "b"]), r.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    with_parts = positioned(df, [F.col("v"), F.col("id")], ("g",), "n")
    got = {x.id: x.n for x in with_parts.collect()}
    for g in {x[1] for x in rows}:
        own = sorted((v, i) for i, k, v in rows if k == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert positioned(df.limit(0), [F.col("v")], ("g",)).count() == 0


def test_no_window_in_the_plan(spark):
    plan = positioned(spark.range(50).withColumn("v", F.col("id") % 7), [F.col("v"), F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
