"""Running values, merged and subtracted spans of keys that are cut into many buckets."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals
from spanloom.operators.scans import Scan


def rows_of(r, n, wide):
    key = lambda: r.choice(["hot", "hot", "hot", "a", None])
    return [(key(), a, a + r.choice([0, 1, 3, wide])) for a in (r.randint(-50, 900) for _ in range(n))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, lo int, hi int").repartition(3)


@pytest.mark.parametrize("bucket_rows", [5, 40, None])
def test_running_values(spark, bucket_rows):
    r = random.Random(1)
    rows = sorted({(r.choice(["hot", "hot", None, "b"]), r.randint(0, 400)): r.choice([None, 1, 2, -3]) for _ in range(300)}.items(), key=str)
    df = spark.createDataFrame([(k, at, v) for (k, at), v in rows], "k string, at long, v int")
    scan = Scan(df, ["k"], "at", bucket_rows)
    got = scan.running(scan.rows, {"s": ("sum", "v"), "m": ("max", "v")})
    got = scan.running(got, {"n": ("min", "v")}, before=True, reverse=True)
    assert scan.cut == (bucket_rows is not None)
    for x in got.collect():
        up = [v for (k, at), v in rows if k == x.k and at <= x.at and v is not None]
        down = [v for (k, at), v in rows if k == x.k and at > x.at and v is not None]
        assert (x.s, x.m, x.n) == (sum(up), max(up, default=None), min(down, default=None))


@pytest.mark.parametrize("bucket_rows", [7, None])
def test_merge_and_subtract_equal_point_sets(spark, bucket_rows):
    r = random.Random(5)
    left, right = rows_of(r, 250, 30), rows_of(r, 120, 50)
    points = lambda rows: {(k, x) for k, lo, hi in rows for x in range(lo, hi + 1)}
    islands = lambda pts: {(k, x) for k, x in pts if (k, x - 1) not in pts}
    merged = [tuple(x) for x in intervals.merge_spans(frame(spark, left), ["k"], bucket_rows=bucket_rows).collect()]
    assert points(merged) == points(left) and len(merged) == len(islands(points(left)))
    rest = [tuple(x) for x in intervals.subtract(frame(spark, left), frame(spark, right), ["k"], bucket_rows).collect()]
    want = points(left) - points(right)
    assert points(rest) == want and {(k, lo) for k, lo, _ in rest} == islands(want) and len(rest) == len(islands(want))


@pytest.mark.parametrize("bucket_rows", [6, None])
def test_nearest_lines(spark, bucket_rows):
    r = random.Random(6)
    spans = rows_of(r, 80, 20)
    wanted = [(k, p) for k in ("hot", "a", None, "none") for p in range(-60, 960, 13)]
    got = intervals.nearest_line(spark.createDataFrame(wanted, "k string, preferred int"), frame(spark, spans), ["k"], bucket_rows=bucket_rows)
    near = {(x.k, x.preferred): x.line for x in got.collect()}
    for k, p in wanted:
        lines = [min(max(p, lo), hi) for q, lo, hi in spans if q == k]
        assert near[k, p] == min(lines, key=lambda x: (abs(x - p), x), default=None)


def test_one_key_of_many_spans_is_dealt(spark):
    """One file; every tenth span touches nothing, the others chain up in tens."""
    many = spark.range(400_000).select(F.when(F.col("id") < 0, 2).otherwise(1).alias("k"), (F.col("id") * 10).cast("int").alias("lo"), (F.col("id") * 10 + F.when(F.col("id") % 10 == 9, 3).otherwise(9)).cast("int").alias("hi"))
    merged = intervals.merge_spans(many, ["k"], bucket_rows=20_000)
    assert merged.count() == 40_000
    cuts = many.select("k", (F.col("lo") + 1).alias("lo"), (F.col("lo") + 1).alias("hi"))
    assert intervals.subtract(many, cuts, ["k"], bucket_rows=20_000).count() == 40_000 + 400_000
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan


def test_empty_tables(spark):
    none = frame(spark, [("a", 1, 2)]).limit(0)
    assert intervals.merge_spans(none, ["k"]).count() == intervals.subtract(none, none, ["k"]).count() == 0


def outside(ranges, spans, deletions, deleted, base_spans, text):
    """Plain version for one file; doubled positions, deletions as (at, old_start, old_end, new_end)."""
    import re

    lines = None if text is None else text.split("\n")
    trivial = lambda n: bool(re.match(r"\s*(//|/\*|\*|$)", lines[n - 1] if n <= len(lines) else ""))
    gone = lambda n: any(a <= n <= b for a, b in deleted)

    def explained(d):
        old = range(d[1], d[2] + 1)
        return lines is not None and any(map(gone, old)) and all(gone(n) or trivial(n) for n in old)

    left = {x for lo, hi in ranges if lo % 2 == 0 for x in range(lo // 2, hi // 2 + 1)} - {x for lo, hi in spans for x in range(lo // 2, hi // 2 + 1)}
    marks = {lo for lo, _ in ranges if lo % 2 and not any(a < lo < b for a, b in spans) and not any(explained(d) for d in deletions if d[0] == lo)}
    for d in deletions:
        if d[3] is None or explained(d) or any(x in left for x in range((d[0] + 1) // 2, d[3] + 1)):
            continue
        touches = any(map(gone, range(d[1], d[2] + 1)))
        if any(not any(a <= n <= b for a, b in base_spans) and not (touches and lines is not None and trivial(n)) for n in range(d[1], d[2] + 1)):
            marks.add(d[0])
    starts = sorted(x for x in left if x - 1 not in left)
    return sorted([(2 * x, 2 * next(y for y in range(x, x + 10_000) if y + 1 not in left)) for x in starts] + [(m, m) for m in marks])


def test_outside_lines_with_explained_deletions(spark):
    r = random.Random(11)
    files = {}
    for f in range(12):
        span = lambda n: [(a, a + r.randint(0, 6)) for a in (r.randint(1, 40) for _ in range(n))]
        text = None if f == 3 else "\n".join(r.choice(["", "  // note", "x = 1", " * doc", "\t"]) for _ in range(40))
        base = span(5)
        deletions, ranges = [], [(2 * a, 2 * b) for a, b in span(3)]
        for n in sorted({r.randint(1, 40) for _ in range(6)}):
            old = r.randint(1, 42)
            new = r.choice([None, n + r.randint(1, 3)])
            deletions.append((2 * n + 1, old, old + r.randint(0, 4), new))
            ranges.append((2 * n + 1, 2 * n + 1) if new is None else (2 * n + 2, 2 * new))
        files[f] = (ranges, [(2 * a, 2 * b) for a, b in span(3)], deletions, base[:2], base, text)
    frame_of = lambda i, schema: spark.createDataFrame([(f, *x) for f, v in files.items() for x in v[i]], "k int, " + schema)
    texts = spark.createDataFrame([(f, n, line) for f, v in files.items() if v[5] is not None for n, line in enumerate(v[5].split("\n"), 1)], "k int, line int, text string")
    ends = "lo int, hi int"
    got = intervals.outside_lines(frame_of(0, ends), frame_of(1, ends), ["k"], frame_of(2, "at int, old_start int, old_end int, new_end int"), frame_of(3, ends), frame_of(4, ends), texts)
    found = {f: [] for f in files}
    for x in got.collect():
        found[x.k].append((x.lo, x.hi))
    for f, v in files.items():
        assert sorted(found[f]) == outside(*v), f
