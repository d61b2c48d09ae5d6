"""Sets of nodes as bits, and how little the walks shuffle that use them."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from spanloom.operators import bits, graph
from spanloom.plans.tables import consecutive, line_spans


def shuffled(spark) -> int:
    """Rows written to shuffles since the session began."""
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def within(edges, start, depth):
    seen, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for a, b in edges:
            if a == at and b not in seen and seen[at] < depth:
                seen[b] = seen[at] + 1
                queue.append(b)
    return {(start, n, d) for n, d in seen.items() if d}


@pytest.mark.parametrize("named", [False, True])
def test_reach_of_ids_of_any_kind(spark, named):
    name = (lambda n: f"n{n}") if named else (lambda n: n)
    edges = [(name(a), name(b)) for a, b in [(-300, -1), (-1, 5), (5, 5), (5, -300), (5, 1 << 40), (1 << 40, 64), (64, 63), (-1, 63), (-1, 63), (255, 256)]]
    kind = "string" if named else "long"
    starts = [name(n) for n in (-300, 5, 255, 7)]
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    for depth in (0, 2, 4):
        got = graph.reach(spark.createDataFrame([(s,) for s in starts], f"start {kind}"), df, depth)
        assert got.schema["node"].dataType.simpleString() == ("string" if named else "bigint")
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == set().union(*(within(edges, s, depth) for s in starts))
    entries = spark.createDataFrame([(name(5),), (name(63),)], f"node {kind}")
    onward = [e for e in edges if e[0] not in (name(5), name(63))]
    got = {tuple(r) for r in graph.shortest_entries(spark.createDataFrame([(s,) for s in starts], f"start {kind}"), df, entries, 3).collect()}
    assert got == {r for s in starts for r in within(onward, s, 3) if r[1] in (name(5), name(63))}


def test_bits_there_and_back(spark):
    ids = [-(1 << 62), -257, -256, -1, 0, 63, 64, 255, 256, (1 << 62) + 191]
    rows = bits.packed(spark.createDataFrame([(1, i) for i in ids + ids] + [(1, None)], "k int, node long"), ["k"], "node")
    assert sorted(r.node for r in bits.unpacked(rows, rows.schema["cell"].dataType).collect()) == ids
    assert rows.agg(F.sum(bits.size())).first()[0] == len(ids)


def test_reach_in_a_dense_graph_shuffles_no_edges_by_neighbours(spark):
    n = 300
    edges = spark.range(n * n).select((F.col("id") / n).cast("long").alias("src"), (F.col("id") % n).alias("dst")).where("(dst - src + 300) % 300 < 150")
    starts = spark.range(n).select(F.col("id").alias("start"))
    before = shuffled(spark)
    assert graph.reach(starts, edges, 2).count() == n * (n - 2)
    assert shuffled(spark) - before < n * n


def test_order_of_lines_carries_no_column_that_cannot_change_the_spans(spark):
    sf = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().sparkPlan().collectLeaves().head().output().toString()
    assert "l_extendedprice" not in plan(line_spans(spark, sf)) and "l_quantity" not in plan(consecutive(spark, sf, "supp")) and "l_suppkey" not in plan(consecutive(spark, sf, "part"))


@pytest.mark.parametrize("most", [1_000_000, 4])
def test_ends_without_ways_are_the_walks_ends(spark, most):
    from spanloom.operators import impact

    n = 24
    edges = [(a, b) for a in range(n) for b in range(n) if (a * 7 + b * 5) % 11 == 0]
    df = spark.createDataFrame([(a, b, b, (a + b) % 9 == 0, a % 2 == 0) for a, b in edges], "src long, dst long, ord long, is_test boolean, updated boolean")
    facts = [(i, f"f{i}", f"p{i % 3}", "http" if i % 6 < 2 else None, f"E{i % 4}" if i % 6 < 2 else None, i % 6 == 1, i % 8 == 3, i % 2 == 0, i % 5 != 0, "referenced-as-value" if i % 10 == 0 else None, ("di", "none", None)[i % 3], i % 2) for i in range(n - 2)]
    known = spark.createDataFrame(facts, "node long, label string, file string, entry_type string, entry_name string, passes boolean, module_level boolean, starts_app boolean, complete boolean, reason string, caller_state string, test_callers int")
    starts = spark.createDataFrame([(i, i % 30, True) for i in range(0, 40, 3)], "id long, node long, risky boolean")
    wanted = sorted(map(str, impact.walked(starts, df, known, 2, most).drop("via", "through_stale").collect()))
    assert sorted(map(str, impact.ends_without_ways(starts, df.union(df), known, 2, most).collect())) == wanted


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    from spanloom.operators.tables import stored

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.getNumCachedSerializedBroadcast(), tracker.shuffleStatuses().size()
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "left-over")
    assert table.count() == 7
    spark.range(10).agg(F.count("*")).collect()
    statuses = tracker.shuffleStatuses()
    assert statuses.size() <= before[1] + 2  # those of the two counts
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_settled_keys_shuffle_no_texts(spark):
    from spanloom.operators import evidence

    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    noise = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.md5(F.concat("id", i.cast("string")))), "")
    edits = spark.range(400).select(F.col("id").alias("item"), F.lit(0).alias("record"), noise.alias("literal"), F.when(F.col("id") < 50, "$ $").alias("shape"), (F.col("id") % 3).cast("string").alias("grp"))
    before = written()
    rows = evidence.settled_keys(edits, "item", "record", "literal", "shape", "grp").collect()
    assert {(r.level, r.shape) for r in rows if r.item < 50} == {("shape", "$ $")} and {(r.level, r.shape) for r in rows if r.item >= 50} == {(None, None)} and len(rows) == 400
    assert written() - before < 400 * 1920 / 4  # the literals have 1,920 characters each


def test_phrases_of_common_words_meet_only_their_own_occurrences(spark):
    from spanloom.functions import code

    files = spark.range(100).select(F.col("id").cast("string").alias("path"), F.repeat(F.concat(F.lit("the w"), F.col("id").cast("string"), F.lit(" ")), 20).alias("text"))
    wanted = spark.range(100).select(F.concat(F.lit("the w"), F.col("id").cast("string")).alias("token"))
    before = shuffled(spark)
    assert {(r.files, r.partial) for r in code.word_files(wanted, files).collect()} == {(1, False)}
    assert shuffled(spark) - before < 100 * 20 * 20  # every "the" with every phrase: 200,000 rows


def test_similar_sets_of_a_family_are_not_shuffled_for_each_pair(spark):
    from spanloom.operators import sets

    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written() -> int:
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rows = spark.range(60).select("id", F.concat(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.md5(i.cast("string"))), F.array(F.concat(F.lit("own"), F.col("id").cast("string")))).alias("tokens"))
    before = written()
    got = sets.similar_sets(rows, 60).collect()
    assert {(r.a, r.b, r.common, r.total) for r in got} == {(a, b, 500, 502) for a in range(60) for b in range(a + 1, 60)} and len(got) == 1770
    assert written() - before < 1770 * 500 * 8 / 2  # half of one set's numbers for each pair
