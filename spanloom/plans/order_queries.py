"""Queries over the orders, states and selections of a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import callers, hints, orders, ranking, retention, review, sets
from .tables import line_spans, table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows: ``id, path, level, attention, rows, parent, kind, files, sweep, flagged, ord``."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    kind = F.when(k % 3 == 0, "folder").when(k % 3 == 1, "file").otherwise("row")
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.col("c_name").alias("path"), F.col("c_name").alias("label"), (nation % 5).alias("level"), (k % 4).alias("attention"), (k % 7).alias("rows"), nation.alias("parent"), nation.alias("card"), kind.alias("kind"),
        (k % 11).alias("files"), (k % 9 == 0).alias("sweep"), (k % 4 == 0).alias("flagged"), k.alias("ord"), F.floor("c_acctbal").cast("long").alias("score"), (k % 8 == 0).alias("outside"), (k % 13).alias("line"))


def q92_changes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by score and name."""
    return orders.changes(_customers(spark, sf_dir)).select("id", "position")


def _mixed_name(number: Column) -> Column:
    """Names that people order differently than codes do: small and capital letters mixed, of several lengths."""
    letter = F.substring(F.lit("bBaAdDcC"), (number % 8 + 1).cast("int"), F.lit(1))
    return F.concat(letter, F.repeat(F.lit("x"), (number % 3).cast("int")), (number % 5).cast("string"), F.when(number % 2 == 0, F.lit("e")).otherwise(F.lit("E")))


def q92b_mixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year and a name in which small and capital letters mix."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.year("o_orderdate").alias("score"), _mixed_name(k).alias("label"), k.alias("ord"))
    return orders.changes(rows).select("id", "label", "position")


def q93_files_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files: level, attention, rows, path."""
    return orders.files(_customers(spark, sf_dir)).select("id", "position")


def q94_tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as folders, files and rows of their nation."""
    return orders.tree(_customers(spark, sf_dir)).select("parent", "id", "position")


def q95_card_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards: sweeps last, flagged first, larger first."""
    return orders.card_groups(_customers(spark, sf_dir)).select("id", "position")


def q96_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of their nation's card, worst first."""
    return orders.card_rows(_customers(spark, sf_dir)).select("card", "id", "position")


def q97_file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a file (their nation): level, top-level lines last, line."""
    return orders.file_rows(_customers(spark, sf_dir).withColumn("path", F.col("parent").cast("string"))).select("path", "id", "position")


def q98_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading rank of customers in their nation's card by attention and kind."""
    kinds = F.array(*[F.lit(k) for k in ("changed", "may-change", "new", "same")])
    rows = _customers(spark, sf_dir).withColumn("kind", F.get(kinds, (F.col("id") % 6).cast("int"))).withColumn("attention", F.col("flagged"))
    return orders.reading(rows).select("card", "id", "position")


def q99_callers_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each customer as callers, by priority (path) and status (label)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("change"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("label"), F.col("o_orderkey").alias("ord"))
    return orders.expanded_callers(rows).select("change", "ord", "position")


def q100_seam_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as seams of two or three cards in order, and their counts by kind."""
    kinds = F.array(*[F.lit(k) for k in hints.SEAM_TYPES])
    name = lambda n: F.concat(F.lit("K"), n.cast("string"))
    k = F.col("p_partkey")
    cards = F.when(k % 2 == 0, F.array(name(k % 12), name(k % 12 + 5))).otherwise(F.array(name(k % 12), name(k % 12 + 3), name(k % 12 + 9)))
    seams = table(spark, sf_dir, "part").select(k.alias("id"), F.get(kinds, (F.col("p_size") % 4).cast("int")).alias("type"), cards.alias("cards"), F.concat("p_name", F.lit("#"), F.lpad(k.cast("string"), 9, "0")).alias("place"))
    return hints.seam_order(seams).select("id", "position")


def q101_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of order lines (their part's type) made unique in order of lines."""
    rows = line_spans(spark, sf_dir).select(F.col("k").alias("path"), "ord", (F.col("part") % 3).cast("string").alias("key"), F.col("ord").alias("start"))
    return orders.overloads(rows).select("path", "ord", "unique_key")


def q102_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose customers mix market segments, by balance."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_nationkey", F.lit("|"), F.floor(F.col("c_custkey") / 3)).alias("path"), F.col("c_mktsegment").alias("container"))
    return orders.marked_containers(rows).select("c_custkey", "mixed")


def q103_file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as callers of an order, by supplier's group as a file."""
    states = F.array(*[F.lit(s) for s in review.CALL_STATES])
    rows = line_spans(spark, sf_dir).select("k", F.concat(F.lit("f"), (F.col("supp") % 3).cast("string")).alias("path"), F.get(states, (F.col("part") % 3).cast("int")).alias("call_state"), (F.col("part") % 5 == 0).alias("changed"), (F.col("flag") == "R").alias("is_test"), F.col("lo").alias("sites"))
    return review.file_groups(rows, ["k"])


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(k.alias("thread"), F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("path"), F.when(k % 3 == 0, "LEFT").otherwise("RIGHT").alias("side"), F.when(k % 10 != 0, F.floor("value").cast("int")).alias("line"), (k % 7 == 0).alias("outdated"), (k % 11 == 0).alias("file_level"))


def q104_threads_of_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as threads on ranges of ten lines, one for each nation."""
    ranges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row"), F.concat(F.lit("p"), (F.col("n_nationkey") % 20).cast("string")).alias("path"), (F.col("n_nationkey") * 3).cast("int").alias("lo"), (F.col("n_nationkey") * 3 + 10).cast("int").alias("hi"))
    return review.threads_of_range(_threads(spark, sf_dir), ranges)


def q105_threads_of_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as threads drawn on the left, in order."""
    return review.threads_of_side(_threads(spark, sf_dir), "LEFT").select("path", "thread", "line", "position")


def q106_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes by what is not known of them."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pick(("covered", "uncovered", "unknown", "not-computed"), F.col("o_orderkey")).alias("test_state"), pick(("resolved", "none", "di", "unknown", "resolved"), F.col("o_orderkey")).alias("caller_state"))
    return review.state_subsets(rows)


def q107_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Url paths by language rules, the first of which owns a path."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))
    rules = [("french", r"/fr/", r"[13579]$"), ("com", r"\.com/", r"/de/"), ("all", r"example", r"^x")]
    return callers.routed(pages, rules).select("page_id", "language", "is_test")


def q108_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five event types that each user used last."""
    uses = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("value"), F.col("event_id").alias("ord"))
    return retention.recent(uses)


def q109_picker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pull requests in sections: three recent ones, then by segment."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.when(F.col("c_mktsegment") == "BUILDING", "requested").when(F.col("c_mktsegment") == "MACHINERY", "own").otherwise("others").alias("grp"), F.col("c_custkey").alias("ord"))
    return retention.picker_rows(rows, spark.createDataFrame([(7, 1), (3, 2), (-1, 3), (11, 4)], "number long, position long"))


def q110_used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as review keys with their last order among the fifty newest."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    usage = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last_used_ms"))
    return retention.used_keys(keys, usage, 50)


def q111_round_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as items of rounds with statuses and changes."""
    k = F.col("o_orderkey")
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("round"), k.alias("item"))
    pick = lambda names: F.get(F.array(*[F.lit(x) for x in names]), (k % len(names)).cast("int"))
    orders_ = table(spark, sf_dir, "orders")
    statuses = orders_.where(k % 9 != 0).select(F.col("o_custkey").alias("round"), k.alias("item"), pick(("done", "skipped", "none", "unreadable")).alias("status"), F.when(k % 4 == 1, "why").alias("reason"))
    changed = orders_.where(k % 5 != 0).select(F.col("o_custkey").alias("round"), k.alias("item"), pick(("changed", "unchanged", "unknown", "changed", "changed", "changed", "changed")).alias("change"))
    return retention.round_rows(items, statuses, changed)


def q112_next_unreviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next and previous event of a user that is no click, wrapping around once."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("reviewed"))
    return ranking.next_unreviewed(events, ["user_id"], ["event_id"], "event_id", "reviewed").drop("reviewed")


def q113_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments and order priorities as one list of paths, each where it was first seen."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("path")).agg(F.min("c_custkey").alias("ord"))
    b = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("BUILDING").alias("path"), F.col("o_orderkey").alias("ord"))
    return sets.first_seen([a, b], "path")


def q114_with_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with at least four orders get cards."""
    return callers.with_cards(table(spark, sf_dir, "orders"), "o_custkey")


def q115_caller_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order as callers with the first five lines."""
    sites = line_spans(spark, sf_dir).select(F.col("k").alias("change"), (F.col("supp") % 4).cast("string").alias("path"), F.lit(0).alias("pos"), F.lit("f").alias("label"), F.col("lo").alias("line"))
    return callers.caller_rows(sites, 3).select("change", "path", F.array_join(F.transform("lines", lambda x: x.cast("string")), " ").alias("lines"), "total")


def q116_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and types that name each other, and numbers of queries."""
    word = F.substring_index("p_name", " ", 1)
    query = F.concat(F.when(F.col("p_partkey") % 2 == 0, "# ").otherwise(""), (F.col("p_partkey") % 40).cast("string"), F.when(F.col("p_partkey") % 5 == 0, "x").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", t.names_match(F.upper("p_name"), word).alias("same"), t.names_match(F.col("p_type"), word).alias("other"), t.pull_number(query).alias("number"))


def q117_shape_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of shape keys in words."""
    k = F.col("p_partkey")
    part = F.when(k % 4 == 0, F.concat(F.lit("⟪"), (k % 3).cast("string"), F.lit(" → "), (k % 5 + 1).cast("string"), F.lit("⟫"))).when(k % 4 == 1, F.concat("p_name", F.lit(" → "))).when(k % 4 == 2, F.concat(F.lit(" → "), "p_type")).otherwise(F.concat("p_name", F.when(k % 3 == 0, " ").otherwise(" → "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", t.shape_words(part).alias("words"))


def q118_worktrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each customer's orders as a worktree: one digest, whatever the order of files; some files are missing."""
    stamp = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(t.worktree_identity(F.lit("head"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), stamp).alias("identity"))


def q119_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by language as a run's counts: files, and those whose url has a query (findings)."""
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://[^/]*/(\w\w)/", 1).alias("language"), F.col("url").contains("?").alias("finding"))
    return pages.groupBy("language").agg(F.count("*").alias("symbols"), F.count_if("finding").alias("findings"))


QUERIES = {f.__name__: f for f in (
    q92_changes_order, q92b_mixed_names, q93_files_order, q94_tree_order, q95_card_groups, q96_card_rows, q97_file_rows, q98_reading, q99_callers_order, q100_seam_order, q101_overloads, q102_containers, q103_file_groups, q104_threads_of_ranges, q105_threads_of_side, q106_subsets,
    q107_routed, q108_recent, q109_picker, q110_used_keys, q111_round_rows, q112_next_unreviewed, q113_first_seen, q114_with_cards, q115_caller_rows, q116_names, q117_shape_words, q118_worktrees, q119_run_counts)}

_THREADS = "threads AS (SELECT event_id AS thread, 'p' || (user_id % 20) AS path, CASE WHEN event_id % 3 = 0 THEN 'LEFT' ELSE 'RIGHT' END AS side, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value) AS INT) END AS line FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0)"
_LINES = "lines AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_extendedprice, l_discount, l_tax) AS ord, CAST(l_quantity AS INT) AS lo, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag FROM lineitem)"

SQL = {
    "q92_changes_order": "SELECT c_custkey AS id, row_number() OVER (ORDER BY floor(c_acctbal) DESC, c_name, c_custkey) AS position FROM customer",
    "q92b_mixed_names": """WITH n AS (SELECT o_orderkey AS id, year(o_orderdate) AS score, substr('bBaAdDcC', CAST(o_orderkey % 8 + 1 AS INT), 1) || repeat('x', CAST(o_orderkey % 3 AS INT)) || (o_orderkey % 5) || CASE WHEN o_orderkey % 2 = 0 THEN 'e' ELSE 'E' END AS label FROM orders)
        SELECT id, label, row_number() OVER (ORDER BY score DESC, lower(label), translate(label, 'abcdeABCDE', 'ABCDEabcde'), id) AS position FROM n""",
    "q93_files_order": "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_nationkey % 5, c_custkey % 4 DESC, c_custkey % 7 DESC, c_name) AS position FROM customer",
    "q94_tree_order": "SELECT c_nationkey AS parent, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_nationkey % 5, c_custkey % 4 DESC, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 11 WHEN 1 THEN c_custkey % 7 ELSE 1 END DESC, c_name) AS position FROM customer",
    "q95_card_groups": "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey % 9 = 0, c_custkey % 4 = 0 DESC, c_custkey % 7 DESC, c_custkey) AS position FROM customer",
    "q96_card_rows": "SELECT c_nationkey AS card, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 4 = 0 DESC, c_nationkey % 5, c_custkey) AS position FROM customer",
    "q97_file_rows": "SELECT CAST(c_nationkey AS VARCHAR) AS path, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_nationkey % 5, c_custkey % 8 = 0, c_custkey % 13, c_custkey) AS position FROM customer",
    "q98_reading": "SELECT c_nationkey AS card, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 4 = 0 DESC, CASE WHEN c_custkey % 6 < 4 THEN c_custkey % 6 ELSE 9 END, c_custkey) AS position FROM customer",
    "q99_callers_order": "SELECT o_custkey AS change, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS position FROM orders",
    "q100_seam_order": """SELECT p_partkey AS id, row_number() OVER (ORDER BY p_size % 4, CASE WHEN p_partkey % 2 = 0 THEN 'K' || lpad(CAST(p_partkey % 12 AS VARCHAR), 6, '0') || ',K' || lpad(CAST(p_partkey % 12 + 5 AS VARCHAR), 6, '0')
        ELSE 'K' || lpad(CAST(p_partkey % 12 AS VARCHAR), 6, '0') || ',K' || lpad(CAST(p_partkey % 12 + 3 AS VARCHAR), 6, '0') || ',K' || lpad(CAST(p_partkey % 12 + 9 AS VARCHAR), 6, '0') END, p_name || '#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS position FROM part""",
    "q101_overloads": f"WITH {_LINES}, n AS (SELECT k, ord, part % 3 AS key, row_number() OVER (PARTITION BY k, part % 3 ORDER BY ord) AS n FROM lines) SELECT k AS path, ord, key || CASE WHEN n > 1 THEN '#overload' || n ELSE '' END AS unique_key FROM n",
    "q102_containers": "SELECT c_custkey, min(c_mktsegment) OVER w <> max(c_mktsegment) OVER w AS mixed FROM customer WINDOW w AS (PARTITION BY c_nationkey, c_custkey // 3)",
    "q103_file_groups": f"""WITH {_LINES} SELECT k, 'f' || (supp % 3) AS path, count(*) AS callers, ['updated-at-call', 'changed-elsewhere', 'unchanged'][max(part % 3) + 1] AS call_state, bool_or(part % 5 = 0) AS changed, bool_and(flag = 'R') AS is_test, CAST(sum(lo) AS BIGINT) AS sites, count(*) = 1 AS flat FROM lines GROUP BY 1, 2""",
    "q104_threads_of_ranges": f"WITH {_THREADS} SELECT n_nationkey AS row, thread, path, line FROM threads JOIN nation ON path = 'p' || (n_nationkey % 20) AND line BETWEEN n_nationkey * 3 AND n_nationkey * 3 + 10 WHERE side = 'RIGHT'",
    "q105_threads_of_side": f"WITH {_THREADS} SELECT path, thread, line, row_number() OVER (PARTITION BY path ORDER BY line, thread) AS position FROM threads WHERE side = 'LEFT' AND line IS NOT NULL",
    "q106_subsets": "SELECT 'untested' AS subset, o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 1 UNION ALL SELECT 'test_unknown', o_orderkey FROM orders WHERE o_orderkey % 4 = 2 UNION ALL SELECT 'unknown_callers', o_orderkey FROM orders WHERE o_orderkey % 5 IN (2, 3)",
    "q107_routed": r"""SELECT page_id, CASE WHEN contains(p, '/fr/') THEN 'french' WHEN contains(p, '.com/') THEN 'com' WHEN contains(p, 'example') THEN 'all' END AS language,
        CASE WHEN contains(p, '/fr/') THEN regexp_matches(p, '[13579]$') WHEN contains(p, '.com/') THEN contains(p, '/de/') WHEN contains(p, 'example') THEN starts_with(p, 'x') ELSE false END AS is_test FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS p FROM pages)""",
    "q108_recent": "WITH l AS (SELECT user_id AS \"user\", event_type || (event_id % 3) AS value, max(event_id) AS o FROM events GROUP BY 1, 2) SELECT \"user\", value, row_number() OVER (PARTITION BY \"user\" ORDER BY o DESC) AS position FROM l QUALIFY position <= 5",
    "q109_picker": """WITH p AS (SELECT c_custkey AS number, CASE WHEN c_custkey IN (7, 3, 11) THEN 'recent' WHEN c_mktsegment = 'BUILDING' THEN 'requested' WHEN c_mktsegment = 'MACHINERY' THEN 'own' ELSE 'others' END AS section FROM customer)
        SELECT section, number, row_number() OVER (ORDER BY list_position(['recent', 'requested', 'own', 'others'], section), CASE number WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 11 THEN 4 ELSE number END, number) AS position FROM p""",
    "q110_used_keys": "WITH u AS (SELECT o_custkey AS key, max(epoch_ms(o_orderdate)) AS last_used_ms FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50) SELECT c_custkey AS key, last_used_ms FROM customer LEFT JOIN u ON key = c_custkey",
    "q111_round_rows": """WITH r AS (SELECT o_custkey AS round, o_orderkey AS item, CASE WHEN o_orderkey % 9 <> 0 THEN ['done', 'skipped', 'none', 'unreadable'][o_orderkey % 4 + 1] ELSE 'unreadable' END AS status,
            CASE WHEN o_orderkey % 9 = 0 THEN 'not in the status list' WHEN o_orderkey % 4 = 1 THEN 'why' END AS reason, CASE WHEN o_orderkey % 5 <> 0 THEN CASE o_orderkey % 7 WHEN 1 THEN 'unchanged' WHEN 2 THEN 'unknown' ELSE 'changed' END ELSE 'unknown' END AS change FROM orders)
        SELECT *, NOT (change = 'changed' AND status IN ('done', 'none')) AS attention FROM r""",
    "q112_next_unreviewed": """WITH o AS (SELECT user_id, event_id FROM events WHERE event_type <> 'click') SELECT user_id, event_id, coalesce((SELECT min(event_id) FROM o WHERE o.user_id = e.user_id AND o.event_id > e.event_id), nullif((SELECT min(event_id) FROM o WHERE o.user_id = e.user_id), event_id)) AS next_id,
        coalesce((SELECT max(event_id) FROM o WHERE o.user_id = e.user_id AND o.event_id < e.event_id), nullif((SELECT max(event_id) FROM o WHERE o.user_id = e.user_id), event_id)) AS previous_id FROM events e""",
    "q113_first_seen": """WITH p AS (SELECT c_mktsegment AS path, 0 AS part, min(c_custkey) AS ord FROM customer GROUP BY 1 UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'BUILDING' END, 1, min(o_orderkey) FROM orders GROUP BY 1)
        SELECT path, part, ord FROM p QUALIFY row_number() OVER (PARTITION BY path ORDER BY part, ord) = 1""",
    "q114_with_cards": "SELECT o_custkey, count(*) AS changes FROM orders GROUP BY 1 HAVING count(*) >= 4",
    "q115_caller_rows": f"WITH {_LINES} SELECT k AS change, CAST(supp % 4 AS VARCHAR) AS path, array_to_string(list_sort(list(lo))[1:3], ' ') AS lines, count(*) AS total FROM lines GROUP BY 1, 2",
    "q116_names": """SELECT p_partkey, length(string_split(p_name, ' ')[1]) > 1 AS same, contains(lower(p_type), lower(string_split(p_name, ' ')[1])) OR contains(lower(string_split(p_name, ' ')[1]), lower(p_type)) AS other,
        CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 40 >= 1 THEN CAST(p_partkey % 40 AS INT) END AS number FROM part""",
    "q117_shape_words": """WITH n AS (SELECT *, p_partkey % 3 AS g, p_partkey % 5 + 1 AS c FROM part) SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN g = 0 THEN c || CASE WHEN c = 1 THEN ' token added' ELSE ' tokens added' END ELSE g || CASE WHEN g = 1 THEN ' token' ELSE ' tokens' END || ' replaced by ' || c END
        WHEN 1 THEN 'removed `' || p_name || '`' WHEN 2 THEN 'added `' || p_type || '`' ELSE CASE WHEN g = 0 THEN p_name || ' ' || p_type ELSE '`' || p_name || '` replaced by `' || p_type || '`' END END AS words FROM n""",
    "q118_worktrees": "SELECT o_custkey, sha256('head' || string_agg(lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || chr(0) || CASE WHEN o_orderkey % 10 <> 0 THEN o_orderstatus ELSE 'missing' END || chr(0), '' ORDER BY o_orderkey)) AS identity FROM orders GROUP BY 1",
    "q119_run_counts": r"SELECT regexp_extract(url, '://[^/]*/(\w\w)/', 1) AS language, count(*) AS symbols, count_if(contains(url, '?')) AS findings FROM pages GROUP BY 1",
}
