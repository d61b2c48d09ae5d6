"""Queries over rows and groups: orders, caps, budgets, pages, states, text and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import ranking, retention, review
from .tables import line_spans, table

def _millis(column: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz"))


_NOW = 1_706_745_600_000  # 2024-02-01, after every event


def q26_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by balance (falling), name and key, with their position in each segment."""
    return ranking.top_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_name"), F.col("c_custkey")], 1 << 30, rank="position").select("c_mktsegment", "c_custkey", "position")


def q27_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five lines of each order with the true count."""
    capped = ranking.capped_list(line_spans(spark, sf_dir), ["k"], F.col("part"), [F.col("ord")], 5)
    return capped.select("k", "total", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


def q28_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source up to a budget of characters."""
    return ranking.within_budget(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), ["source"], ["doc_id"], "n_chars", 20_000)


def q29_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of customers by balance."""
    return ranking.page(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], 3, 25).drop("page_size")


def q30_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next and previous event of each user, wrapping around."""
    return ranking.neighbours(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id").drop("ts")


def q31_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as snapshots of their users (branches): the plan with reasons; every fourth has no round, event 5 is the current one, users of every third number are gone."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("sha"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 7).alias("round"), F.col("user_id").alias("branch"), _millis("ts").alias("created_ms"))
    live = events.where("branch % 3 <> 0").select("branch").distinct()
    return retention.cleanup_plan(events, live, now_ms=_NOW, keep=40, max_age_ms=20 * 86_400_000, grace_ms=12 * 86_400_000, current="5")


def q31b_cleanup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bytes of the plan by reason."""
    return retention.summary(q31_cleanup(spark, sf_dir).withColumn("bytes", F.col("id") % 1000), "bytes")


def q32_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantities by flag and status, with subtotals."""
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


def q33_review_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with an assistant turn of more than 200 characters."""
    turns = table(spark, sf_dir, "conversations")
    parents = turns.groupBy("conv_id").agg(F.count("*").alias("turns"))
    return review.parents_with_matching_children(parents, turns, "conv_id", (F.col("role") == "assistant") & (F.length("text") > 200))


def q33b_filtered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files under each of the four filters, with how many of their turns pass: ``mode, path, passing``."""
    turns = table(spark, sf_dir, "conversations")
    files = turns.groupBy(F.col("conv_id").alias("path")).agg(F.max((F.col("conv_id") % 7 == 0).cast("int")).alias("threads"))
    rows = turns.select(F.col("conv_id").alias("path"), ((F.col("role") == "assistant") & (F.length("text") > 200)).alias("attention"), (F.col("turn") % 3 == 0).alias("reviewed"), F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), 1).alias("threads"))
    out = None
    for mode in review.FILTERS:
        shown, kept = review.filtered_files(files, rows, mode)
        found = shown.join(kept.groupBy("path").agg(F.count("*").alias("passing")), "path", "left").select(F.lit(mode).alias("mode"), "path", F.coalesce("passing", F.lit(0)).alias("passing"))
        out = found if out is None else out.unionByName(found)
    return out


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("role") == "user").alias("pending"), ((F.col("role") == "system") & (F.col("conv_id") % 2 == 0)).alias("resolved"))


def q34_thread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with posted and pending comments, open or not."""
    return review.thread_counts(_comments(spark, sf_dir), ["conv_id"])


def q37_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path algebra on urls."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", t.top_folder(F.col("path")).alias("top"), t.tail(F.col("path")).alias("tail"), t.base_name(F.col("path")).alias("base"), t.folder(F.col("path")).alias("folder"))


def q38_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First line of each turn read as a status, behind words that a status may begin with."""
    words = F.array(*[F.lit(x) for x in ("", "done ", "**Skipped** — ", "donefor ", "skipped:", "__done__,")])
    line = F.when(F.col("turn") % 7 == 6, "").otherwise(F.concat(F.get(words, (F.col("turn") + F.col("conv_id")).cast("int") % 6), F.split(F.coalesce("text", F.lit("")), "\n")[0]))
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.status_line(line).alias("s"))
    return s.select("conv_id", "turn", "s.status", "s.reason")


def q39_one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one line of at most 120 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", t.one_line(F.col("text"), 120).alias("line"))


def q40_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper median and largest value of each event type."""
    return ranking.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")


def q41_agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one status that a conversation's turns give: system turns say nothing, users are done, others skip with one of two reasons."""
    said = F.when(F.col("role") == "system", "").when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), "done").otherwise(F.concat(F.lit("skipped: r"), (F.col("conv_id") % 2 * F.col("turn") % 2).cast("string")))
    lines = table(spark, sf_dir, "conversations").select("conv_id", t.status_line(said).alias("s")).select("conv_id", "s.status", "s.reason")
    return review.agreed(lines, ["conv_id"], "status", "reason")


def q41b_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders complete only if no line was returned; the ship modes of returned lines as reasons."""
    parts = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("complete"), F.col("l_linestatus").alias("reason"))
    done = review.completeness(parts, ["l_orderkey"])
    return done.select("l_orderkey", "complete", F.array_join("reasons", ",").alias("reasons"))


def q42_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types in a closed vocabulary."""
    kind = t.classified(F.col("event_type"), [("^(click|view)", "browse"), ("purchase|cart", "buy")])
    return table(spark, sf_dir, "events").groupBy(kind.alias("family")).agg(F.count("*").alias("n"))


def q43_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes less ten, by four, as counts from 1 to 8 with warnings; sizes of 50 are left out."""
    value = F.when(F.col("p_size") != 50, (F.col("p_size") - 10) / 4.0)
    c = table(spark, sf_dir, "part").select("p_partkey", t.clamped(value, 8, 3).alias("c"))
    return c.select("p_partkey", "c.value", "c.warning")


def q44_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content identities of documents and how many share one."""
    return table(spark, sf_dir, "documents").groupBy(t.content_id(F.col("text")).alias("content_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


def q46_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in the first group that fits: recent (ordered in the last month), mine (one segment), others."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    joined = table(spark, sf_dir, "customer").join(last, "c_custkey", "left")
    group = F.when(F.col("last") >= newest - F.expr("INTERVAL 30 DAYS"), "recent").when(F.col("c_mktsegment") == "BUILDING", "mine").otherwise("others")
    return joined.select("c_custkey", group.alias("grp"))


def q47_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON properties."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def q48_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events strictly older than ten days at the newest event."""
    events = table(spark, sf_dir, "events").select("event_id", _millis("ts").alias("ms"))
    return events.where(retention.older_than(F.col("ms"), events.agg(F.max("ms")).scalar(), 10 * 86_400_000)).select("event_id")


def q62_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict level and attention of every order from its lines; every eleventh is built by a container, every fifth has no lines searched."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("callers"), F.count_if(F.col("l_returnflag") == "R").alias("stale"))
    orders = table(spark, sf_dir, "orders").join(lines.where("o_orderkey % 5 <> 0"), "o_orderkey", "left").fillna(0, ["callers", "stale"])
    state = F.when(F.col("o_orderkey") % 11 == 0, "di").when(F.col("o_orderkey") % 13 == 0, "unknown").when(F.col("callers") > 0, "resolved").otherwise("none")
    complete = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus") != "P")
    level = review.verdict_level(F.col("o_orderpriority").startswith("1"), F.col("stale"), complete, state, F.col("o_totalprice") > 1000)
    return orders.select("o_orderkey", level.alias("level")).withColumn("attention", review.attention(F.col("level"), F.col("o_orderkey") % 97 == 0, F.col("level") < 5))


def q63_review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review progress over the verdicts."""
    return review.review_counts(q62_verdicts(spark, sf_dir).withColumn("reviewed", F.col("o_orderkey") % 2 == 0))


def q64_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest five orders of the ten customers who ordered last."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("head"), F.col("o_orderdate").alias("stored_at"), F.col("o_orderkey").alias("id"))
    return retention.newest_heads(orders, per_head=5, heads=10).select("head", "id")


def q65_rederived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caller states of orders after returned lines are filtered out."""
    before = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("complete"))
    kept = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return review.rederived_state(before, kept, "o_orderkey")


def q66_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types split at the last space as container and name, test-like or not."""
    label = t.container_and_name(F.replace("p_type", F.lit(" "), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", label["container"].alias("container"), label["name"].alias("name"), t.is_test_like(F.col("p_name")).alias("test"))


def q67_remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen event type of each user where purchase is set: there, or a bad setting."""
    events = table(spark, sf_dir, "events").where("value > 95").select(F.col("user_id").alias("repo"), F.col("event_type").alias("name"))
    return retention.chosen_remote(events, "purchase")


def q67b_unset_remotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen event type of each user without a setting, view standing for upstream and click for origin; large values name none."""
    name = F.when(F.col("event_type") == "view", "upstream").when(F.col("event_type") == "click", "origin").otherwise(F.col("event_type"))
    events = table(spark, sf_dir, "events").where("value > 98").select(F.col("user_id").alias("repo"), F.when(F.col("value") < 99.5, name).alias("name"))
    return retention.chosen_remote(events, None)


def q68_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers of customers' pull requests: asked by urgent orders (also teams), heard by the others, with their states in order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("number"), "o_orderkey", "o_orderpriority", F.concat(F.lit("u"), (F.col("o_orderkey") % 6).cast("string")).alias("name"))
    kind = F.when(F.col("o_orderkey") % 4 == 0, "team").otherwise("user")
    states = F.array(*[F.lit(x) for x in ("PENDING", "COMMENTED", "APPROVED", "CHANGES_REQUESTED", "DISMISSED")])
    asked = orders.where("o_orderpriority LIKE '1%'").select("number", kind.alias("kind"), "name")
    heard = orders.where("o_orderpriority NOT LIKE '1%'").select("number", "name", F.get(states, (F.col("o_orderkey") % 5).cast("int")).alias("state"), F.col("o_orderkey").alias("ord"))
    authors = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("number"), F.concat(F.lit("u"), (F.col("c_custkey") % 6).cast("string")).alias("author"))
    return review.reviewers(asked, heard, authors)


QUERIES = {f.__name__: f for f in (
    q26_ordered, q27_capped, q28_budget, q29_page, q30_neighbours, q31_cleanup, q31b_cleanup_summary, q32_rollup, q33_review_filter, q33b_filtered_files, q34_thread_counts, q37_paths, q38_status, q39_one_line,
    q40_upper_median, q41_agreed, q41b_completeness, q42_families, q43_clamped, q44_content_ids, q46_grouped, q47_props, q48_older, q62_verdicts, q63_review_counts, q64_newest, q65_rederived, q66_labels, q67_remotes, q67b_unset_remotes, q68_reviewers)}

_PLAN = f"""snaps AS (SELECT event_id AS id, CAST(event_id AS VARCHAR) AS sha, CASE WHEN event_id % 4 <> 0 THEN event_id % 7 END AS round, user_id AS branch, epoch_us(ts) // 1000 AS created_ms FROM events),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY round IS NULL ORDER BY created_ms DESC, id) AS r FROM snaps),
    judged AS (SELECT *, CASE WHEN sha = '5' THEN 'current' WHEN round IS NULL THEN CASE WHEN {_NOW} - created_ms > 12 * 86400000 THEN 'replaced' ELSE 'just replaced' END WHEN r <= 40 THEN 'newest'
        WHEN {_NOW} - created_ms > 20 * 86400000 THEN 'too old' WHEN branch % 3 = 0 THEN 'branch gone' ELSE 'kept' END AS reason FROM ranked),
    plan AS (SELECT id, sha, round, branch, created_ms, CASE WHEN reason IN ('replaced', 'too old', 'branch gone') THEN 'delete' ELSE 'keep' END AS action, reason FROM judged)"""
_PATH = r"(SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)"
_VERDICTS = """base AS (SELECT o.*, o_orderpriority LIKE '1%' AS risky, coalesce(callers, 0) AS callers, coalesce(stale, 0) AS stale, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus <> 'P' END AS complete
        FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS callers, count_if(l_returnflag = 'R') AS stale FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey),
    stated AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'di' WHEN o_orderkey % 13 = 0 THEN 'unknown' WHEN callers > 0 THEN 'resolved' ELSE 'none' END AS state FROM base),
    verdicts AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 1000 THEN 5
        WHEN risky THEN CASE WHEN stale > 0 THEN 0 WHEN complete = false OR state IN ('di', 'unknown') THEN 1 ELSE 2 END
        WHEN state = 'none' AND (complete IS NULL OR complete) THEN 4 ELSE 3 END AS level FROM stated),
    attended AS (SELECT o_orderkey, level, level <= 1 OR o_orderkey % 97 = 0 OR level >= 5 AS attention FROM verdicts)"""
_STATUS = r"""status AS (SELECT *, CASE WHEN x = '' THEN 'none' WHEN regexp_matches(x, '(?is)^done($|[^\p{L}\p{N}_])') THEN 'done' WHEN regexp_matches(x, '(?is)^skipped($|[^\p{L}\p{N}_])') THEN 'skipped' ELSE 'unreadable' END AS status,
    substr(trim(regexp_replace(regexp_extract(x, '(?is)^skipped\s*(?:(?:—|–|--|-|:)\s*)?(.*)$', 1), '[*_`\s]+$', '')), 1, 500) AS why FROM (SELECT *, regexp_replace(trim(line), '^[*_`\s]+', '') AS x FROM raw)),
    said AS (SELECT *, CASE WHEN status = 'unreadable' THEN 'unrecognised status: ' || substr(x, 1, 60) WHEN status = 'skipped' AND why <> '' THEN why END AS reason FROM status)"""

SQL = {
    "q26_ordered": "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name, c_custkey) AS position FROM customer",
    "q27_capped": "SELECT l_orderkey AS k, count(*) AS total, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY ord) FILTER (ord <= 5) AS items FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_extendedprice, l_discount, l_tax) AS ord FROM lineitem) GROUP BY 1",
    "q28_budget": "SELECT doc_id, source, n_chars, CAST(running AS BIGINT) AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) WHERE running <= 20000",
    "q29_page": "SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position, (SELECT count(*) FROM customer) AS total, CAST(ceil((SELECT count(*) FROM customer) / 25.0) AS BIGINT) AS pages FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50",
    "q30_neighbours": "SELECT user_id, event_id, coalesce(lead(event_id) OVER w, first_value(event_id) OVER v) AS next_id, coalesce(lag(event_id) OVER w, last_value(event_id) OVER v) AS previous_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "q31_cleanup": f"WITH {_PLAN} SELECT * FROM plan",
    "q31b_cleanup_summary": f"WITH {_PLAN} SELECT action, reason, count(*) AS n, CAST(sum(id % 1000) AS BIGINT) AS bytes FROM plan GROUP BY 1, 2",
    "q32_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "q33_review_filter": "SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant' AND length(text) > 200)",
    "q33b_filtered_files": """WITH r AS (SELECT conv_id AS path, coalesce(role = 'assistant' AND length(text) > 200, false) AS attention, coalesce(turn % 3 = 0, false) AS reviewed, role = 'user' AND conv_id % 3 = 0 AS threads FROM conversations),
        g AS (SELECT path, count(*) AS every, count_if(attention AND NOT reviewed) AS attention, count_if(NOT reviewed) AS unreviewed, count_if(threads) AS threads FROM r GROUP BY path)
        SELECT 'all' AS mode, path, every AS passing FROM g UNION ALL SELECT 'attention', path, attention FROM g WHERE attention > 0 UNION ALL SELECT 'unreviewed', path, unreviewed FROM g WHERE unreviewed > 0
        UNION ALL SELECT 'threads', path, threads FROM g WHERE threads > 0 OR path % 7 = 0""",
    "q34_thread_counts": "SELECT conv_id, count_if(role <> 'user') AS posted, count_if(role = 'user') AS pending, NOT bool_or(role = 'system' AND conv_id % 2 = 0) AND bool_or(role <> 'user') AS open FROM conversations GROUP BY conv_id",
    "q37_paths": rf"SELECT page_id, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE '' END AS top, regexp_replace(path, '^[^/]*/', '') AS tail, string_split(path, '/')[-1] AS base, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM {_PATH}",
    "q38_status": f"WITH raw AS (SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN '' ELSE ['', 'done ', '**Skipped** — ', 'donefor ', 'skipped:', '__done__,'][(turn + conv_id) % 6 + 1] || string_split(coalesce(text, ''), chr(10))[1] END AS line FROM conversations), {_STATUS} SELECT conv_id, turn, status, reason FROM said",
    "q39_one_line": r"WITH p AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x20\x7F]+', ' ', 'g')) AS l FROM documents) SELECT doc_id, CASE WHEN length(l) > 120 THEN substr(l, 1, 119) || '…' ELSE l END AS line FROM p",
    "q40_upper_median": "SELECT event_type, min(value) AS least, list_sort(list(value))[count(*) // 2 + 1] AS median, max(value) AS largest, count(*) AS n FROM events GROUP BY 1",
    "q41_agreed": f"""WITH raw AS (SELECT conv_id, CASE WHEN role = 'system' THEN '' WHEN role = 'user' AND conv_id % 3 = 0 THEN 'done' ELSE 'skipped: r' || (conv_id % 2 * turn % 2) END AS line FROM conversations), {_STATUS},
        g AS (SELECT conv_id, count_if(status <> 'none') AS n, count(DISTINCT CASE WHEN status <> 'none' THEN status || '|' || coalesce(reason, '') END) AS d, min(CASE WHEN status <> 'none' THEN status END) AS s, min(CASE WHEN status <> 'none' THEN reason END) AS r FROM said GROUP BY 1)
        SELECT conv_id, CASE WHEN n = 0 THEN 'none' WHEN n = 1 OR d = 1 AND s <> 'unreadable' THEN s ELSE 'unreadable' END AS status, CASE WHEN n = 0 THEN NULL WHEN n = 1 OR d = 1 AND s <> 'unreadable' THEN r ELSE 'conflicting status lines' END AS reason FROM g""",
    "q41b_completeness": "SELECT l_orderkey, bool_and(l_returnflag <> 'R') AS complete, coalesce(string_agg(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linestatus END, ',' ORDER BY CASE WHEN l_returnflag = 'R' THEN l_linestatus END), '') AS reasons FROM lineitem GROUP BY 1",
    "q42_families": "SELECT CASE WHEN trim(coalesce(event_type, '')) = '' THEN 'unknown' WHEN regexp_matches(event_type, '^(click|view)') THEN 'browse' WHEN regexp_matches(event_type, 'purchase|cart') THEN 'buy' ELSE 'other' END AS family, count(*) AS n FROM events GROUP BY 1",
    "q43_clamped": "SELECT p_partkey, CAST(CASE WHEN v IS NULL OR v < 1 THEN 3 WHEN v > 8 THEN 8 ELSE v END AS BIGINT) AS value, CASE WHEN v < 1 THEN 'not a number in range' WHEN v > 8 THEN 'above the maximum' END AS warning FROM (SELECT p_partkey, CASE WHEN p_size <> 50 THEN floor((p_size - 10) / 4.0) END AS v FROM part)",
    "q44_content_ids": "SELECT sha256(coalesce(text, '<absent>')) AS content_id, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "q46_grouped": "SELECT c_custkey, CASE WHEN last >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY THEN 'recent' WHEN c_mktsegment = 'BUILDING' THEN 'mine' ELSE 'others' END AS grp FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey",
    "q47_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "q48_older": "SELECT event_id FROM events WHERE (SELECT max(epoch_us(ts)) FROM events) // 1000 - epoch_us(ts) // 1000 > 864000000",
    "q62_verdicts": f"WITH {_VERDICTS} SELECT * FROM attended",
    "q63_review_counts": f"WITH {_VERDICTS} SELECT count(*) AS total, count_if(o_orderkey % 2 <> 0) AS unreviewed, count_if(attention) AS attention, count_if(attention AND o_orderkey % 2 <> 0) AS attention_left FROM attended",
    "q64_newest": "WITH h AS (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY max(o_orderdate) DESC, o_custkey DESC LIMIT 10) SELECT o_custkey AS head, o_orderkey AS id FROM orders WHERE o_custkey IN (FROM h) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5",
    "q65_rederived": "SELECT o_orderkey, CASE WHEN n > 0 THEN 'resolved' WHEN o_orderstatus <> 'P' THEN 'none' ELSE 'unknown' END AS state, n AS callers FROM (SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R') AS n FROM orders)",
    "q66_labels": r"SELECT p_partkey, regexp_extract(replace(p_type, ' ', '.'), '^(.*)\.[^.]+$', 1) AS container, regexp_extract(replace(p_type, ' ', '.'), '([^.]*)$', 1) AS name, len(list_intersect(string_split_regex(lower(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), ['test', 'tests', 'fake', 'fakes', 'mock', 'mocks', 'spy', 'spies', 'stub', 'stubs', 'fixture', 'fixtures'])) > 0 AS test FROM part",
    "q67_remotes": "SELECT user_id AS repo, CASE WHEN bool_or(event_type = 'purchase') THEN 'ok' ELSE 'bad-setting' END AS kind, max(event_type) FILTER (event_type = 'purchase') AS remote FROM events WHERE value > 95 GROUP BY 1",
    "q67b_unset_remotes": """WITH r AS (SELECT user_id AS repo, CASE WHEN value < 99.5 THEN CASE event_type WHEN 'view' THEN 'upstream' WHEN 'click' THEN 'origin' ELSE event_type END END AS name FROM events WHERE value > 98),
        g AS (SELECT repo, count(DISTINCT name) AS n, coalesce(max(name) FILTER (name = 'upstream'), max(name) FILTER (name = 'origin'), CASE WHEN count(DISTINCT name) = 1 THEN min(name) END) AS remote FROM r GROUP BY 1)
        SELECT repo, CASE WHEN n = 0 THEN 'none' WHEN remote IS NULL THEN 'ambiguous' ELSE 'ok' END AS kind, remote FROM g""",
    "q68_reviewers": """WITH o AS (SELECT *, 'u' || (o_orderkey % 6) AS name FROM orders), asked AS (SELECT DISTINCT o_custkey AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'team' ELSE 'user' END AS kind, name FROM o WHERE o_orderpriority LIKE '1%'),
        heard AS (SELECT o_custkey AS number, 'user' AS kind, name, arg_max(['PENDING', 'COMMENTED', 'APPROVED', 'CHANGES_REQUESTED', 'DISMISSED'][o_orderkey % 5 + 1], o_orderkey) AS state FROM o WHERE o_orderpriority NOT LIKE '1%' AND o_orderkey % 5 <> 0 AND name <> 'u' || (o_custkey % 6) GROUP BY 1, 3),
        every AS (SELECT *, 'AWAITING' AS state FROM asked UNION ALL SELECT * FROM heard h WHERE NOT EXISTS (SELECT 1 FROM asked a WHERE a.number = h.number AND a.kind = h.kind AND a.name = h.name))
        SELECT *, row_number() OVER (PARTITION BY number ORDER BY list_position(['CHANGES_REQUESTED', 'AWAITING', 'APPROVED', 'COMMENTED', 'DISMISSED'], state), name, kind) AS position FROM every""",
}
