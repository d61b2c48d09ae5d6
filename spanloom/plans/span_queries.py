"""Queries over spans and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, intervals, matching
from ..operators.tables import stored
from .tables import SPANS_SQL, line_spans, table


def q01_merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each order, merged where they overlap or touch."""
    return intervals.merge_spans(line_spans(spark, sf_dir), ["k"])


def q02_site_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites (flag N) against changed ranges (flag R) of the same order."""
    spans = line_spans(spark, sf_dir)
    return intervals.site_states(spans.where("flag = 'N'").select("k", "ord", "lo", "hi"), spans.where("flag = 'R'"), ["k"])


def q03_innermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each first position of an A line the innermost span of its order."""
    spans = line_spans(spark, sf_dir)
    points = spans.where("flag = 'A'").select("k", F.col("lo").alias("at"))
    return intervals.innermost(points, spans.select("k", "lo", "hi", F.col("ord").alias("id")), ["k"])


def q03b_leaf_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that hold no smaller span of their order."""
    return intervals.holders_without_smaller(line_spans(spark, sf_dir).select("k", "ord", "lo", "hi"), ["k"])


def q04_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's spans without its returned ones."""
    spans = line_spans(spark, sf_dir)
    return intervals.subtract(spans, spans.where("flag = 'R'"), ["k"])


def q04b_outside_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of each order that no changed function stands for, with deletions explained by deleted functions.

    N spans are changed ranges, A spans functions at the head. Every R line is a deletion behind its first line, at odd numbers a
    replacement of three lines; functions of the base lie at twenty to forty, the deleted one at thirty to forty, and every third line is blank.
    """
    spans = stored(line_spans(spark, sf_dir).select("k", "ord", "lo", "hi", "flag"), "outside-spans")
    doubled = lambda df: df.select("k", (F.col("lo") * 2).alias("lo"), (F.col("hi") * 2).alias("hi"))
    gone = spans.where("flag = 'R'")
    at = F.col("lo") * 2 + 1
    replaced = F.col("lo") % 2 == 1
    deletions = gone.select("k", at.alias("at"), F.col("lo").alias("old_start"), F.col("hi").alias("old_end"), F.when(replaced, F.col("lo") + 3).alias("new_end"), "ord")
    first = deletions.groupBy("k", "at").agg(F.min_by(F.struct("old_start", "old_end", "new_end"), "ord").alias("d")).select("k", "at", "d.*")
    ranges = doubled(spans.where("flag = 'N'")).union(gone.where(~replaced).select("k", at, at)).union(gone.where(replaced).select("k", at + 1, F.col("lo") * 2 + 6))
    orders = spans.select("k").distinct()
    whole = lambda a, b: orders.select("k", F.lit(a).alias("lo"), F.lit(b).alias("hi"))
    texts = orders.where("k % 2 = 0").select("k", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("line")).withColumn("text", F.when(F.col("line") % 3 == 0, "  ").otherwise("x = 1"))
    return intervals.outside_lines(ranges, doubled(spans.where("flag = 'A'")), ["k"], first, whole(30, 40), whole(20, 40), texts)


def q05_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an event of another type of the same user whose value lies within three."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.floor("value").cast("int").alias("lo")).withColumn("hi", F.col("lo"))
    clicks, rest = events.where("event_type = 'click'"), events.where("event_type <> 'click'")
    return intervals.overlapping(clicks, rest, ["user_id"], tolerance=3).select("event_id", "user_id", F.col("lo").alias("value"))


def q06_stale_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: two sides matched by key, stale callers counted, findings scored and ranked, worst first.

    Base are orders of even months, head those of odd months, keyed by customer and priority; a head order's lines are its
    callers, R lines tests, N lines not updated and O-status orders' A lines changed elsewhere.
    """
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    side = lambda m: orders.where(F.col("month") % 2 == m).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.max(F.struct("o_orderkey", "o_orderstatus")).alias("last"))
    base, head = side(0), side(1)
    matched = matching.match_sides(base.withColumn("d", F.col("n").cast("string")), head.withColumn("d", F.col("n").cast("string")), ["o_custkey", "o_orderpriority"], "d")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), "l_returnflag", "l_linestatus")
    call = F.when(F.col("l_returnflag") == "N", "unchanged").when(F.col("l_linestatus") == "O", "changed-elsewhere").otherwise("updated-at-call")
    callers = lines.select("order_key", (F.col("l_returnflag") == "R").alias("is_test"), call.alias("call_state"))
    counts = evidence.caller_states(callers, ["order_key"])
    change = matched.where("status IN ('changed', 'added')").join(head.select("o_custkey", "o_orderpriority", F.col("last.o_orderkey").alias("order_key")), ["o_custkey", "o_orderpriority"])
    kind = F.when(F.col("status") == "added", "body").when(F.col("o_orderpriority").startswith("1"), "new-throw").when(F.col("o_orderpriority").startswith("2"), "default-changed").otherwise("return-changed")
    joined = change.join(counts, "order_key", "left").withColumn("stale", F.coalesce("stale", F.lit(0))).withColumn("callers", F.coalesce("callers", F.lit(0))).withColumn("kinds", F.array(kind))
    scored = joined.withColumn("score", evidence.severity(F.col("kinds"), F.col("stale")).cast("int")).withColumn("finding", evidence.is_finding(F.col("kinds")))
    return scored.select("o_custkey", "o_orderpriority", "status", "order_key", F.col("kinds")[0].alias("kind"), "callers", "stale", "score", "finding").orderBy(F.desc("score"), "o_custkey", "o_orderpriority")


def q06b_changed_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of each order that its N spans touch: A and R spans are the head's, two thirds of which the base has, beside some of its own."""
    spans = stored(line_spans(spark, sf_dir), "changed-spans")
    doubled = lambda df, *more: df.select("k", *more, (F.col("lo") * 2).alias("lo"), (F.col("hi") * 2).alias("hi"))
    said = spans.withColumn("label", F.concat(F.lit("l"), (F.col("part") % 5).cast("string"))).withColumn("digest", (F.col("supp") % 3).cast("string"))
    head = doubled(said.where("flag <> 'N'"), F.col("ord").alias("key"), "label", "digest")
    base = said.where("flag <> 'N' AND part % 3 <> 0").select("k", F.col("ord").alias("key"), "label", "digest").union(said.where("supp % 4 = 0").select("k", F.col("ord") + 100, "label", "digest"))
    return matching.changed_symbols(base, head, doubled(spans.where("flag = 'N'")), "k")


def q07_not_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of odd sources whose text no document of an even source has in the same language."""
    docs = table(spark, sf_dir, "documents").withColumn("h", F.md5("text")).withColumn("side", F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2)
    return matching.not_renumbered(docs.where("side = 1").select("doc_id", "lang", "h"), docs.where("side = 0"), "lang", "h")


def q24_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deepest folder with a config above each url path; configs are the language folders of hosts seen ten times."""
    from ..operators import review

    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"))
    counts = pages.select(F.explode(review.ancestors(F.col("path"))).alias("folder")).groupBy("folder").count()
    return review.nearest_config(pages, counts.where("count >= 3"), "path", "folder")


def q25_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of urls: files below, least page id as the worst level, and pages with a query as attention."""
    from ..operators import review

    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"), F.col("page_id").alias("level"), F.col("url").contains("?").cast("int").alias("attention"))
    return review.folder_rollup(pages)


def q25c_worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of urls with the page of the worst level, the first of several."""
    from ..operators import review

    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^?#]*)", 1).alias("path"), "page_id", (F.col("page_id") % 5).alias("level"), F.lit(1).alias("attention"))
    return review.folder_rollup(pages, row="page_id").select("folder", "worst", "worst_row")


def q25b_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of urls as they are shown: single chains as one row, with joined names and depth."""
    from ..operators import review

    pages = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_extract("url", r"://([^?#]*)", 1), "/+", "/").alias("path"), F.col("page_id").alias("level"), F.lit(1).alias("attention"))
    direct = pages.where("path LIKE '%/%'").groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))
    return review.compacted_folders(review.folder_rollup(pages), direct).select("folder", "files", "name", "shown_parent", "depth")


def q35_row_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier's first line position of an order, the innermost span of the order."""
    spans = line_spans(spark, sf_dir)
    points = spans.groupBy("k", "supp").agg(F.min("lo").alias("at")).select("k", "at")
    return intervals.innermost(points, spans.where("flag <> 'A'").select("k", "lo", "hi", F.col("ord").alias("id")), ["k"])


def q51_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with three lines of context, merged."""
    lo, hi = intervals.widened(F.col("lo"), F.col("hi"))
    return intervals.merge_spans(line_spans(spark, sf_dir).select("k", lo.alias("lo"), hi.alias("hi")), ["k"])


def q52_nearest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line of the N spans that is nearest to twenty, for each order."""
    spans = line_spans(spark, sf_dir)
    wanted = spans.select("k").distinct().withColumn("preferred", F.lit(20))
    return intervals.nearest_line(wanted, spans.where("flag = 'N'"), ["k"])


def q53_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits by owner: each N span goes to the innermost A or R span that holds its first line."""
    spans = line_spans(spark, sf_dir)
    owners = intervals.innermost(spans.where("flag = 'N'").select("k", F.col("lo").alias("at")), spans.where("flag <> 'N'").select("k", "lo", "hi", F.col("ord").alias("id")), ["k"])
    edits = spans.where("flag = 'N'").join(owners.select("k", F.col("at").alias("lo"), F.col("id").alias("owner")), ["k", "lo"])
    return edits.groupBy("k", "owner").agg(F.count("*").alias("edits"), F.sum(F.col("hi") - F.col("lo") + 1).alias("lines"))


def q54_paired_overloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names (customer, priority) with exactly one order gone and one fresh."""
    orders = table(spark, sf_dir, "orders").select(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("name"), F.col("o_orderkey").alias("key"), F.year("o_orderdate").alias("y"))
    return matching.repaired_overloads(orders.where("y % 2 = 0"), orders.where("y % 2 = 1"), "name", "key")


def q55_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs of F and O orders of a customer with the same priority, in key order."""
    orders = table(spark, sf_dir, "orders")
    side = lambda s, c: orders.where(F.col("o_orderstatus") == s).select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias(c))
    return matching.paired_in_order(side("F", "left_id"), side("O", "right_id"), ["o_custkey", "o_orderpriority"], "left_id", "right_id")


def q56_line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document and the line that holds its hundredth character."""
    from ..functions import text as t

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(t.line_starts(F.col("text"))).alias("n_lines"), F.element_at(t.line_starts(F.col("text")), -1).alias("last_start"), t.line_of(F.col("text"), F.lit(100)).alias("line_100"))


_OVERLAP = "p.lo <= q.hi AND p.hi >= q.lo"
_MERGE = """{name} AS (SELECT k, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY lo, hi) AS island FROM (
    SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT k, lo, hi FROM {source}))) GROUP BY k, island)"""
_PAGES = "pages_ AS (SELECT page_id, url, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)"
_FOLDERS = "above AS (SELECT page_id, url, path, array_to_string(parts[1:i], '/') AS folder FROM (SELECT *, string_split(path, '/') AS parts FROM pages_), generate_series(1, 40) AS g(i) WHERE i < len(parts))"
_INNER = "SELECT w.k, w.at, s.lo, s.hi, s.id FROM w LEFT JOIN LATERAL (SELECT lo, hi, ord AS id FROM spans s WHERE s.k = w.k AND w.at BETWEEN s.lo AND s.hi {extra} ORDER BY hi - lo, ord LIMIT 1) s ON true"

QUERIES = {f.__name__: f for f in (q01_merge_spans, q02_site_states, q03_innermost, q03b_leaf_spans, q04_subtract, q04b_outside_lines, q05_near, q06_stale_findings, q06b_changed_symbols, q07_not_renumbered, q24_ancestor, q25_folders, q25b_compacted, q25c_worst_rows, q35_row_at_line, q51_widened, q52_nearest_line, q53_ownership, q54_paired_overloads, q55_twins, q56_line_positions)}

SQL = {
    "q01_merge_spans": f"WITH {SPANS_SQL}, {_MERGE.format(name='m', source='spans')} SELECT k, lo, hi FROM m",
    "q02_site_states": f"WITH {SPANS_SQL} SELECT k, ord, lo, hi, CASE WHEN EXISTS (SELECT 1 FROM spans q WHERE q.k = p.k AND q.flag = 'R' AND {_OVERLAP}) THEN 'updated' ELSE 'untouched' END AS state FROM spans p WHERE flag = 'N'",
    "q03_innermost": f"WITH {SPANS_SQL}, w AS (SELECT DISTINCT k, lo AS at FROM spans WHERE flag = 'A') {_INNER.format(extra='')}".replace(" AS at ", ' AS "at" ').replace("w.at", 'w."at"'),
    "q03b_leaf_spans": f"WITH {SPANS_SQL} SELECT k, ord, lo, hi FROM spans p WHERE NOT EXISTS (SELECT 1 FROM spans q WHERE q.k = p.k AND q.lo >= p.lo AND q.hi <= p.hi AND q.hi - q.lo < p.hi - p.lo)",
    "q04_subtract": f"""WITH {SPANS_SQL}, points AS (SELECT DISTINCT k, unnest(generate_series(lo, hi)) AS x FROM spans), gone AS (SELECT DISTINCT k, unnest(generate_series(lo, hi)) AS x FROM spans WHERE flag = 'R'),
        kept AS (SELECT * FROM points EXCEPT SELECT * FROM gone) SELECT k, CAST(min(x) AS INT) AS lo, CAST(max(x) AS INT) AS hi FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS island FROM kept) GROUP BY k, island""",
    "q04b_outside_lines": f"""WITH {SPANS_SQL}, gone AS (SELECT k, lo, arg_min(hi, ord) AS hi FROM spans WHERE flag = 'R' GROUP BY k, lo),
        added AS (SELECT k, lo, hi FROM spans WHERE flag = 'N' UNION ALL SELECT k, lo + 1, lo + 3 FROM gone WHERE lo % 2 = 1),
        points AS (SELECT DISTINCT k, unnest(generate_series(lo, hi)) AS x FROM added), kept AS (FROM points EXCEPT SELECT k, unnest(generate_series(lo, hi)) FROM spans WHERE flag = 'A'),
        loose AS (SELECT k, min(x) * 2 AS lo, max(x) * 2 AS hi FROM (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS island FROM kept) GROUP BY k, island),
        judged AS (SELECT k, lo, bool_or(x BETWEEN 30 AND 40) AS touches, bool_and(x BETWEEN 30 AND 40 OR (k % 2 = 0 AND (x % 3 = 0 OR x > 60))) AS covered,
            bool_or(x NOT BETWEEN 20 AND 40) AS outside, bool_or(x NOT BETWEEN 20 AND 40 AND NOT (k % 2 = 0 AND (x % 3 = 0 OR x > 60))) AS other FROM (SELECT k, lo, unnest(generate_series(lo, hi)) AS x FROM gone) GROUP BY k, lo),
        marks AS (SELECT k, lo * 2 + 1 AS m FROM judged j WHERE NOT (k % 2 = 0 AND covered AND touches) AND CASE WHEN lo % 2 = 0
            THEN NOT EXISTS (SELECT 1 FROM spans s WHERE s.k = j.k AND s.flag = 'A' AND s.lo <= j.lo AND s.hi > j.lo)
            ELSE CASE WHEN touches THEN other ELSE outside END AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.k = j.k AND p.x BETWEEN j.lo + 1 AND j.lo + 3) END)
        SELECT k, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM loose UNION ALL SELECT k, m, m FROM marks""",
    "q05_near": "SELECT event_id, user_id, CAST(floor(value) AS INT) AS value FROM events e WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type <> 'click' AND floor(o.value) BETWEEN floor(e.value) - 3 AND floor(e.value) + 3)",
    "q06_stale_findings": """WITH sides AS (SELECT o_custkey, o_orderpriority, month(o_orderdate) % 2 AS side, count(*) AS n, max(o_orderkey) AS order_key FROM orders GROUP BY ALL),
        change AS (SELECT h.o_custkey, h.o_orderpriority, h.order_key, CASE WHEN b.n IS NULL THEN 'added' ELSE 'changed' END AS status FROM (SELECT * FROM sides WHERE side = 1) h
            LEFT JOIN (SELECT * FROM sides WHERE side = 0) b USING (o_custkey, o_orderpriority) WHERE b.n IS NULL OR b.n <> h.n),
        counts AS (SELECT l_orderkey AS order_key, count_if(l_returnflag <> 'R') AS callers, count_if(l_returnflag = 'N' OR (l_returnflag = 'A' AND l_linestatus = 'O')) AS stale FROM lineitem GROUP BY 1),
        kinds AS (SELECT c.*, coalesce(callers, 0) AS callers, coalesce(stale, 0) AS stale, CASE WHEN status = 'added' THEN 'body' WHEN o_orderpriority LIKE '1%' THEN 'new-throw' WHEN o_orderpriority LIKE '2%' THEN 'default-changed' ELSE 'return-changed' END AS kind
            FROM change c LEFT JOIN counts USING (order_key))
        SELECT o_custkey, o_orderpriority, status, order_key, kind, CAST(callers AS BIGINT) AS callers, CAST(stale AS BIGINT) AS stale,
            CAST(CASE kind WHEN 'body' THEN 10 WHEN 'new-throw' THEN 80 WHEN 'default-changed' THEN 65 ELSE 20 END + 2 * least(stale, 10) AS INT) AS score, kind <> 'body' AS finding FROM kinds""",
    "q06b_changed_symbols": f"""WITH {SPANS_SQL}, head AS (SELECT k, ord AS key, 'l' || (part % 5) AS label, supp % 3 AS digest, lo, hi FROM spans WHERE flag <> 'N'),
        base AS (SELECT k, ord AS key, 'l' || (part % 5) AS label, supp % 3 AS digest FROM spans WHERE flag <> 'N' AND part % 3 <> 0 UNION ALL SELECT k, ord + 100, 'l' || (part % 5), supp % 3 FROM spans WHERE supp % 4 = 0),
        asked AS (SELECT DISTINCT k, unnest(generate_series(lo, hi)) AS x FROM spans WHERE flag = 'N'), touched AS (SELECT DISTINCT k, (SELECT arg_min(key, (hi - lo) * 1000 + key) FROM head h WHERE h.k = a.k AND x BETWEEN h.lo AND h.hi) AS key FROM asked a)
        SELECT k, key, CASE WHEN EXISTS (SELECT 1 FROM base b WHERE b.k = h.k AND b.key = h.key) THEN 'changed' ELSE 'added' END AS status FROM head h
        WHERE EXISTS (SELECT 1 FROM touched t WHERE t.k = h.k AND t.key = h.key) OR NOT EXISTS (SELECT 1 FROM base b WHERE b.k = h.k AND (b.key = h.key OR b.label = h.label AND b.digest = h.digest))
        UNION ALL SELECT DISTINCT k, key, 'deleted' FROM base b WHERE NOT EXISTS (SELECT 1 FROM head h WHERE h.k = b.k AND h.key = b.key)""",
    "q07_not_renumbered": r"WITH d AS (SELECT doc_id, lang, md5(text) AS h, CAST(regexp_extract(source, '(\d+)$', 1) AS INT) % 2 AS side FROM documents) SELECT lang, h, doc_id FROM d WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM d b WHERE b.side = 0 AND b.lang = d.lang AND b.h = d.h)",
    "q24_ancestor": f"WITH {_PAGES}, {_FOLDERS}, known AS (SELECT folder FROM above GROUP BY folder HAVING count(*) >= 3) SELECT p.path, arg_max(k.folder, length(k.folder)) AS folder FROM (SELECT DISTINCT path FROM pages_) p LEFT JOIN above a ON a.path = p.path LEFT JOIN known k ON k.folder = a.folder GROUP BY p.path",
    "q25_folders": f"WITH {_PAGES}, {_FOLDERS} SELECT folder, count(*) AS files, min(page_id) AS worst, CAST(sum(CASE WHEN contains(url, '?') THEN 1 ELSE 0 END) AS BIGINT) AS attention FROM above GROUP BY folder",
    "q25c_worst_rows": f"WITH {_PAGES}, {_FOLDERS} SELECT folder, min(page_id % 5) AS worst, arg_min(page_id, (page_id % 5) * 1000000000 + page_id) AS worst_row FROM above GROUP BY folder",
    "q25b_compacted": f"""WITH p AS (SELECT regexp_replace(regexp_extract(url, '://([^?#]*)', 1), '/+', '/', 'g') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS parts FROM p),
        above AS (SELECT array_to_string(parts[1:i], '/') AS folder, i = len(parts) - 1 AS direct FROM s, generate_series(1, 40) AS g(i) WHERE i < len(parts)), r AS (SELECT folder, count(*) AS files, count_if(direct) AS own FROM above GROUP BY folder),
        subs AS (SELECT regexp_extract(folder, '^(.*)/[^/]+$', 1) AS folder, count(*) AS n FROM r WHERE contains(folder, '/') GROUP BY 1), shown AS (SELECT r.folder, files FROM r LEFT JOIN subs USING (folder) WHERE NOT (coalesce(n, 0) = 1 AND own = 0)),
        up AS (SELECT f.folder, f.files, arg_max(a.folder, length(a.folder)) AS shown_parent, count(a.folder) AS depth FROM shown f LEFT JOIN shown a ON starts_with(f.folder, a.folder || '/') GROUP BY ALL)
        SELECT folder, files, CASE WHEN shown_parent IS NULL THEN folder ELSE substr(folder, length(shown_parent) + 2) END AS name, shown_parent, CAST(depth AS INT) AS depth FROM up""",
    "q35_row_at_line": f"WITH {SPANS_SQL}, w AS (SELECT DISTINCT k, min(lo) AS \"at\" FROM spans GROUP BY k, supp) {_INNER.format(extra=chr(65) + 'ND flag <> ' + chr(39) + 'A' + chr(39))}".replace("w.at", 'w."at"'),
    "q51_widened": f"WITH {SPANS_SQL}, wide AS (SELECT k, greatest(1, lo - 3) AS lo, hi + 3 AS hi FROM spans), {_MERGE.format(name='m', source='wide')} SELECT k, lo, hi FROM m",
    "q52_nearest_line": f"WITH {SPANS_SQL} SELECT k, 20 AS preferred, (SELECT arg_min(least(greatest(20, lo), hi), abs(least(greatest(20, lo), hi) - 20) * 1000 + least(greatest(20, lo), hi)) FROM spans q WHERE q.k = w.k AND flag = 'N') AS line FROM (SELECT DISTINCT k FROM spans) w",
    "q53_ownership": f"""WITH {SPANS_SQL}, owned AS (SELECT e.k, e.lo, e.hi, (SELECT arg_min(s.ord, (s.hi - s.lo) * 1000 + s.ord) FROM spans s WHERE s.k = e.k AND s.flag <> 'N' AND e.lo BETWEEN s.lo AND s.hi) AS owner FROM spans e WHERE flag = 'N')
        SELECT k, owner, count(*) AS edits, CAST(sum(hi - lo + 1) AS BIGINT) AS lines FROM owned GROUP BY k, owner""",
    "q54_paired_overloads": """WITH o AS (SELECT o_custkey || '|' || o_orderpriority AS name, o_orderkey AS key, year(o_orderdate) % 2 AS y FROM orders)
        SELECT name, min(key) FILTER (y = 0) AS base_key, min(key) FILTER (y = 1) AS fresh_key FROM o GROUP BY name HAVING count_if(y = 0) = 1 AND count_if(y = 1) = 1""",
    "q55_twins": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS n FROM orders)
        SELECT a.o_custkey, a.o_orderpriority, a.o_orderkey AS left_id, b.o_orderkey AS right_id FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.n = b.n AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""",
    "q56_line_positions": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS INT) AS n_lines, CAST(length(text) - length(string_split(text, chr(10))[-1]) AS INT) AS last_start, CAST(len(string_split(substr(text, 1, 100), chr(10))) AS INT) AS line_100 FROM documents",
}
