"""Queries over evidence between groups, seams, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..operators import callers, hints, impact, intervals, matching
from ..operators.tables import stored
from .tables import SPANS_SQL, consecutive, document_words, edges_sql, line_spans, table


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``path`` of cards, one card a source."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("K"), F.regexp_extract("source", r"(\d+)$", 1)).alias("card"), F.col("doc_id").cast("string").alias("path"), "doc_id", "lang", "text")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents in a row as a commit; every third is a chore."""
    docs = table(spark, sf_dir, "documents")
    n = F.floor(F.col("doc_id") / 7)
    return docs.select(F.concat(F.lit("c"), F.lpad(n.cast("string"), 8, "0")).alias("sha"), F.when(n % 3 == 0, "chore: bump all the things").otherwise("Add one more thing").alias("subject"), F.col("doc_id").cast("string").alias("path"))


def q77_commit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits that touch files of two cards: how many for each pair, and how many count."""
    found = hints.commit_evidence(_commits(spark, sf_dir), _cards(spark, sf_dir), 12)
    return found.groupBy("a", "b").agg(F.count("*").alias("commits"), F.count_if("counted").alias("counted"))


def _token_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_words(spark, sf_dir).select(F.col("id").cast("string").alias("path"), F.explode("tokens").alias("token"))
    return hints.token_evidence(words, _cards(spark, sf_dir), words.groupBy("token").agg(F.count("*").alias("files")))


def q78_token_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare words that exactly two cards hold."""
    found = _token_evidence(spark, sf_dir)
    return found.select("a", "b", F.substring("rank.name", 6, 10_000).alias("token"))


def q79_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints between cards from commits, rare words, equal texts and languages (as folders), in order."""
    cards = _cards(spark, sf_dir)
    evidence = [
        hints.commit_evidence(_commits(spark, sf_dir), cards, 12), _token_evidence(spark, sf_dir), hints.shared_evidence(cards.select("card", F.md5("text").alias("pattern")), "pattern", "pattern"),
        hints.shared_evidence(cards.select("card", F.col("lang").alias("folder")), "folder", "folder", counted=False)]
    return hints.hints(evidence).select("a", "b", "strength", "pieces", "omitted", "position")


def q80_type_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as cards: types of two parts each, named in the signatures of others."""
    parts = table(spark, sf_dir, "part")
    name = lambda n: F.concat(F.lit("Cls"), F.floor(n / 2).cast("string"))
    members = parts.select(F.concat(F.lit("K"), F.regexp_extract("p_brand", r"(\d+)$", 1)).alias("card"), F.col("p_partkey").alias("change"), name(F.col("p_partkey")).alias("class_name"), F.concat(F.lit("f(x: "), name(F.col("p_partkey") + 6), F.lit(")")).alias("signature"), F.lit(False).alias("deleted"))
    found = hints.type_seams(members, 3)
    return found.select("a", "b", F.array_join("directions", " ").alias("directions"), F.array_join("types", " ").alias("types"), "type_count", F.array_join("via", " ").alias("via"), "via_count")


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks of two levels from every supplier over consecutive ones. Nations 0 and 1 are entry points (1 is passed), 2 is module-level code."""
    supplier = table(spark, sf_dir, "supplier")
    edges = consecutive(spark, sf_dir, "supp", distinct=False).select("src", "dst", F.col("dst").alias("ord"), F.lit(False).alias("is_test"), ((F.col("src") + F.col("dst")) % 2 == 0).alias("updated"))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    facts = supplier.select(
        key.alias("node"), key.cast("string").alias("label"), F.concat(F.lit("f"), (key % 9).cast("string")).alias("file"), F.when(nation < 2, "http").alias("entry_type"), F.when(nation < 2, F.concat(F.lit("E"), (key % 5).cast("string"))).alias("entry_name"),
        (nation == 1).alias("passes"), (nation == 2).alias("module_level"), (key % 2 == 0).alias("starts_app"), (F.col("s_acctbal") >= 0).alias("complete"), F.lit(None).cast("string").alias("reason"),
        F.when(key % 7 == 0, "di").otherwise("none").alias("caller_state"), (key % 3).alias("test_callers"))
    return impact.ends_without_ways(supplier.select(key.alias("id"), key.alias("node"), (key % 2 == 0).alias("risky")), edges, facts, 2, 1_000_000)


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


def q81_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every supplier reaches within two levels: ends by kind, entry points, and why the answer is not complete."""
    found = impact.summary(_walk(spark, sf_dir), starts=_walked(spark, sf_dir))
    return found.select("id", "entry", "top_unidentified", "unknown", "budget", "test_only", "complete", "entries", "nearest_entry", F.array_join("reasons", "; ").alias("reasons"))


def q82_impact_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points of every supplier at their shortest depth, in order."""
    return impact.entries(_walk(spark, sf_dir))


def q83_card_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by four cards, and one member each that was not walked: sums, and reasons by how many give them."""
    ends = _walk(spark, sf_dir)
    members = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("card"), F.col("s_suppkey").alias("change")).union(spark.range(4).select("id", (-1 - F.col("id"))))
    found = impact.card_impact(members, impact.summary(ends, starts=_walked(spark, sf_dir)), ends)
    return found.select("card", "members", "walked", "entry", "top_unidentified", "unknown", "budget", "entry_points", "complete", F.array_join("reasons", "; ").alias("reasons"))


def q83b_card_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry points of suppliers' four cards, in the order in which the members reach them."""
    members = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4).alias("card"), F.col("s_suppkey").alias("change"))
    return impact.card_entries(members, _walk(spark, sf_dir))


def q84_blast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers one level above every supplier, thirty at most."""
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"))
    return impact.blast_radius(starts, consecutive(spark, sf_dir, "supp").withColumn("is_test", F.col("dst") % 10 == 0), 1, 30)


def q84b_blast_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers within two levels of every supplier, forty at most, over the orders' consecutive suppliers of the same nation's parity."""
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("start"))
    edges = consecutive(spark, sf_dir, "supp").where("(src * 7 + dst) % 11 = 0").withColumn("is_test", F.col("dst") % 10 == 0)
    return impact.blast_radius(starts, edges, 2, 40)


def q85_shown_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as roots by thousands of balance: the first six with their blast radius, in order."""
    ranked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.floor(F.col("s_acctbal") / 1000).alias("score"))
    return impact.shown_roots(ranked, q84_blast(spark, sf_dir))


def q86_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each order that own a line, or the gap behind the last line, of its returned ranges; positions are doubled."""
    spans = stored(line_spans(spark, sf_dir).select("k", "ord", "lo", "hi", "flag"), "owner-spans")
    own = spans.where("flag <> 'R'").select("k", (F.col("lo") * 2).alias("lo"), (F.col("hi") * 2).alias("hi"), F.col("ord").alias("id"))
    ranges = spans.where("flag = 'R'").select("k", (F.col("lo") * 2).alias("lo"), (F.col("hi") * 2).alias("hi"))
    gaps = spans.where("flag = 'R'").select("k", (F.col("hi") * 2 + 1).alias("lo"), (F.col("hi") * 2 + 1).alias("hi"))
    return intervals.owners_of_ranges(ranges.union(gaps).distinct(), own, ["k"])


def q87_row_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first line of every span leads: a row (N), top-level lines (A), or the file."""
    spans = line_spans(spark, sf_dir)
    side = lambda f: spans.where(F.col("flag") == f).select("k", F.col("ord").alias("id"), "lo", "hi")
    return intervals.row_at(spans.select("k", F.col("lo").alias("at")), side("N"), side("A"), ["k"])


def q88_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each A span is accepted as a comment inside one N span of its order."""
    spans = line_spans(spark, sf_dir)
    asked = spans.where("flag = 'A'").select("k", "ord", F.col("lo").alias("start_line"), F.col("hi").alias("line"))
    shown = intervals.commentable(spans.where("flag = 'N'"), spans.select("k").distinct().withColumn("lines", F.lit(48)), ["k"])
    return intervals.accepted_comments(asked, shown, ["k"])


def q89_word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents the first words of benchmark items occur."""
    words = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", r"^(\w+)", 1).alias("token")).where("token <> ''")
    return code.word_files(words, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text")))


def q89b_phrase_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents phrases of the documents occur: the first two words of each with what is between and behind them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    phrases = docs.select(F.regexp_extract("text", r"^\W*(\w+[^\w\n]+\w+[^\w\n]?)", 1).alias("token")).where("length(token) > 0")
    return code.word_files(phrases, docs)


def q90_mirror_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as cards of parts that lie below four top folders; one of them is generated."""
    path = F.concat(F.get(F.array(F.lit("src"), F.lit("lib"), F.lit("gen"), F.lit("old")), (F.col("p_partkey") % 4).cast("int")), F.lit("/"), F.col("p_type"), F.lit("/"), F.col("p_size").cast("string"))
    members = table(spark, sf_dir, "part").select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long").alias("card"), path.alias("path"), F.col("p_name").alias("name"))
    return matching.mirror_cards(members, spark.range(1).select(F.lit("old").alias("top")))


def q91_change_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as symbols at their supplier's place, met by callers at parts' places: edges between orders."""
    symbols = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("path"), (F.col("o_orderkey") % 97).alias("name_pos"), (F.col("o_orderkey") % 31).alias("class_name_pos"), (F.col("o_orderkey") % 3 == 0).alias("is_constructor"), F.col("o_orderkey").alias("ord"))
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change"), F.concat(F.lit("f"), (F.col("l_suppkey") % 50).cast("string")).alias("path"), (F.col("l_partkey") % 97).alias("pos"), (F.col("l_returnflag") == "R").alias("is_test"))
    return callers.change_edges(calls, callers.changed_keys(symbols))


QUERIES = {f.__name__: f for f in (q77_commit_evidence, q78_token_evidence, q79_hints, q80_type_seams, q81_impact, q82_impact_entries, q83_card_impact, q83b_card_entries, q84_blast, q84b_blast_budget, q85_shown_roots, q86_owners, q87_row_at, q88_comments, q89_word_files, q89b_phrase_files, q90_mirror_cards, q91_change_edges)}

_CARDS = r"cards AS (SELECT 'K' || regexp_extract(source, '(\d+)$', 1) AS card, CAST(regexp_extract(source, '(\d+)$', 1) AS INT) AS n, doc_id, lang, text FROM documents)"
_COMMITS = """touched AS (SELECT DISTINCT doc_id // 7 AS sha, card, n FROM cards), commits AS (SELECT doc_id // 7 AS sha, count(DISTINCT doc_id) AS files FROM documents GROUP BY 1),
    commit_ev AS (SELECT p.card AS a, q.card AS b, p.sha, p.sha % 3 = 0 OR files * 2 > 12 AS weak FROM touched p JOIN touched q ON p.sha = q.sha AND p.n < q.n JOIN commits c ON c.sha = p.sha)"""
_TOKENS = """w AS (SELECT DISTINCT card, n, doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS token FROM cards),
    token_ev AS (SELECT arg_min(card, n) AS a, arg_max(card, n) AS b, token FROM w GROUP BY token HAVING count(DISTINCT card) = 2 AND count(DISTINCT doc_id) <= 20)"""
_WALK = f"""{edges_sql('supp')}, calls AS (SELECT src, dst FROM edges), f AS (SELECT s_suppkey AS n, s_nationkey AS nk, s_acctbal >= 0 AS complete FROM supplier),
    walk(s, n, d) AS (SELECT n, n, 0 FROM f UNION SELECT w.s, c.dst, w.d + 1 FROM walk w JOIN f ON f.n = w.n AND nk NOT IN (0, 2) JOIN calls c ON c.src = w.n WHERE w.d < 2),
    r AS (SELECT s, n, min(d) AS d FROM walk GROUP BY s, n), seen AS (SELECT r.*, nk, complete, n IN (SELECT src FROM calls) AS has FROM r JOIN f USING (n)),
    ends AS (
        SELECT s, n, d, 'entry' AS e, NULL AS reason FROM seen WHERE nk = 0
        UNION ALL SELECT s, n, d, 'top', CASE WHEN n % 2 <> 0 THEN 'module-level code on a path: what loads the module is not traced' END FROM seen WHERE nk = 2
        UNION ALL SELECT s, n, d, 'budget', 'depth limit of 2 caller levels' FROM seen WHERE nk NOT IN (0, 2) AND d = 2
        UNION ALL SELECT s, n, d, 'unknown', 'a caller query did not finish' FROM seen WHERE nk NOT IN (0, 2) AND d < 2 AND NOT complete
        UNION ALL SELECT s, n, d, CASE WHEN n % 7 = 0 THEN 'unknown' ELSE 'top' END, CASE WHEN n % 7 = 0 THEN 'a DI container builds this class, so its callers are not visible' END FROM seen WHERE nk NOT IN (0, 2) AND d < 2 AND complete AND NOT has),
    points AS (SELECT s, 'http' AS type, 'E' || (n % 5) AS name, 'f' || (n % 9) AS file, min(d) AS depth FROM seen WHERE nk = 0 OR nk = 1 AND d < 2 AND has GROUP BY ALL),
    own AS (SELECT f.n AS s, count_if(e IS NOT NULL AND e = 'entry') AS entry, count_if(e IS NOT NULL AND e = 'top') AS top_unidentified, count_if(e IS NOT NULL AND e = 'unknown') AS unknown, count_if(e IS NOT NULL AND e = 'budget') AS budget, list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)) AS rs FROM f LEFT JOIN ends ON ends.s = f.n GROUP BY f.n)"""

SQL = {
    "q77_commit_evidence": f"WITH {_CARDS}, {_COMMITS} SELECT a, b, count(*) AS commits, count_if(NOT weak) AS counted FROM commit_ev GROUP BY 1, 2",
    "q78_token_evidence": f"WITH {_CARDS}, {_TOKENS} SELECT a, b, token FROM token_ev",
    "q79_hints": f"""WITH {_CARDS}, {_COMMITS}, {_TOKENS}, c AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY weak, sha) AS r FROM commit_ev),
        commit_ AS (SELECT a, b, max(CASE WHEN r <= 5 AND NOT weak THEN 1 ELSE 0 END) AS k, least(count(*), 5) AS n, greatest(count(*) - 5, 0) AS omitted FROM c GROUP BY 1, 2),
        token_ AS (SELECT a, b, 1 AS k, least(count(*), 5) AS n, 0 AS omitted FROM token_ev GROUP BY 1, 2),
        t AS (SELECT DISTINCT card, n, md5(text) AS h FROM cards WHERE text IS NOT NULL), pattern_ AS (SELECT p.card AS a, q.card AS b, 1 AS k, least(count(*), 3) AS n, 0 AS omitted FROM t p JOIN t q ON p.h = q.h AND p.n < q.n GROUP BY 1, 2),
        l AS (SELECT DISTINCT card, n, lang FROM cards WHERE lang IS NOT NULL), folder_ AS (SELECT p.card AS a, q.card AS b, 0 AS k, 1 AS n, 0 AS omitted FROM l p JOIN l q ON p.lang = q.lang AND p.n < q.n GROUP BY 1, 2),
        every AS (FROM commit_ UNION ALL FROM token_ UNION ALL FROM pattern_ UNION ALL FROM folder_),
        g AS (SELECT a, b, CAST(sum(k) AS BIGINT) AS strength, CAST(sum(n) AS BIGINT) AS pieces, CAST(sum(omitted) AS BIGINT) AS omitted FROM every GROUP BY 1, 2 HAVING sum(k) > 0)
        SELECT *, row_number() OVER (ORDER BY strength DESC, pieces DESC, CAST(substr(a, 2) AS INT), CAST(substr(b, 2) AS INT)) AS position FROM g""",
    "q80_type_seams": r"""WITH m AS (SELECT CAST(regexp_extract(p_brand, '(\d+)$', 1) AS INT) AS n, p_partkey AS change, 'Cls' || (p_partkey // 2) AS cls, 'Cls' || ((p_partkey + 6) // 2) AS word FROM part),
        few AS (SELECT DISTINCT cls, n FROM m WHERE cls IN (SELECT cls FROM m GROUP BY 1 HAVING count(DISTINCT n) < 3)),
        met AS (SELECT 'K' || least(o.n, m.n) AS a, 'K' || greatest(o.n, m.n) AS b, 'K' || o.n || '>' || 'K' || m.n AS direction, word, change FROM m JOIN few o ON o.cls = m.word WHERE o.n <> m.n)
        SELECT a, b, array_to_string(list_sort(list(DISTINCT direction)), ' ') AS directions, array_to_string(list_sort(list(DISTINCT word))[1:3], ' ') AS types, count(DISTINCT word) AS type_count,
            array_to_string(list_sort(list(DISTINCT change))[1:3], ' ') AS via, count(DISTINCT change) AS via_count FROM met GROUP BY 1, 2""",
    "q81_impact": f"""WITH RECURSIVE {_WALK}, p AS (SELECT s, count(*) AS entries, min(depth) AS nearest_entry FROM points GROUP BY s)
        SELECT o.s AS id, entry, top_unidentified, unknown, budget, coalesce((SELECT bool_and(e = 'top' AND n % 3 > 0 AND nk <> 2) FROM ends JOIN f USING (n) WHERE ends.s = o.s), false) AS test_only,
            coalesce(len(rs), 0) = 0 AS complete, coalesce(entries, 0) AS entries, nearest_entry, coalesce(array_to_string(rs, '; '), '') AS reasons FROM own o LEFT JOIN p USING (s)""",
    "q82_impact_entries": f"WITH RECURSIVE {_WALK} SELECT s AS id, type, name, file, depth, row_number() OVER (PARTITION BY s ORDER BY depth, name, type, file) AS position FROM points",
    "q83_card_impact": f"""WITH RECURSIVE {_WALK}, said AS (SELECT s % 4 AS card, unnest(rs) AS reason FROM own), counted AS (SELECT card, reason, count(*) AS n FROM said GROUP BY 1, 2),
        texts AS (SELECT card, string_agg(reason || ' (×' || n || ')', '; ' ORDER BY n DESC, reason) AS t FROM counted GROUP BY 1), pts AS (SELECT s % 4 AS card, count(DISTINCT name) AS k FROM points GROUP BY 1)
        SELECT s % 4 AS card, count(*) + 1 AS members, count(*) AS walked, CAST(sum(entry) AS BIGINT) AS entry, CAST(sum(top_unidentified) AS BIGINT) AS top_unidentified, CAST(sum(unknown) AS BIGINT) AS unknown, CAST(sum(budget) AS BIGINT) AS budget,
            coalesce(any_value(k), 0) AS entry_points, false AS complete, '1 member(s) have no impact paths (deleted or not walked)' || coalesce('; ' || any_value(t), '') AS reasons
        FROM own LEFT JOIN texts ON texts.card = s % 4 LEFT JOIN pts ON pts.card = s % 4 GROUP BY 1""",
    "q83b_card_entries": f"""WITH RECURSIVE {_WALK}, p AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY depth, name, type, file) AS r FROM points),
        g AS (SELECT s % 4 AS card, type, name, max({{'s': s, 'r': r, 'file': file, 'depth': depth}}) AS l, min({{'s': s, 'r': r}}) AS f FROM p GROUP BY 1, 2, 3)
        SELECT card, type, name, l.file AS file, l.depth AS depth, l.s AS change, row_number() OVER (PARTITION BY card ORDER BY f) AS position FROM g""",
    "q84_blast": f"WITH {edges_sql('supp')}, c AS (SELECT s_suppkey AS start, count(dst) AS n FROM supplier LEFT JOIN edges ON src = s_suppkey AND dst % 10 <> 0 GROUP BY 1) SELECT start, least(n, 30) AS blast, n >= 30 AS capped FROM c",
    "q84b_blast_budget": f"""WITH {edges_sql('supp')}, e AS (SELECT * FROM edges WHERE (src * 7 + dst) % 11 = 0 AND dst % 10 <> 0), near AS (SELECT src AS s, dst AS n FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src),
        c AS (SELECT s_suppkey AS start, count(n) AS n FROM supplier LEFT JOIN near ON s = s_suppkey GROUP BY 1) SELECT start, least(n, 40) AS blast, n >= 40 AS capped FROM c""",
    "q85_shown_roots": f"""WITH {edges_sql('supp')}, c AS (SELECT s_suppkey AS node, CAST(floor(s_acctbal / 1000) AS BIGINT) AS score, count(dst) AS n FROM supplier LEFT JOIN edges ON src = s_suppkey AND dst % 10 <> 0 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, node) AS place FROM c), b AS (SELECT node, score, CASE WHEN place <= 6 THEN least(n, 30) END AS blast, CASE WHEN place <= 6 THEN n >= 30 END AS capped FROM r)
        SELECT *, row_number() OVER (ORDER BY score DESC, coalesce(blast, 0) DESC, node) AS position FROM b""",
    "q86_owners": f"""WITH {SPANS_SQL}, own AS (SELECT k, ord AS id, lo, hi FROM spans WHERE flag <> 'R'), r AS (SELECT DISTINCT k, lo, hi, unnest(generate_series(lo, hi)) AS x FROM spans WHERE flag = 'R'),
        lines AS (SELECT r.k, r.lo * 2 AS lo, r.hi * 2 AS hi, (SELECT arg_min(id, (o.hi - o.lo) * 1000 + id) FROM own o WHERE o.k = r.k AND x BETWEEN o.lo AND o.hi) AS id FROM r),
        gaps AS (SELECT DISTINCT s.k, s.hi * 2 + 1 AS lo, s.hi * 2 + 1 AS hi, (SELECT arg_min(id, (o.hi - o.lo) * 1000 + id) FROM own o WHERE o.k = s.k AND o.lo <= s.hi AND o.hi >= s.hi + 1) AS id FROM spans s WHERE flag = 'R')
        SELECT DISTINCT * FROM (FROM lines UNION ALL FROM gaps) WHERE id IS NOT NULL""",
    "q87_row_at": f"""WITH {SPANS_SQL}, p AS (SELECT DISTINCT k, lo AS x FROM spans), b AS (SELECT k, x, (SELECT arg_min(ord, (hi - lo) * 1000 + ord) FROM spans s WHERE s.k = p.k AND flag = 'N' AND x BETWEEN lo AND hi) AS r,
        (SELECT arg_min(ord, (hi - lo) * 1000 + ord) FROM spans s WHERE s.k = p.k AND flag = 'A' AND x BETWEEN lo AND hi) AS o FROM p)
        SELECT k, x AS "at", coalesce(r, o) AS id, CASE WHEN r IS NOT NULL THEN 'row' WHEN o IS NOT NULL THEN 'outside' ELSE 'file' END AS level FROM b""",
    "q88_comments": f"WITH {SPANS_SQL} SELECT k, ord, lo AS start_line, hi AS line, EXISTS (SELECT 1 FROM spans s WHERE s.k = p.k AND s.flag = 'N' AND greatest(1, s.lo) <= p.lo AND p.hi <= least(48, s.hi)) AS accepted FROM spans p WHERE flag = 'A'",
    "q89_word_files": r"""WITH t AS (SELECT DISTINCT regexp_extract(text, '^(\w+)', 1) AS token FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '\w+')) AS ws FROM documents)
        SELECT token, (SELECT count(*) FROM d WHERE list_contains(ws, token)) AS files, false AS partial FROM t WHERE token <> ''""",
    "q89b_phrase_files": r"""WITH p AS (SELECT DISTINCT regexp_extract(text, '^[^0-9A-Za-z_]*([0-9A-Za-z_]+[^0-9A-Za-z_\n]+[0-9A-Za-z_]+[^0-9A-Za-z_\n]?)', 1) AS token FROM documents), t AS (SELECT token FROM p WHERE token <> ''),
        d AS (SELECT DISTINCT text, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text), hits AS (SELECT token, sum(n) AS files FROM t JOIN d ON contains(text, token) AND regexp_matches(text, '(^|[^0-9A-Za-z_])' || regexp_escape(token) || '($|[^0-9A-Za-z_])') GROUP BY token)
        SELECT token, coalesce(CAST(files AS BIGINT), 0) AS files, false AS partial FROM t LEFT JOIN hits USING (token)""",
    "q90_mirror_cards": r"""WITH m AS (SELECT CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT) AS card, ['src', 'lib', 'gen', 'old'][p_partkey % 4 + 1] AS top, p_type || '/' || p_size AS tail, p_name AS name FROM part),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY card, top) AS r FROM (SELECT DISTINCT card, top, tail FROM m)) WHERE r <= 8),
        p AS (SELECT x.card AS a, y.card AS b, x.top AS top_a, y.top AS top_b, count(*) AS files FROM f x JOIN f y ON x.tail = y.tail AND x.card < y.card AND x.top <> y.top WHERE (x.top IN ('gen', 'old')) = (y.top IN ('gen', 'old')) GROUP BY ALL),
        n AS (SELECT card, list_distinct(list(name)) AS ns FROM m GROUP BY 1)
        SELECT a, b, top_a, top_b, files, CAST(len(list_intersect(x.ns, y.ns)) AS INT) AS common, CAST(least(len(x.ns), len(y.ns)) AS INT) AS smaller FROM p JOIN n x ON x.card = a JOIN n y ON y.card = b WHERE len(list_intersect(x.ns, y.ns)) * 10 >= least(len(x.ns), len(y.ns)) * 8""",
    "q91_change_edges": """WITH k AS (SELECT o_custkey % 50 AS f, o_orderkey % 97 AS pos, o_orderkey AS id, 0 AS c FROM orders UNION ALL SELECT o_custkey % 50, o_orderkey % 31, o_orderkey, 1 FROM orders WHERE o_orderkey % 3 = 0),
        keys AS (SELECT f, pos, arg_min(id, c * 1000000000 + id) AS id FROM k GROUP BY 1, 2)
        SELECT DISTINCT l_orderkey AS callee, id AS caller FROM lineitem JOIN keys ON f = l_suppkey % 50 AND pos = l_partkey % 97 WHERE l_returnflag <> 'R' AND l_orderkey <> id""",
}
