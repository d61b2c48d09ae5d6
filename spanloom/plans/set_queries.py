"""Queries over token sets, repeated patterns and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import alignment
from ..functions import text as t
from ..operators import evidence, matching, ranking, sets
from ..operators.tables import stored
from .tables import WORDS_SQL, document_words, table


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_words(spark, sf_dir).select("id", "source", F.explode("tokens").alias("token"))


def q08_repeated_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that five documents of two sources share."""
    return evidence.repeated_patterns(_tokens(spark, sf_dir), "token", "id", "source")


def q09_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most frequent event type of each user; of equally frequent ones that of the largest value."""
    return ranking.dominant(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value")


def q10_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different word sets at Jaccard 0.6 and more, between class representatives; q10b has the members of the classes."""
    return sets.similar_sets(document_words(spark, sf_dir), 60)


def q10b_similar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class representative of every document with words, for the pairs of q10."""
    return sets.set_members(document_words(spark, sf_dir)).select("id", "representative")


def q11_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and documents where the smaller word set lies in the other by 0.8."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("tokens"))
    return sets.contained(items, document_words(spark, sf_dir), 80)


def q12_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each turn of a conversation adds to and drops from the turn before."""
    turns = table(spark, sf_dir, "conversations")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)))
    pairs = turns.select("conv_id", "turn", words.alias("w")).withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    d = pairs.select("conv_id", "turn", sets.both_ways(F.col("before"), F.col("w")).alias("d"))
    return d.select("conv_id", "turn", F.array_join("d.added", " ").alias("added"), "d.added_more", F.array_join("d.removed", " ").alias("removed"), "d.removed_more")


def q13_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matching of similar documents of odd and even ids of one language: equal word sets in order of ids, then the rest greedily."""
    words = document_words(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    members = stored(sets.set_members(words).join(docs, "id").select("id", "lang", F.col("representative").alias("cls"), "n", F.struct("lang").alias("group")), "moves-members")
    odd, even = members.where("id % 2 <> 0").withColumnRenamed("id", "left_id"), members.where("id % 2 = 0").withColumnRenamed("id", "right_id")
    equal = stored(matching.paired_in_order(odd, even, ["cls", "n", "group"], "left_id", "right_id"), "moves-equal")
    left, right = odd.join(equal, "left_id", "left_anti"), even.join(equal, "right_id", "left_anti")
    moved = matching.class_moves(left, right, sets.similar_sets(words, 60), "lang")
    return equal.select("group.lang", "left_id", "right_id", F.col("n").alias("common"), F.col("n").alias("total")).unionByName(moved)


def q22_in_two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of exactly two sources."""
    found = sets.in_exactly(_tokens(spark, sf_dir), "token", "source", 2)
    return found.select("token", F.col("groups")[0].alias("group_a"), F.col("groups")[1].alias("group_b"))


def q23_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength of hints between sources: shared rare words, equal texts and the folder (not counted)."""
    words = sets.in_exactly(_tokens(spark, sf_dir), "token", "source", 2).select(F.col("groups")[0].alias("a"), F.col("groups")[1].alias("b"), F.lit("token").alias("type"), F.lit(True).alias("counted"))
    docs = table(spark, sf_dir, "documents").select("source", F.md5("text").alias("h")).distinct()
    same = sets.in_exactly(docs, "h", "source", 2).select(F.col("groups")[0].alias("a"), F.col("groups")[1].alias("b"), F.lit("pattern").alias("type"), F.lit(True).alias("counted"))
    folder = words.select("a", "b").distinct().where("substr(a, 1, 4) = substr(b, 1, 4)").select("a", "b", F.lit("folder").alias("type"), F.lit(False).alias("counted"))
    return evidence.strength(words.union(same).union(folder), ["a", "b"])


def q36_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and distinct words of every document."""
    words = F.regexp_extract_all("text", F.lit(t.WORD), F.lit(0))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"), F.size(F.array_distinct(words)).alias("n_distinct"))


def q45_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly-once placement of customers by their orders of early and late keys."""
    orders = table(spark, sf_dir, "orders")
    return sets.placement_errors(orders.where("o_orderkey % 3 <> 0").select("o_custkey"), orders.where("o_orderkey % 3 = 0").select("o_custkey"), "o_custkey")


def q50_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned edits from each turn of a conversation to the next; null where a pair is over the work limit."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    pairs = turns.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return pairs.withColumn("edits", alignment.token_edits("before", "w")).select("conv_id", "turn", F.when(F.col("edits").isNotNull(), F.size("edits")).alias("n_edits"), F.to_json("edits").alias("edits"))


def q57_new_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a user's second half of events has and the first lacks, but for reworded ones, of users with both halves."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor("value").cast("string").alias("body"), (F.dayofmonth("ts") > 15).alias("late"))
    early = events.where("NOT late").drop("late")
    return sets.new_throws(early, events.where("late").drop("late"), ["user_id"], "event_type", "body", early)


def q58_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types of at least fifteen parts of size 10 and less; the rest pooled."""
    counts = table(spark, sf_dir, "part").where("p_size <= 10").groupBy("p_type").agg(F.count("*").alias("n"))
    return evidence.pooled(counts, "p_type", "n", 15)


def q59_mirrors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' word-set mirrors: parts of different brands with the same type whose names overlap by 0.8."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("|", "p_type", F.col("p_size").cast("string")).alias("tail"), F.col("p_brand").alias("top"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("names"))
    return matching.mirror_pairs(parts, "tail", "top", "names")


def q60_settled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the lines of every document are settled: by their clauses, all of which repeat, or by their shape, or not."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("record", "line")).where("line <> ''")
    shape = F.regexp_replace("line", "[A-Za-z_$][A-Za-z0-9_$]*", r"\$")
    edits = lines.select("doc_id", "source", "record", shape.alias("shape"), F.explode(F.split("line", ", ")).alias("literal"))
    return evidence.settled_keys(edits, "doc_id", "record", "literal", "shape", "source")


def _aligned_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between the tokens of whole consecutive turns: ``conv_id, turn, edits``."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.tokens(F.coalesce("text", F.lit(""))).alias("w"))
    pairs = turns.withColumn("before", F.lag("w").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return pairs.select("conv_id", "turn", alignment.token_edits("before", "w").alias("edits"))


def q61b_shape_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shape key for all edits between consecutive turns, null where they have none, and the key in words."""
    shaped = _aligned_turns(spark, sf_dir).select("conv_id", "turn", F.col("edits").isNotNull().alias("compared"), t.shape_key(F.coalesce("edits", F.array().cast(alignment.EDITS)), ["la", "the", "de", "and", "und"]).alias("shape"))
    return shaped.withColumn("words", F.array_join(F.transform(F.split("shape", r" \| "), t.shape_words), "; "))


def q61_edit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal and shape keys of each edit between whole consecutive turns; one row with ``compared`` false where a pair is over the work limit."""
    aligned = _aligned_turns(spark, sf_dir)
    edits = aligned.select("conv_id", "turn", F.col("edits").isNotNull().alias("compared"), F.posexplode_outer("edits").alias("n", "e")).where("n IS NOT NULL OR NOT compared")
    shaped = lambda c: t.shape(F.col(c), ["la", "the", "de"])
    return edits.select("conv_id", "turn", "n", "compared", t.edit_key(F.col("e.removed"), F.col("e.added")).alias("literal"), t.edit_key(shaped("e.removed"), shaped("e.added")).alias("shape"))


_TOK = f"toks AS (SELECT id, source, unnest(tokens) AS token FROM ({WORDS_SQL}))"
_TURNS = "t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS w0, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}') AS w FROM conversations)"
_FIRST = "list_filter(list_transform(range(1, len({x}) + 1), lambda i: CASE WHEN list_position({x}, {x}[i]) = i AND NOT list_contains({y}, {x}[i]) THEN {x}[i] END), lambda v: v IS NOT NULL)"

QUERIES = {f.__name__: f for f in (q08_repeated_patterns, q09_dominant, q10_similar, q10b_similar_members, q11_contained, q12_both_ways, q13_moves, q22_in_two_groups, q23_strength, q36_token_counts, q45_placement, q50_token_edits, q57_new_throws, q58_pooled, q59_mirrors, q60_settled_keys, q61_edit_keys, q61b_shape_keys)}

SQL = {
    "q08_repeated_patterns": f"WITH {_TOK} SELECT token, count(DISTINCT id) AS items, count(DISTINCT source) AS groups FROM toks GROUP BY token HAVING count(DISTINCT id) >= 5 AND count(DISTINCT source) >= 2",
    "q09_dominant": "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, w DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n, max(value) AS w FROM events GROUP BY 1, 2)) WHERE r = 1",
    "q10_similar": f"""WITH d AS ({WORDS_SQL}), c AS MATERIALIZED (SELECT min(id) AS id, list_sort(tokens) AS tk FROM d WHERE len(tokens) > 0 GROUP BY list_sort(tokens)), w AS MATERIALIZED (SELECT id, len(tk) AS n, unnest(tk) AS x FROM c)
        SELECT p.id AS a, q.id AS b, CAST(count(*) AS INT) AS common, CAST(any_value(p.n) + any_value(q.n) - count(*) AS INT) AS total FROM w p JOIN w q ON p.x = q.x AND p.id < q.id AND p.n * 100 >= q.n * 60 AND q.n * 100 >= p.n * 60
        GROUP BY p.id, q.id HAVING count(*) * 100 >= (any_value(p.n) + any_value(q.n) - count(*)) * 60""",
    "q10b_similar_members": f"WITH d AS ({WORDS_SQL}) SELECT id, min(id) OVER (PARTITION BY list_sort(tokens)) AS representative FROM d WHERE len(tokens) > 0",
    "q11_contained": f"""WITH d AS ({WORDS_SQL}), i AS (SELECT item_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS tokens FROM benchmark),
        a AS (SELECT id, len(tokens) AS n, unnest(tokens) AS x FROM i), b AS (SELECT id, len(tokens) AS n, unnest(tokens) AS x FROM d)
        SELECT a.id AS small_id, b.id AS large_id, CAST(count(*) AS INT) AS common, CAST(least(any_value(a.n), any_value(b.n)) AS INT) AS smaller FROM a JOIN b USING (x) GROUP BY a.id, b.id HAVING count(*) * 100 >= least(any_value(a.n), any_value(b.n)) * 80""",
    "q12_both_ways": f"""WITH {_TURNS}, p AS (SELECT conv_id, turn, w, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t),
        s AS (SELECT conv_id, turn, {_FIRST.format(x='w', y='b')} AS a, {_FIRST.format(x='b', y='w')} AS r FROM p WHERE b IS NOT NULL)
        SELECT conv_id, turn, array_to_string(a[1:12], ' ') AS added, CAST(greatest(len(a) - 12, 0) AS INT) AS added_more, array_to_string(r[1:12], ' ') AS removed, CAST(greatest(len(r) - 12, 0) AS INT) AS removed_more FROM s""",
    "q22_in_two_groups": f"WITH {_TOK} SELECT token, min(source) AS group_a, max(source) AS group_b FROM toks GROUP BY token HAVING count(DISTINCT source) = 2",
    "q23_strength": f"""WITH {_TOK}, w AS (SELECT min(source) AS a, max(source) AS b FROM toks GROUP BY token HAVING count(DISTINCT source) = 2), s AS (SELECT min(source) AS a, max(source) AS b FROM documents GROUP BY md5(text) HAVING count(DISTINCT source) = 2),
        e AS (SELECT a, b, 'token' AS type, true AS counted FROM w UNION ALL SELECT a, b, 'pattern', true FROM s UNION ALL SELECT DISTINCT a, b, 'folder', false FROM w WHERE substr(a, 1, 4) = substr(b, 1, 4))
        SELECT a, b, count(DISTINCT CASE WHEN counted THEN type END) AS strength, count(*) AS pieces FROM e GROUP BY a, b HAVING count_if(counted) > 0""",
    "q36_token_counts": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS INT) AS n, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))) AS INT) AS n_distinct FROM documents",
    "q45_placement": """WITH e AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)
        SELECT o_custkey, 'missing' AS error FROM (SELECT * FROM e EXCEPT SELECT * FROM p) UNION ALL SELECT o_custkey, 'unknown' FROM (SELECT * FROM p EXCEPT SELECT * FROM e) UNION ALL SELECT o_custkey, 'duplicate' FROM p GROUP BY 1 HAVING count(*) > 1""",
    "q57_new_throws": """WITH e AS (SELECT DISTINCT user_id, event_type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS body, day(ts) > 15 AS late FROM events),
        fresh AS (SELECT * FROM e WHERE late AND NOT EXISTS (SELECT 1 FROM e b WHERE NOT b.late AND b.user_id = e.user_id AND b.body = e.body) AND user_id IN (SELECT user_id FROM e WHERE NOT late)),
        gone AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE NOT late AND NOT EXISTS (SELECT 1 FROM e b WHERE b.late AND b.user_id = e.user_id AND b.body = e.body) GROUP BY 1, 2)
        SELECT user_id, event_type, body FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS come FROM fresh) LEFT JOIN gone USING (user_id, event_type) WHERE come > coalesce(n, 0)""",
    "q58_pooled": """WITH c AS (SELECT p_type, count(*) AS n FROM part WHERE p_size <= 10 GROUP BY 1) SELECT p_type, n FROM c WHERE n >= 15 UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM c WHERE n < 15 HAVING sum(n) >= 15""",
    "q59_mirrors": """WITH p AS (SELECT p_partkey AS id, p_type || '|' || p_size AS tail, p_brand AS top, list_distinct(string_split(lower(p_type), ' ')) AS names FROM part), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tail ORDER BY id) AS n FROM p) WHERE n <= 8)
        SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.names, b.names)) AS INT) AS common, CAST(least(len(a.names), len(b.names)) AS INT) AS smaller FROM f a JOIN f b ON a.tail = b.tail AND a.id < b.id AND a.top <> b.top WHERE len(list_intersect(a.names, b.names)) * 10 >= least(len(a.names), len(b.names)) * 8""",
    "q60_settled_keys": r"""WITH lines AS (SELECT doc_id, source, CAST(generate_subscripts(l, 1) - 1 AS INT) AS record, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
        e AS (SELECT doc_id, source, record, regexp_replace(line, '[A-Za-z_$][A-Za-z0-9_$]*', '$', 'g') AS shape, unnest(string_split(line, ', ')) AS literal FROM lines WHERE line <> ''),
        k AS (SELECT DISTINCT doc_id, source, literal FROM e WHERE len(list_filter(regexp_extract_all(replace(literal, '→', ' '), '[A-Za-z_$][\w$]*|\d+(?:\.\d+)?|"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''|`(?:[^`\\]|\\.)*`|[^\s\w]'), lambda x: regexp_matches(x, '^[A-Za-z0-9_$"''`]'))) >= 2),
        lit AS (SELECT literal FROM k GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT source) >= 2),
        r AS (SELECT doc_id, source, record, any_value(shape) AS shape, bool_and(literal IN (FROM lit)) AS settled FROM e GROUP BY 1, 2, 3),
        shp AS (SELECT shape FROM r WHERE NOT settled GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT source) >= 2)
        SELECT doc_id, record, CASE WHEN settled THEN 'literal' WHEN shape IN (FROM shp) THEN 'shape' END AS level, CASE WHEN NOT settled AND shape IN (FROM shp) THEN shape END AS shape FROM r""",
}
