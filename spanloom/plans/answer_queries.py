"""Answers and splits on tables derived from documents, orders and urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..operators import splits
from . import answers
from .tables import consecutive, table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return docs.select(F.lit("head").alias("side"), path.alias("path"), F.posexplode(F.split("text", "\n")).alias("n", "text")).select("side", "path", (F.col("n") + 1).alias("line"), "text")


def q69_search_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two hundred lines with a fixed string in the files of one source."""
    return answers.search_code(_lines(spark, sf_dir), "tion", "src1/", 200)


def q70_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines two to five of one file."""
    return answers.get_source(_lines(spark, sf_dir), "src0/fr/0", 2, 5)


def q71_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that the first word of each line is near the line behind the next one, whether the file has such a line, and whether it is called."""
    lines = _lines(spark, sf_dir)
    word = F.regexp_extract("text", r"([A-Za-z_$][\w$]*)", 1)
    claims = lines.select("path", (F.col("line") + 2).alias("line"), word.alias("callee")).where("callee <> ''").distinct()
    return answers.check_evidence(claims, lines)


def q72_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cards, their orders as changes and order lines as callers: the second page of thirty."""
    orders = table(spark, sf_dir, "orders")
    cid = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    cards = orders.select(cid.alias("id")).distinct().withColumn("label", F.col("id"))
    members = orders.select(cid.alias("card"), F.col("o_orderkey").cast("string").alias("change"))
    kinds = F.when(F.col("o_orderpriority").startswith("1"), F.array(F.lit("new-throw"))).otherwise(F.array(F.lit("body")))
    changes = orders.select(F.col("o_orderkey").cast("string").alias("id"), F.floor(F.col("o_totalprice") / 1000).cast("int").alias("score"), kinds.alias("kinds"), (F.col("o_orderstatus") != "P").alias("callers_complete"))
    state = F.when(F.col("l_linestatus") == "O", "unchanged").otherwise("updated-at-call")
    callers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("change"), (F.col("l_returnflag") == "R").alias("is_test"), state.alias("call_state"))
    return answers.list_cards(cards, members, changes, callers, 2, 30).drop("page_size")


def q73_folder_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Url paths of each language split by folder, folders under three joined to their parents."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    members = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://[^/]*/(\w\w)/", 1).alias("grp"), F.col("page_id").alias("id"), path.alias("path"))
    return splits.by_folder(members, 3)


def q73b_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand by folder (their type) and file (their size), where a brand has more than twelve; brands that end in 5 are new code."""
    brand = F.col("p_brand")
    path = F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/f"), (F.col("p_size") % 7).cast("string"))
    rows = table(spark, sf_dir, "part").select(brand.alias("grp"), F.col("p_partkey").alias("id"), path.alias("path"), (brand.endswith("5") | (F.col("p_partkey") % 3 == 0)).alias("added"))
    return splits.by_size(rows).select("grp", "id", "folder", "file")


def q74_commit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation split by the brands of one part each (as commits), with calls between consecutive ones."""
    brands = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.min("l_partkey").alias("p_partkey")).join(table(spark, sf_dir, "part"), "p_partkey").select("id", F.array(F.substring("p_brand", 1, 7)).alias("commits"))
    members = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 5).alias("grp"), F.col("s_suppkey").alias("id")).join(brands, "id").select("grp", "id", "commits")
    one = consecutive(spark, sf_dir, "supp")
    return splits.by_commits(members, one.union(one.select("dst", "src")), most_classes=50)


def q75_hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hubs among suppliers of each nation group, over consecutive ones."""
    members = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).cast("long").alias("grp"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("string").alias("path"), F.floor("s_acctbal").cast("int").alias("score"))
    return splits.at_hubs(members, consecutive(spark, sf_dir, "supp"))


def q76_code_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls on the script lines of raw pages, comments taken out."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    return code.code_lines(pages).where(F.size("calls") > 0).select("path", "line", F.array_join("calls", " ").alias("calls"))


_LINES = "lines AS (SELECT path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT source || '/' || lang || '/' || doc_id AS path, string_split(text, chr(10)) AS l FROM documents))"

QUERIES = {f.__name__: f for f in (q69_search_code, q70_source, q71_evidence, q72_cards, q73_folder_split, q73b_size_split, q74_commit_split, q75_hubs, q76_code_lines)}

SQL = {
    "q73b_size_split": """WITH m AS (SELECT p_brand AS grp, p_partkey AS id, replace(p_type, ' ', '/') || '/f' || (p_size % 7) AS path, ends_with(p_brand, '5') OR p_partkey % 3 = 0 AS added, replace(p_type, ' ', '/') AS f3, count(*) OVER (PARTITION BY p_brand) AS size FROM part),
        a AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY grp, f3) < 3 AND len(string_split(f3, '/')) >= 3 THEN regexp_extract(f3, '^(.*)/[^/]*$', 1) ELSE f3 END AS f2 FROM m WHERE size > 12),
        b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY grp, f2) < 3 AND len(string_split(f2, '/')) = 2 THEN regexp_extract(f2, '^(.*)/[^/]*$', 1) ELSE f2 END AS f1 FROM a),
        c AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY grp, f1) < 3 AND NOT contains(f1, '/') THEN '' ELSE f1 END AS folder FROM b),
        d AS (SELECT *, count(*) OVER p AS n, count_if(added) OVER p AS fresh, count(*) OVER (PARTITION BY grp, folder, path) AS own FROM c WINDOW p AS (PARTITION BY grp, folder)),
        e AS (SELECT *, bool_or(NOT added AND EXISTS (SELECT 1 FROM d x WHERE x.grp = d.grp AND x.folder = d.folder AND x.f3 = d.f3 AND x.added)) OVER (PARTITION BY grp, folder) AS mixed,
            min({'k': -own, 'path': path}) OVER (PARTITION BY grp, folder) AS largest, min(path) OVER (PARTITION BY grp, folder) <> max(path) OVER (PARTITION BY grp, folder) AS several FROM d)
        SELECT grp, id, folder, CASE WHEN n > 12 AND several AND NOT (fresh * 2 > n AND NOT mixed) THEN CASE WHEN own < 3 THEN largest.path ELSE path END END AS file FROM e
        UNION ALL SELECT grp, id, NULL, NULL FROM m WHERE size <= 12""",
    "q69_search_code": f"WITH {_LINES}, h AS (SELECT path, line, text FROM lines WHERE contains(text, 'tion') AND starts_with(path, 'src1/') ORDER BY path, line LIMIT 201) SELECT *, (SELECT count(*) > 200 FROM h) AS capped FROM h ORDER BY path, line LIMIT 200",
    "q70_source": f"WITH {_LINES} SELECT line, text, false AS cut FROM lines WHERE path = 'src0/fr/0' AND line BETWEEN 2 AND 5",
    "q71_evidence": rf"""WITH {_LINES}, c AS (SELECT DISTINCT path, line + 2 AS line, regexp_extract(text, '([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS callee FROM lines), code AS (SELECT path, line, regexp_replace(text, '//.*$|#.*$', '') AS code FROM lines),
        sizes AS (SELECT path, max(line) AS size FROM lines GROUP BY 1)
        SELECT c.path, c.line, c.callee, coalesce(bool_or(list_contains(regexp_extract_all(code, '[A-Za-z0-9_$]+'), callee)), false) AS ok,
            coalesce(bool_or(regexp_matches(code, '(^|[^A-Za-z0-9_$])' || replace(callee, '$', '\$') || '\s*(?:<[^>]*>)?\s*\(')), false) AS call, c.line <= any_value(size) AS complete
        FROM c JOIN sizes USING (path) LEFT JOIN code l ON l.path = c.path AND l.line BETWEEN c.line - 1 AND c.line + 1 WHERE c.callee <> '' GROUP BY 1, 2, 3""",
    "q72_cards": """WITH s AS (SELECT l_orderkey AS k, count_if(l_returnflag <> 'R') AS callers, count_if(l_returnflag <> 'R' AND l_linestatus = 'O') AS stale, count_if(l_returnflag = 'R') AS tests FROM lineitem GROUP BY 1),
        c AS (SELECT lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS id, count(*) AS members, CAST(sum(coalesce(callers, 0)) AS BIGINT) AS callers, CAST(sum(coalesce(stale, 0)) AS BIGINT) AS stale, CAST(sum(coalesce(tests, 0)) AS BIGINT) AS tests,
            count_if(o_orderpriority LIKE '1%') AS risky, count_if(o_orderstatus = 'P') AS incomplete, max(CAST(floor(o_totalprice / 1000) AS INT)) AS top_score FROM orders LEFT JOIN s ON k = o_orderkey GROUP BY 1)
        SELECT id, id AS label, members, callers, stale, tests, risky, incomplete, top_score, row_number() OVER (ORDER BY top_score DESC, id) AS position, (SELECT count(*) FROM c) AS total, CAST(ceil((SELECT count(*) FROM c) / 30.0) AS BIGINT) AS pages FROM c QUALIFY position BETWEEN 31 AND 60""",
}
