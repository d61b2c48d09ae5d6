"""Relations that the queries derive from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_extendedprice", "l_discount", "l_tax")


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans of their order: ``k, ord, lo, hi, flag, part, supp``; the order of lines is total.

    Lines that are equal up to the flag are equal in all that a span shows, so their price, discount and tax, which come later in
    the order, cannot change the spans and are not shuffled.
    """
    lines = table(spark, sf_dir, "lineitem")
    lo = F.col("l_quantity").cast("int")
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[: LINE_ORDER.index("l_returnflag") + 1]))
    return lines.select(F.col("l_orderkey").alias("k"), order.alias("ord"), lo.alias("lo"), (lo + F.col("l_linenumber")).alias("hi"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"))


SPANS_SQL = """spans AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_extendedprice, l_discount, l_tax) AS ord,
    CAST(l_quantity AS INT) AS lo, CAST(l_quantity AS INT) + l_linenumber AS hi, l_returnflag AS flag, l_partkey AS part, l_suppkey AS supp FROM lineitem)"""


def consecutive(spark: SparkSession, sf_dir: str, item: str, distinct: bool = True) -> DataFrame:
    """Edges ``src -> dst`` between consecutive items of every order, each once unless the caller makes a set of them anyway.

    The order of lines begins with number, part and supplier. Lines that are equal up to the item have the same item, so what
    follows it in the order cannot change the edges.
    """
    column = f"l_{item}key"
    lines = table(spark, sf_dir, "lineitem")
    step = lines.select(F.col(column).alias("src"), F.lead(column).over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER[: LINE_ORDER.index(column) + 1])).alias("dst"))
    edges = step.where("dst IS NOT NULL AND src <> dst")
    return edges.distinct() if distinct else edges


def edges_sql(item: str) -> str:
    return f"""{SPANS_SQL}, edges AS (SELECT DISTINCT src, dst FROM (SELECT {item} AS src, lead({item}) OVER (PARTITION BY k ORDER BY ord) AS dst FROM spans) WHERE dst IS NOT NULL AND src <> dst)"""


def document_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, tokens, source``: distinct lower-case ASCII words of three letters and more of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("tokens"), "source")


WORDS_SQL = "SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS tokens, source FROM documents"
