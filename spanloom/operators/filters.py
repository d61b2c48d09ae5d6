"""Semi-join reduction: a bitmap of fixed size, built by aggregation and broadcast, in front of an exact join.

Rows whose bit is not set surely have no partner, so they need no shuffle. The bitmap has at most ``BITS / 64`` rows however
many keys there are; with very many keys it fills up and lets everything through to the exact join, which then decides
alone. Nulls have no partner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 65,536 broadcast rows of a word and its number.
BITS = 1 << 22


def _place(key: Column) -> tuple[Column, Column]:
    bit = F.pmod(F.xxhash64(key), F.lit(BITS))
    return F.floor(bit / 64).cast("int"), F.pmod(bit, F.lit(64)).cast("int")


def with_hint(df: DataFrame, column: str, keys: DataFrame, key: str, hint: str = "__maybe") -> DataFrame:
    """``df`` with a boolean ``hint``: whether the value of ``column`` may be among ``keys[key]``; false is certain."""
    word, bit = _place(F.col(key).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = keys.where(F.col(key).isNotNull()).groupBy(word.alias("__word")).agg(F.bit_or(one).alias("__bits"))
    word, bit = _place(F.col(column).cast("long"))
    marked = df.withColumn("__at", word).withColumn("__bit", bit).join(F.broadcast(words), F.col("__at") == F.col("__word"), "left")
    hit = F.col(column).isNotNull() & F.coalesce(F.call_function("getbit", F.col("__bits"), F.col("__bit")) == 1, F.lit(False))
    return marked.withColumn(hint, hit).drop("__at", "__bit", "__word", "__bits")


def possibly_in(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` that may have a partner: all that have one, and few others."""
    return with_hint(df, column, keys, key).where("__maybe").drop("__maybe")


def without(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is not among the keys. Only those that may be are joined; the others stay where they are."""
    marked = with_hint(df, column, keys, key)
    doubtful = marked.where("__maybe").drop("__maybe")
    gone = keys.select(F.col(key).alias("__gone"))
    return marked.where("NOT __maybe").drop("__maybe").unionByName(doubtful.join(gone, doubtful[column] == F.col("__gone"), "left_anti"))
