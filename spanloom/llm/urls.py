"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join, with DataFrame functions only.

Rules are (host, path prefix, verdict). A page asks for its own host suffixes that are listed, and there for the path prefixes
of listed lengths; a blocked Bloom filter (one 64-bit word per block, four bits a key) passes possible hits, of hosts and
then of canonical keys, and hash joins remove the false positives. The filter grows with the list (a word for four rules)
up to a fixed largest size, so broadcasting it is safe at any length of the list: a longer list only passes more false hits
to the join. The list itself is joined by hash, broadcast only when its counted rows are few; nothing of it reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Most words of the Bloom filter; each is a broadcast row of 12 bytes.
MAX_BLOCKS = 1 << 20
#: Most rules that are broadcast for the exact join.
MAX_BROADCAST_RULES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _LOWER), F.regexp_extract(text, _PARTS, 2)


def _bits(key: Column) -> Column:
    """Four bits of a 64-bit word, from bits of the hash that do not choose the block."""
    h = F.xxhash64(key, F.lit("bits"))
    word = F.lit(0).cast("long")
    for k in range(4):
        word = word.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")))
    return word


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """``block, word`` rows of the filter over a column of strings; at most ``blocks`` rows."""
    return keys.groupBy(F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int").alias("block")).agg(F.bit_or(_bits(F.col(key))).alias("word"))


def _possible(rows: DataFrame, column: str, keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows whose value passes the filter over ``keys[key]``: all that are listed, and few others."""
    block = F.pmod(F.xxhash64(F.col(column)), F.lit(blocks)).cast("int")
    tried = rows.withColumn("__block", block).withColumn("__bits", _bits(F.col(column)))
    met = tried.join(F.broadcast(bloom_filter(keys, key, blocks)), F.col("__block") == F.col("block"))
    return met.where(F.col("word").bitwiseAND(F.col("__bits")) == F.col("__bits")).select(*rows.columns)


def judged(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains where the page's path starts with the
    rule's; of several the longest (host and path together) wins, then the smaller text, then ``allow``. Pages that no
    listed URL fits get ``default`` and a null rule. Null urls and urls without ``://`` have empty host and path and fit
    only rules whose host is empty. Repeated rules count once, repeated pages are judged each; empty tables are fine. Very long
    urls are judged whole. Other columns of both tables are not read, whatever their names.
    """
    host, path = host_and_path(F.col(url_col))
    seen = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    listed = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
    ).withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("key", F.concat_ws("\n", "rule_host", "rule_path"))
    listed = listed.groupBy("key", "rule_host", "rule_path", "rule").agg(F.min("verdict").alias("verdict"))
    listed = written(listed, "url-rules")
    n_rules = listed.count()
    blocks = min(MAX_BLOCKS, max(1, n_rules // 4))
    near = lambda df: F.broadcast(df) if n_rules <= MAX_BROADCAST_RULES else df
    # A page asks with its own host suffixes, and below a listed host with prefixes of the lengths that are listed there.
    hosts = listed.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    urls = seen.select("host", "path").distinct()
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    asked = _possible(urls.select("host", "path", F.explode(suffixes).alias("suffix")), "suffix", hosts, "rule_host", blocks)
    below = asked.join(near(hosts), F.col("suffix") == F.col("rule_host"))
    lengths = F.filter("lengths", lambda n: n <= F.length("path"))
    probes = below.select("host", "path", "suffix", F.explode(lengths).alias("chars")).select("host", "path", F.concat_ws("\n", "suffix", F.substring("path", F.lit(1), F.col("chars"))).alias("key"))
    passed = _possible(probes, "key", listed, "key", blocks)
    hits = passed.join(near(listed.select("key", "rule", "verdict")), "key")
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("shortness"), F.col("rule"), F.col("verdict"))).alias("best")
    )
    out = seen.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
