"""Resampling documents towards a target corpus, with a dictionary of distinct features.

Features are runs of one to ``longest`` words. Every task counts the features of its texts, the counts are added up into a
dictionary of distinct strings, and only there is each string hashed, once, to its bucket. Bucket sums of both corpora give a
gain for each bucket, and so for each string of the dictionary. A second scan joins the gains to the feature counts of every
document: strings that make up at least one in ``hot`` of all features are at most ``hot`` (so the map of their gains, which
is broadcast, is bounded), all others are rows joined by a shuffle on the string, none of which is a hot key.

A document's weight is the sum of its features' gains. Gumbel noise drawn from its id is added, and the documents with the
highest scores are drawn; ranks come from ranges of the score, not from one sorted task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import positioned
from .scratch import dropped, written

#: Bytes of a text as words: A-Z lower-cased, digits, letters and all bytes beyond ASCII kept, the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Strings of a task's dictionary before it is handed on, strings longer than this are never broadcast.
_MOST, _LONG = 200_000, 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def features_of(words: list[bytes], longest: int) -> Counter[bytes]:
    """How often each run of one to ``longest`` words occurs, joined by spaces."""
    found = Counter(words)
    for n in range(2, longest + 1):
        found.update(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return found


def _count(longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["feature", "n"])
            found.clear()
            return made

        for batch in batches:
            for text in batch.column(0):
                found.update(features_of(words_of(text.as_py()), longest))
                if len(found) >= _MOST:
                    yield emit()
        if found:
            yield emit()

    return count


def dictionary(docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """``feature, n, bucket``: how often each distinct feature occurs in all texts, each string hashed once."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(longest), "feature binary, n long")
    return counted.groupBy("feature").agg(F.sum("n").alias("n")).withColumn("bucket", F.pmod(F.crc32("feature"), F.lit(buckets)).cast("int"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of the buckets of one dictionary against another's: the floor of a thousand log-ratios, one count added to each bucket."""
    own = docs.groupBy("bucket").agg(F.sum("n").alias("s"))
    theirs = target.groupBy("bucket").agg(F.sum("n").alias("t"))
    total_s, total_t = (float((x.agg(F.sum("n")).first()[0] or 0) + buckets) for x in (docs, target))
    up = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(total_s)
    down = (F.col("s") + 1).cast("double") * F.lit(total_t)
    return own.join(theirs, "bucket", "left").select("bucket", F.floor(1000 * F.ln(up / down)).cast("long").alias("gain"))


_ROW = "row long, doc_id long, n_features long, n_words long, weight long, feature binary, n long"


def _weigh(longest: int, hot):
    """For each document a row with what broadcast gains give, and a row for each feature whose gain is not among them."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = hot.value
        names = [c.split()[0] for c in _ROW.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words_of(text.as_py())
                found = features_of(words, longest)
                known = [n * held[f] for f, n in found.items() if f in held]
                rest = [(f, n) for f, n in found.items() if f not in held] if len(known) < len(found) else []
                head = (row, doc, found.total(), len(words), sum(known), None, None)
                for column, value in zip(out, head, strict=True):
                    column.append(value)
                for column, value in zip(out[:5], (row, None, None, None, None), strict=True):
                    column += [value] * len(rest)
                out[5] += [f for f, _ in rest]
                out[6] += [n for _, n in rest]
                if len(out[0]) >= 50_000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    out = [[] for _ in names]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return weigh


def weighted(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1,
             buckets: int = 10_000, hot: int = 50_000) -> DataFrame:
    """``row, doc_id, n_features, n_words, weight`` for every row of ``docs``; ``row`` tells rows apart.

    Null and empty texts and texts without words have no features and weight 0. Texts are taken whole, repeated rows are
    documents of their own, null ids stay null, other columns are not read. Any size of ``hot`` gives the same result.
    """
    spark = docs.sparkSession
    own = written(dictionary(docs, text_col, longest, buckets), "importance-features")
    wanted = written(dictionary(target, target_text_col, longest, buckets), "importance-target")
    gain = written(gains(own, wanted, buckets), "importance-gains")
    total = own.agg(F.sum("n")).first()[0] or 0
    priced = own.join(F.broadcast(gain), "bucket").select("feature", "n", "gain")  # at most ``buckets`` rows
    is_hot = (F.col("n") * hot >= total) & (F.octet_length("feature") <= _LONG)
    frequent = priced.where(is_hot).select("feature", "gain").toArrow()
    held = spark.sparkContext.broadcast(dict(zip(frequent.column(0).to_pylist(), frequent.column(1).to_pylist(), strict=True)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(rows.mapInArrow(_weigh(longest, held), _ROW), "importance-rows")
    others = priced.where(~is_hot).select("feature", "gain")
    more = rows.where("feature IS NOT NULL").select("row", "feature", "n").join(others, "feature").groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    heads = rows.where("feature IS NULL").select("row", "doc_id", "n_features", "n_words", "weight")
    out = written(heads.join(more, "row", "left").select("row", "doc_id", "n_features", "n_words", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")), "importance-weights")
    for table in (own, wanted, gain, rows):
        dropped(table)
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, as a whole number, from the id alone; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1,
              buckets: int = 10_000, hot: int = 50_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``; ``rank`` is null for a row that is not drawn.

    Of the N rows with at least ``least_words`` words, the floor of ``percent`` per cent of N are drawn: those with the
    highest scores, ties to the smaller id (a null id last), and equal rows with equal ids in any order. An empty table
    gives no rows; an empty target weighs by the corpus alone. See :func:`weighted` for nulls and odd texts.
    """
    rows = weighted(docs, target, id_col=id_col, text_col=text_col, target_text_col=target_text_col, longest=longest, buckets=buckets, hot=hot)
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("__able", F.col("n_words") >= least_words)
    drawn = percent * scored.where("__able").count() // 100
    order = [F.desc("__able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")]
    placed = positioned(scored, order, name="__place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("__place") <= drawn, F.col("__place")).alias("rank"))
