"""Quality selection by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Features are runs of one and two words (single words with their case) and runs of punctuation, hashed to a fixed number of
buckets. The raw model counts all documents, the target model the labelled good ones; their log-ratio per bucket is a
vector of bounded size that is broadcast. A document's log-weight is the log-ratio of the two models for its text: the sum
over its features. Adding Gumbel noise hashed from its id and taking the k largest draws k documents without replacement
in proportion to their weights.

Sums grow with length, so between long texts the noise decides little. ``per_feature`` replaces the sum by that many
times the mean: an option, not the method.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .text import _TOP, alphanumerics, fold, fold_alnum, run_hash, slices, windows, word_hashes


@lru_cache(maxsize=None)
def _cased() -> np.ndarray:
    return np.where(alphanumerics() > 0, np.arange(_TOP, dtype=np.uint32), np.uint32(0))


@lru_cache(maxsize=None)
def _marks() -> np.ndarray:
    return np.array([0 if c.isalnum() or c.isspace() else ord(c) for c in map(chr, range(_TOP))], np.uint32)


def features(texts: list[str], n_buckets: int, orders: tuple[int, ...] = (1, 2)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Families of features: buckets of all texts in order, and where each text's begin."""
    families = [(2 * n, (lambda c: fold(c, _cased())) if n == 1 else fold_alnum, n) for n in orders]
    for salt, folding, n in [*families, (1, lambda c: fold(c, _marks()), 1)]:
        h, starts = word_hashes(texts, folding)
        runs, starts = windows(h, starts, n) if n > 1 else (run_hash(h, np.arange(len(h)), (0,)), starts)
        with np.errstate(over="ignore"):
            yield (((runs * np.uint64(2 * salt + 1)) >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int64), starts


def _count(n_buckets: int, orders: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(n_buckets, np.int64), np.zeros(n_buckets, np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for begin, texts in slices(batch, 0):
                for buckets, starts in features(texts, n_buckets, orders):
                    np.add.at(raw, buckets, 1)
                    np.add.at(target, buckets[np.repeat(good[begin : begin + len(texts)], np.diff(starts))], 1)
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], ["bucket", "raw", "target"])

    return count


def fit(docs: DataFrame, good: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_buckets: int = 1 << 18, orders: tuple[int, ...] = (1, 2), smoothing: float = 10.0, max_good: int = 50_000) -> np.ndarray:
    """Log-ratio of target to raw probability for each bucket.

    ``good`` lists ids of target documents; at most ``max_good`` of them, by hash order, make the target model (their list
    is broadcast). The raw model counts every document. Without any target document the ratios are all zero.
    """
    chosen = good.select(F.col(id_col).cast("long").alias("__good")).where("__good IS NOT NULL").distinct().orderBy(F.xxhash64("__good"), "__good").limit(max_good)
    rows = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__good"), "left").select(docs[text_col].alias("text"), F.col("__good").isNotNull().alias("good"))
    counts = rows.mapInArrow(_count(n_buckets, orders), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    at = counts["bucket"].to_numpy(dtype=np.int64)
    raw[at], target[at] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(n_buckets)
    # Each ratio is drawn towards 1 by ``smoothing`` expected counts, so that what only a few documents hold says little,
    # whether or not they are among the target documents.
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + smoothing) / (expected + smoothing))


def scored(docs: DataFrame, ratio: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``doc_id, n_features, log_ratio``: the summed log-ratio of each document's features, 0 for a text without any."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for begin, texts in slices(batch, 1):
                for buckets, starts in features(texts, len(shared.value), orders):
                    counts = np.diff(starts)
                    full = np.flatnonzero(counts)
                    if len(full):
                        total[begin + full] += np.add.reduceat(shared.value[buckets], starts[full])
                    n[begin : begin + len(texts)] += counts
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["doc_id", "n_features", "log_ratio"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, "doc_id long, n_features long, log_ratio double")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise from the hash of a key; the same in every run."""
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by histograms that narrow to its bin; the driver sees at most ``bins`` counts a pass."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    above = 0  # rows known to be larger than high
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        counts = {r["at"]: (r["n"], r["low"], r["high"]) for r in rows.where(F.col(column).between(low, high)).groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for b in sorted(counts, reverse=True):
            n, bin_low, bin_high = counts[b]
            if above + n >= k:
                if (bin_low, bin_high) == (low, high):  # no narrower than doubles allow
                    return low
                low, high = bin_low, bin_high
                break
            above += n
    return low


def resampled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float | None = None, orders: tuple[int, ...] = (1, 2), per_feature: float | None = None, seed: int = 29) -> DataFrame:
    """``doc_id, n_features, log_ratio, key, kept`` for every document: kept are the k with the largest Gumbel keys.

    ``labels`` has ``doc_id, quality, toxic``; target documents have quality 1 and toxic 0. k is ``share`` of the rows,
    by default the share of target documents among labelled ones (1 without labels). The log-weight is ``log_ratio``, or
    with ``per_feature`` that many times its mean. A null, empty or featureless text has log-ratio 0, the corpus average;
    very long texts are read whole. Keys are equal only in rows that repeat an id and text; rows that tie with the k-th
    key are kept together. Null ids share one noise value. Other columns are not read, whatever their names. An empty
    table gives no rows.
    """
    is_good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    ratio = fit(docs, labels.where(is_good), id_col=id_col, text_col=text_col, orders=orders)
    weight = F.col("log_ratio") if per_feature is None else F.col("log_ratio") / F.greatest("n_features", F.lit(1)) * per_feature
    keyed = scored(docs, ratio, id_col=id_col, text_col=text_col, orders=orders).withColumn("key", weight + gumbel(F.coalesce("doc_id", F.lit(-1)), seed))
    keyed = written(keyed, "quality")
    n = keyed.count()
    if share is None:
        found, all_ = labels.agg(F.sum(is_good.cast("long")), F.count("*")).first()
        share = found / all_ if found else 1.0
    k = min(n, max(1, round(share * n)))
    least = kth_largest(keyed, "key", k) if n else 0.0
    return keyed.withColumn("kept", F.col("key") >= F.lit(least))
