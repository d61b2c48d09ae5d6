"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are folded to lower-case letters, everything else to one space, and cut into n-grams of one to three characters
that end at each position; an n-gram is a bucket of a fixed number of hash buckets. Fitting counts buckets per language
inside the tasks and sums them by key; the log-probability matrix (buckets x languages) is made and broadcast for at most
``block`` languages at a time, so its size is bounded however many there are. Scoring gathers the matrix rows of a batch's
n-grams, some languages at a time, and sums them per document in numpy; a second block of languages is a second scan, which
carries each document's best language, its log-probability and the sum of all so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import written
from .text import codepoints, fold, letters, slices

UNKNOWN = "und"
_PIECE = 1 << 18


#: Languages whose weights are gathered at once: 2^18 positions x 16 languages x 8 bytes are 33 MB.
_WIDTH = 16


@dataclass(frozen=True)
class Block:
    """Some languages: ``weights`` has a row per bucket and a last row of zeros for positions outside any text; ``prior`` one entry a language."""

    languages: tuple[str, ...]
    prior: np.ndarray
    weights: np.ndarray


@dataclass(frozen=True)
class Model:
    """Languages in order with their numbers of documents; ``counts`` (``lang, bucket, n``) holds what the matrices are made from."""

    languages: tuple[str, ...]
    docs: tuple[int, ...]
    counts: DataFrame | None
    n_buckets: int
    orders: tuple[int, ...]
    smoothing: float
    block: int

    def blocks(self) -> Iterator[Block]:
        """Matrices of the languages, in order, at most ``block`` at a time; one without languages for a model of none."""
        total = sum(self.docs)
        for low in range(0, max(1, len(self.languages)), self.block):
            names, docs = self.languages[low : low + self.block], np.array(self.docs[low : low + self.block], float)
            matrix = np.full((self.n_buckets, len(names)), float(self.smoothing))
            if names:
                found = self.counts.where(F.col("lang").isin(list(names)) & (F.col("bucket") >= 0)).toPandas()
                column = found["lang"].map({x: i for i, x in enumerate(names)}).to_numpy(dtype=np.int64)
                matrix[found["bucket"].to_numpy(dtype=np.int64), column] += found["n"].to_numpy(dtype=np.float64)
            weights = np.vstack((np.log(matrix / matrix.sum(0)), np.zeros((1, len(names)))))
            yield Block(names, np.log(docs / total) if names else docs, weights)


def buckets_of(texts: list[str], n_buckets: int, orders: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a batch: text numbers, where each begins, buckets (orders x positions), and how many letters each has.

    Every piece is preceded by the characters before it, or spaces at a text's start, so the n-grams ending in it are all
    there and long texts may be cut anywhere. Those lead-in positions get the bucket ``n_buckets``.
    """
    lead = max(orders) - 1
    table = letters()

    def emit(numbers, parts):
        lengths = np.array([len(p) for p in parts])
        begins = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)[:-1]))
        codes = fold(codepoints("".join(parts)), table)
        is_letter = codes != 0
        codes = np.where(is_letter, codes, np.uint32(32)).astype(np.uint64)
        outside = np.zeros(len(codes), bool)
        for k in range(lead):
            outside[begins + k] = True
        rows = []
        gram = np.zeros(len(codes), np.uint64)
        for n in range(1, max(orders) + 1):
            shifted = codes if n == 1 else np.concatenate((np.full(n - 1, 32, np.uint64), codes[: 1 - n]))
            gram = gram * np.uint64(0x100000001B3) + shifted + np.uint64(n)
            if n in orders:
                hashed = gram * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
                hashed *= np.uint64(0xBF58476D1CE4E5B9)
                bucket = (hashed >> np.uint64(33)).astype(np.int64) % n_buckets
                bucket[outside] = n_buckets
                rows.append(bucket)
        is_letter[outside] = False
        return np.asarray(numbers), begins, np.stack(rows), np.add.reduceat(is_letter, begins, dtype=np.int64)

    numbers, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), _PIECE):
            before = text[max(0, at - lead) : at].rjust(lead)
            numbers.append(i)
            parts.append(before + text[at : at + _PIECE])
            size += len(parts[-1])
            if size >= _PIECE:
                yield emit(numbers, parts)
                numbers, parts, size = [], [], 0
    if numbers:
        yield emit(numbers, parts)


#: Languages whose counts a task holds at once; a further one hands the others on to the aggregation.
_HELD = 256


def _count(n_buckets: int, orders: tuple[int, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, total in totals.items():
                at = np.flatnonzero(total[:n_buckets])
                yield pa.record_batch([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], docs[lang]), pa.int64())], ["lang", "bucket", "n"])
            totals.clear()
            docs.clear()

        for batch in batches:
            langs = batch.column(1).to_pylist()
            for begin, part in slices(batch, 0):
                by_lang: dict[str, list[str]] = {}
                for text, lang in zip(part, langs[begin:], strict=False):
                    by_lang.setdefault(lang, []).append(text)
                for lang, texts in by_lang.items():
                    if lang not in totals and len(totals) >= _HELD:
                        yield from emit()
                    total = totals.setdefault(lang, np.zeros(n_buckets + 1, np.int64))
                    docs[lang] = docs.get(lang, 0) + len(texts)
                    for _, _, buckets, _ in buckets_of(texts, n_buckets, orders):
                        total += np.bincount(buckets.ravel(), minlength=n_buckets + 1)
        yield from emit()

    return count


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", n_buckets: int = 1 << 14, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.5, block: int = 64) -> Model:
    """Model from every row with a text and a language, however many languages. Repeated rows count each; an empty table gives a model of no language."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count(n_buckets, orders), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "langid-counts")
    found = sorted((r.lang, r.n) for r in counts.where("bucket < 0").select("lang", "n").collect())  # a row a language
    return Model(tuple(x for x, _ in found), tuple(n for _, n in found), counts, n_buckets, orders, smoothing, block)


def totals(texts: list[str], block: Block, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each text under each language of the block, and the letters of each text."""
    n_buckets, n_langs = len(block.weights) - 1, len(block.languages)
    total, n_letters = np.tile(block.prior, (len(texts), 1)), np.zeros(len(texts), np.int64)
    for numbers, begins, buckets, found in buckets_of(texts, n_buckets, orders):
        np.add.at(n_letters, numbers, found)
        for low in range(0, n_langs, _WIDTH):
            part = block.weights[:, low : low + _WIDTH]
            for row in buckets:
                np.add.at(total[:, low : low + _WIDTH], numbers, np.add.reduceat(np.take(part, row, axis=0), begins, axis=0))
    return total, n_letters


def scored(texts: list[str], block: Block, orders: tuple[int, ...], state: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language (None: none), its log-probability, and the sum of all languages' probabilities in its measure, after this block.

    ``state`` is what earlier blocks gave. Of equally likely languages the earlier one stays. The last array has the letters.
    """
    n = len(texts)
    best, top, mass = state or (np.full(n, None, object), np.full(n, -np.inf), np.zeros(n))
    total, n_letters = totals(texts, block, orders)
    if block.languages:
        own = total.max(1)
        higher = np.maximum(top, own)
        mass = mass * np.exp(top - higher) + np.exp(total - higher[:, None]).sum(1)
        best = np.where(own > top, np.array(block.languages, object)[total.argmax(1)], best)
        top = higher
    return best, top, mass, n_letters


def _verdict(best: np.ndarray, mass: np.ndarray, n_letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    known = (n_letters > 0) & (mass > 0)
    return [b if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, 1.0 / np.maximum(mass, 1.0), 0.0)


_STATE = ("__lang_best", "__lang_top", "__lang_mass")


def _scan(docs: DataFrame, model: Model, text_col: str, finish, schema) -> DataFrame:
    """One scan for each block of languages; ``finish(batch, labels, scores)`` makes the result's batches in the last one."""
    spark, plain = docs.sparkSession, docs.columns
    at = plain.index(text_col)
    blocks = -(-len(model.languages) // model.block) or 1
    for number, block in enumerate(model.blocks()):
        shared, first, last = spark.sparkContext.broadcast(block), number == 0, number == blocks - 1

        def apply(batches: Iterator[pa.RecordBatch], shared=shared, first=first, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = []
                for begin, texts in slices(batch, at):
                    state = None
                    if not first:
                        held = batch.slice(begin, len(texts)).columns[-3:]
                        state = (np.array(held[0].to_pylist(), object), held[1].to_numpy(), held[2].to_numpy())
                    parts.append(scored(texts, shared.value, model_orders, state))
                best, top, mass, n_letters = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, object), *[np.zeros(0)] * 3)
                batch = batch.select(plain)
                if last:
                    yield finish(batch, *_verdict(best, mass, n_letters))
                else:
                    yield pa.record_batch([*batch.columns, pa.array(list(best), pa.string()), pa.array(top, pa.float64()), pa.array(mass, pa.float64())], [*plain, *_STATE])

        model_orders = model.orders
        if last:
            return docs.mapInArrow(apply, schema)
        between = StructType([*docs.select(*[F.col(f"`{c}`") for c in plain]).schema.fields, *StructType.fromDDL("__lang_best string, __lang_top double, __lang_mass double").fields])
        docs = written(docs.mapInArrow(apply, between), "langid-scored")
        shared.destroy()


def predict(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (posterior of the prediction) appended.

    A text that is null, empty or has no letter is ``und`` with score 0, as is every text under a model of no language. Very
    long texts are read whole, in pieces. Ties go to the language that sorts first. Repeated rows are predicted each. Only the
    text is read; columns of the two new names, in any case, are replaced. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double")

    def finish(batch: pa.RecordBatch, labels: list[str], score: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns, pa.array(labels, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return _scan(docs, model, text_col, finish, schema)


def held_out(doc_id: Column) -> Column:
    """Documents kept from fitting: a fifth by crc32 of the id as text, and those without an id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(True))


def keep_known(docs: DataFrame, model: Model, *, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or whose prediction scores under ``min_score``; columns unchanged."""

    def finish(batch: pa.RecordBatch, labels: list[str], score: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(np.array([x != UNKNOWN for x in labels], bool) & (score >= min_score)))

    return _scan(docs, model, text_col, finish, docs.schema)
