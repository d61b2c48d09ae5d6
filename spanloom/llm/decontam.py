"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words that ignores some positions, so two passages that differ in a word still
share seed hashes around it. Seeds of the benchmark form an index; seed hashes of the documents are joined to it, and the
words around each hit are compared on its diagonal (document position minus benchmark position): contaminated is a document
with ``window`` aligned words (a whole item, if it is shorter) of which ``percent`` per cent are equal. Words are runs of
letters and digits, lower-cased. Items of fewer words than the shortest seed spans are matched whole: by a document that
consists of exactly their words.

The masks find every such window: see the exhaustive test over all placements of substitutions. Items with equal words are
indexed once, under their smallest id, however many there are; :func:`item_classes` has the members.

A benchmark of at most ``block_chars`` characters (counted) is broadcast, and the join takes place inside one scan of the
documents. A larger one is never broadcast: seed rows of both sides, each with the words around it, are joined by Spark on
their hash. A bitmap of fixed size, built from the benchmark's seeds in chunks by tasks, keeps document seeds without a
partner out of that shuffle. Both ways return the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap
from .scratch import written
from .text import fold_alnum, mixed, run_hash, slices, word_hashes

#: Fixed masks for items of ``WINDOW`` words and more, and for shorter ones.
MASKS = ("11101011", "11010010011")
SHORT_MASKS = ("1111", "11011", "10111", "11101")
WINDOW, LEAST_WORDS, PERCENT = 13, 5, 80
_SLOTS = 1 << 22
#: Bits of the map of benchmark seeds in front of the shuffled join: 16 MB, at any size of the benchmark.
_MAP_BITS = 1 << 27


def _offsets(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def seeds(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of the words a mask selects, at every position where the mask fits."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(salt))
        for k, o in enumerate(_offsets(mask)):
            total += h[o : o + n] * np.uint64(((2 * k + 3) * 0x9E3779B97F4A7C15 | 1) & ((1 << 64) - 1))
        return mixed(total)


class Index:
    """Seeds of distinct word sequences: ``ids`` names them, ``words`` has their word hashes."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray], window: int, least: int):
        self.ids, self.words = ids, words
        hashes, items, places, self.masks = [], [], [], []
        for short, masks in ((False, MASKS), (True, SHORT_MASKS)):
            chosen = [i for i, w in enumerate(self.words) if len(w) >= least and (len(w) < window) == short]
            for m, mask in enumerate(masks if chosen else ()):
                salt = m + 100 * short
                self.masks.append((mask, salt))
                for i in chosen:
                    own = seeds(self.words[i], mask, salt)
                    hashes.append(own)
                    items.append(np.full(len(own), i))
                    places.append(np.arange(len(own)))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.items = np.concatenate(items)[order] if items else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int64)
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        #: Items too short for seeds, by the hash of all their words.
        self.whole = {_sequence(w): i for i, w in enumerate(self.words) if 0 < len(w) < least}

    def diagonals(self, h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) rows that a seed of both supports; ``owner`` is the text of each word."""
        found = []
        for mask, salt in self.masks:
            own = seeds(h, mask, salt)
            at = np.flatnonzero(self.slots[(own >> np.uint64(42)).astype(np.int64)])
            at = at[owner[at] == owner[at + len(mask) - 1]] if len(at) else at
            low, high = np.searchsorted(self.hashes, own[at], "left"), np.searchsorted(self.hashes, own[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            if len(at):
                entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                where = np.repeat(at, n)
                found.append(np.unique(np.stack((owner[where], self.items[entry], where - self.places[entry]), 1), axis=0))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _sequence(words: np.ndarray) -> int:
    return int(run_hash(words, np.zeros(1, np.int64), range(len(words)))[0])


def _best_window(equal: np.ndarray, size: int, percent: int) -> tuple[int, int] | None:
    """Most equal words of ``size`` aligned ones, and where the first such window begins; None under ``percent``."""
    sums = np.concatenate(([0], np.cumsum(equal)))
    counts = sums[size:] - sums[:-size]
    if not len(counts):
        return None
    first = int(counts.argmax())
    most = int(counts[first])
    return (most, first) if most * 100 >= size * percent else None


def _verified(index: Index, h: np.ndarray, starts: np.ndarray, window: int, percent: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For (text, item) the best window: equal words and size, and where it begins in the text and the item; earliest of equals."""
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}

    def offer(text: int, item: int, row: tuple[int, int, int, int]) -> None:
        old = best.get((text, item))
        if old is None or (-row[0], row[2], row[3]) < (-old[0], old[2], old[3]):
            best[text, item] = row

    for text, item, diagonal in index.diagonals(h, owner).tolist():
        words, begin, end = index.words[item], int(starts[text]), int(starts[text + 1])
        low, high = max(0, begin - diagonal), min(len(words), end - diagonal)
        size = min(window, len(words))
        if found := _best_window(words[low:high] == h[diagonal + low : diagonal + high], size, percent):
            offer(text, item, (found[0], size, diagonal + low + found[1] - begin, low + found[1]))
    if index.whole:
        longest = max(len(index.words[i]) for i in index.whole.values())
        for text in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) <= longest)).tolist():
            own = h[starts[text] : starts[text + 1]]
            item = index.whole.get(_sequence(own))
            if item is not None and len(index.words[item]) == len(own) and (index.words[item] == own).all():
                offer(text, item, (len(own), len(own), 0, 0))
    return best


MATCHES = "doc_id long, item_id long, n_equal int, n_words int, doc_word int, item_word int"
_COLUMNS = [c.split()[0] for c in MATCHES.split(", ")]


def _sequences(rows: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for begin, texts in slices(rows, column):
        yield begin, *word_hashes(texts, fold_alnum)


def item_classes(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, representative, n_words``: items with equal words are one class, named by its smallest id (null if none has one).

    Items without words are left out. A repeated row is listed each time.
    """
    return _members(benchmark, id_col, text_col).select("item_id", "representative", "n_words")


def _members(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, h, starts in _sequences(batch, 1):
                words = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(h.view(np.int64)))
                yield pa.record_batch([batch.column(0).slice(begin, len(starts) - 1), words], ["item_id", "words"])

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(read, "item_id long, words array<long>")
    items = items.where(F.size("words") > 0).withColumn("key", F.md5(F.to_json("words")))
    names = items.groupBy("key").agg(F.min("item_id").alias("representative"))
    return items.join(names, "key").select("item_id", "representative", F.size("words").alias("n_words"), "words", "key")


def _distinct(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, words`` of each distinct word sequence; one row a class, written once."""
    found = _members(benchmark, id_col, text_col).groupBy("key").agg(F.first("representative").alias("item_id"), F.first("words").alias("words"))
    return written(found.select("item_id", "words"), "decontam-items")


def _index(items: DataFrame, window: int, least: int) -> Index:
    rows = items.toArrow()
    return Index(rows.column("item_id").to_pylist(), [np.asarray(w.values, np.int64).view(np.uint64) for w in rows.column("words")], window, least)


_SEED = "id long, seed long, at int, n int, low int, words array<long>"


def _seed_rows(h: np.ndarray, starts: np.ndarray, rows: list[tuple[str, int]], bits: np.ndarray | None, window: int, texts=None) -> Iterator[tuple]:
    """(text, seed, position, words of the text, position of the first word given, words around) of each seed of each text.

    The words around are those of every window that holds the seed's first word.
    """
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for mask, salt in rows:
        own = seeds(h, mask, salt)
        at = np.arange(len(own))
        at = at[owner[at] == owner[at + len(mask) - 1]] if len(at) else at
        if texts is not None:
            at = at[texts[owner[at]]]
        if bits is not None and len(at):
            place = own[at] % np.uint64(_MAP_BITS)
            at = at[(bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        for p in at.tolist():
            t = int(owner[p])
            low, high = max(int(starts[t]), p - window + 1), min(int(starts[t + 1]), p + window)
            yield t, int(own[p : p + 1].view(np.int64)[0]), p - int(starts[t]), int(starts[t + 1] - starts[t]), low - int(starts[t]), h[low:high].view(np.int64)


def _masks(short: bool) -> list[tuple[str, int]]:
    return [(m, k + 100 * short) for k, m in enumerate(SHORT_MASKS if short else MASKS)]


def _whole_seed(words: np.ndarray) -> int:
    """A seed of its own kind for a short text as a whole."""
    return int(mixed(np.array([_sequence(words)], np.uint64) + np.uint64(0x77)).view(np.int64)[0])


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _SEED.split(", ")])


def _benchmark_seeds(items: DataFrame, window: int, least: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = np.asarray(words.values, np.int64).view(np.uint64)
                starts = np.array([0, len(h)])
                if len(h) < least:
                    rows.append((item, _whole_seed(h), 0, len(h), 0, h.view(np.int64)))
                else:
                    rows += [(item, *r[1:]) for r in _seed_rows(h, starts, _masks(len(h) < window), None, window)]
                if len(rows) > 50_000:
                    yield _emit(rows)
                    rows = []
            yield _emit(rows)

    return items.mapInArrow(read, _SEED)


def _document_seeds(rows: DataFrame, bits, window: int, least: int) -> DataFrame:
    """Seed rows of ``rows(key, text)`` that the map lets through; ``key`` is binary."""
    schema = _SEED.replace("id long", "key binary")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [*_masks(False), *_masks(True)]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for begin, h, starts in _sequences(batch, 1):
                out = list(_seed_rows(h, starts, every, bits.value, window))
                for t in np.flatnonzero((np.diff(starts) > 0) & (np.diff(starts) < least)).tolist():
                    own = h[starts[t] : starts[t + 1]]
                    out.append((t, _whole_seed(own), 0, len(own), 0, own.view(np.int64)))
                made = _emit(out)
                yield pa.record_batch([pa.array([keys[begin + r[0]] for r in out], pa.binary()), *made.columns[1:]], ["key", *made.schema.names[1:]])

    return rows.mapInArrow(read, schema)


def _compared(window: int, percent: int, least: int):
    """Verifies joined seed rows, each by itself: the words around both ends of a hit hold every window it can belong to."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, item, at, low, words, n, i_at, i_n, i_low, i_words in zip(*(batch.column(k).to_pylist() for k in range(10)), strict=True):
                size = min(window, i_n)
                if i_n < least:
                    if n == i_n and words == i_words:
                        out.append((key, item, i_n, i_n, 0, 0))
                    continue
                x, y = np.array(words, np.int64), np.array(i_words, np.int64)
                shift = (at - low) - (i_at - i_low)  # place in x of the first word of y
                first, last = max(0, -shift), min(len(y), len(x) - shift)
                if found := _best_window(x[first + shift : last + shift] == y[first:last], size, percent):
                    out.append((key, item, found[0], size, low + shift + first + found[1], i_low + first + found[1]))
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = (pa.binary(), pa.int64(), *[pa.int32()] * 4)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", *_COLUMNS[1:]])

    return compare


def _joined(rows: DataFrame, items: DataFrame, window: int, percent: int, least: int) -> DataFrame:
    """``key`` and the columns of a match for texts ``rows(key, text)``, by a shuffled join on seeds."""
    spark = rows.sparkSession
    own = written(_benchmark_seeds(items, window, least), "decontam-seeds")
    # Spark's pmod of the signed hash is the remainder of the unsigned one: the map's size divides 2^64.
    place = F.pmod(F.col("seed"), F.lit(_MAP_BITS))
    held = bitmap(own, place, _MAP_BITS)
    theirs = _document_seeds(rows, spark.sparkContext.broadcast(held), window, least)
    right = own.select(F.col("id").alias("item_id"), "seed", F.col("at").alias("i_at"), F.col("n").alias("i_n"), F.col("low").alias("i_low"), F.col("words").alias("i_words"))
    hits = theirs.join(right, "seed").select("key", "item_id", "at", "low", "words", "n", "i_at", "i_n", "i_low", "i_words")
    found = hits.mapInArrow(_compared(window, percent, least), "key binary, " + MATCHES.split(", ", 1)[1])
    order = F.struct((-F.col("n_equal")).alias("a"), F.col("doc_word").alias("b"), F.col("item_word").alias("c"))
    return found.groupBy("key", "item_id").agg(F.min_by(F.struct("n_equal", "n_words", "doc_word", "item_word"), order).alias("m")).select("key", "item_id", "m.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, percent: int = PERCENT, block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and distinct benchmark text that share a passage: ``doc_id, item_id, n_equal, n_words, doc_word, item_word``.

    The row describes the best window: the most equal words, of equal ones the earliest in the document, then in the item.
    ``item_id`` is the smallest id of the items with those words (:func:`item_classes` has the others). Items of one to four
    words match only documents of exactly these words. Null, empty and wordless texts never match, on either side; very
    long texts are searched whole, a million characters at a time. Rows that repeat an id are documents of their own, also without an id. Empty
    tables give no rows. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = _distinct(benchmark)
    if _size(items) > block_chars:
        texts = rows.where("text IS NOT NULL").withColumn("key", F.unhex(F.md5("text")))
        found = _joined(texts.select("key", "text").dropDuplicates(["key"]), items, window, percent, LEAST_WORDS)
        return texts.select("doc_id", "key").join(found, "key").select(*_COLUMNS)
    shared = docs.sparkSession.sparkContext.broadcast(_index(items, window, LEAST_WORDS))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, result = batch.column(0).to_pylist(), []
            for begin, h, starts in _sequences(batch, 1):
                result += [(ids[begin + t], shared.value.ids[i], *row) for (t, i), row in _verified(shared.value, h, starts, window, percent).items()]
            columns = zip(*result, strict=True) if result else [[]] * 6
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], _COLUMNS)

    return rows.mapInArrow(find, MATCHES)


def _size(items: DataFrame) -> int:
    """Words of the distinct items times six: about their characters."""
    return 6 * (items.agg(F.sum(F.size("words"))).first()[0] or 0)


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW, percent: int = PERCENT, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows whose text :func:`contaminated` would report; columns unchanged, nulls and repeats as they are.

    A row is judged by its text alone. With a broadcast index that takes no join; otherwise texts are told apart by digest.
    """
    items = _distinct(benchmark)
    if _size(items) > block_chars:
        key = F.unhex(F.md5(F.col(text_col)))
        texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
        bad = _joined(texts, items, window, percent, LEAST_WORDS).select(F.col("key").alias("__bad")).distinct()
        return docs.join(bad, key == F.col("__bad"), "left_anti")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(_index(items, window, LEAST_WORDS))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, bool)
            for begin, h, starts in _sequences(batch, at):
                for t, _ in _verified(shared.value, h, starts, window, percent):
                    good[begin + t] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
