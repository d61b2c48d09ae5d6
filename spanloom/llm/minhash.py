"""Near-duplicate detection with circulant MinHash signatures, banding and exact verification.

Two permutations make all signature coordinates: the first scatters a document's shingles over 32 bits, the second is
applied after a circular shift by the coordinate's number, and the smallest value counts (C-MinHash). Rows whose shingle
sets are equal are one class, whatever their ids; only class representatives are banded and compared.

Representatives that share a band are candidates, and candidates of candidates are a family. Every family is settled on
its full shingle sets: an inverted index counts what one member shares with all others at once, first for the most
central member, then for each one that is not yet in its component, so a large group of near copies costs about one count
per outlier and no pair is ever a row. A family beyond a block's size is dealt into blocks, every pair of which is one
task of bounded memory that returns at most one link per member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.filters import possibly_in, with_hint
from .scratch import dropped, written
from .text import fold_alnum, fold_spaced, mixed, run_hash, slices, windows, word_hashes

FOLDS = {"spaced": fold_spaced, "alnum": fold_alnum}


def _second(x: np.ndarray) -> None:
    """The second permutation, in place: a bijection of 32-bit values (the finaliser of MurmurHash3)."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)


def signatures(shingles: np.ndarray, starts: np.ndarray, n_coordinates: int) -> np.ndarray:
    """Circulant MinHash of each text's shingles (64-bit hashes, at least one a text): one row a text."""
    first = mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)).astype(np.uint32)  # first permutation, cut to the circle of 2^32
    out = np.full((len(starts) - 1, n_coordinates), np.uint32(0xFFFFFFFF))
    begins = starts[:-1]
    block = 1 << 15
    for at in range(0, len(first), block):  # blocks stay in the processor's cache through all coordinates
        part = first[at : at + block]
        texts = np.arange(np.searchsorted(begins, at, "right") - 1, np.searchsorted(begins, at + len(part), "left"))
        cuts = np.maximum(begins[texts] - at, 0)
        for k in range(n_coordinates):
            x = part + np.uint32(k)
            _second(x)
            out[texts, k] = np.minimum(out[texts, k], np.minimum.reduceat(x, cuts))
    return out


def shingle_sets(texts: list[str], words: int, fold_codes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin. Fewer words than a shingle: all as one."""
    h, starts = word_hashes(texts, fold_codes)
    all_runs, run_starts = windows(h, starts, words)
    sets = []
    for i in range(len(texts)):
        n = starts[i + 1] - starts[i]
        if n >= words:
            sets.append(np.unique(all_runs[run_starts[i] : run_starts[i + 1]]))
        else:
            sets.append(run_hash(h, starts[i : i + 1], range(n)) if n else np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.cumsum([0] + [len(s) for s in sets])


_SIGNED = "doc_id long, text_key binary, n_shingles long, set_key binary, bands array<long>"


def _sign(words: int, folding: str, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch, 1):
                shingles, starts = shingle_sets(texts, words, FOLDS[folding])
                counts = np.diff(starts)
                full = np.flatnonzero(counts)
                own = signatures(shingles, np.append(starts[full], starts[-1]), bands * rows) if len(full) else np.zeros((0, bands * rows), np.uint32)
                banded = np.zeros((len(full), bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        banded = mixed(banded * np.uint64(0x9E3779B97F4A7C15) + own[:, r::rows].astype(np.uint64))
                    banded = mixed(banded + np.arange(bands, dtype=np.uint64)).view(np.int64)
                keys: list[bytes | None] = [None] * len(texts)
                for i in full:
                    keys[i] = hashlib.blake2b(shingles[starts[i] : starts[i + 1]].tobytes(), digest_size=16).digest()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum((counts > 0) * bands))), pa.int32()), pa.array(banded.ravel()))
                own_columns = [batch.column(k).slice(begin, len(texts)) for k in (0, 2)]
                yield pa.record_batch([*own_columns, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), lists], ["doc_id", "text_key", "n_shingles", "set_key", "bands"])

    return sign


def _sets(words: int, folding: str):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in slices(batch, 1):
                shingles, starts = shingle_sets(texts, words, FOLDS[folding])
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.record_batch([*(batch.column(k).slice(begin, len(texts)) for k in (0, 2, 3)), lists], ["doc_id", "text_key", "h", "shingles"])

    return sets


class _Forest:
    """Union-find whose roots are the smallest numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)


def linked(shingles: np.ndarray, starts: np.ndarray, percent: int) -> np.ndarray:
    """Smallest row reachable from each row over links between the sets of distinct shingles given end to end.

    A row's overlaps with all others come from one count over the inverted index. Rows of the pivot's component need no
    count of their own: any link that leaves it is counted from its other end.
    """
    n, sizes = len(starts) - 1, np.diff(starts)
    _, token, frequency = np.unique(shingles, return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")]
    begins = np.concatenate(([0], np.cumsum(frequency)))
    forest = _Forest(n)
    common = np.add.reduceat(frequency[token], starts[:-1]) / sizes
    pivot = int(np.argmax(common))
    for x in [pivot, *(i for i in range(n) if i != pivot)]:
        if x != pivot and forest.root(x) == forest.root(pivot):
            continue
        own = token[starts[x] : starts[x + 1]]
        counts = frequency[own]
        if counts.max() < 2:
            continue
        total = int(counts.sum())
        at = np.repeat(begins[own] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
        shared = np.bincount(owners[at], minlength=n)
        for y in np.flatnonzero(shared * 100 >= (sizes[x] + sizes - shared) * percent):
            forest.join(x, int(y))
    return np.array([forest.root(i) for i in range(n)])


def _settle(percent: int):
    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("id", "ascending")])
        ids, families = table.column("id").to_numpy(), table.column("family").to_numpy()
        lists = table.column("shingles").combine_chunks()
        values, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        cuts = np.flatnonzero(np.concatenate(([True], families[1:] != families[:-1], [True])))
        ends = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            starts = offsets[low : high + 1]
            ends.append(ids[low + linked(values[starts[0] : starts[-1]], starts - starts[0], percent)] if high - low > 1 else ids[low:high])
        other = np.concatenate(ends)
        real = other != ids
        return pa.table([pa.array(ids[real]), pa.array(other[real])], ["a", "b"])

    return settle


#: Families of several blocks that are broadcast.
_MOST_BROADCAST = 100_000
#: Shingles of a task, and what a block may hold at most when a family would otherwise have more than ``_MANY`` blocks.
_TASK_SHINGLES, _MOST_SHINGLES, _MANY = 100_000, 4_000_000, 64


def _links(rows: DataFrame, percent: int, block_shingles: int) -> DataFrame:
    """Links ``a, b`` that connect what is connected: ``rows(id, family, shingles)`` settled by family.

    A family's rows are sent to as many tasks as it has blocks, so blocks grow with the family, up to a task's memory.
    """
    rows = rows.withColumn("n", F.size("shingles"))
    sizes = rows.groupBy("family").agg(F.sum("n").alias("total"))
    blocks = F.greatest(F.least(F.ceil(F.col("total") / block_shingles), F.lit(_MANY)), F.ceil(F.col("total") / _MOST_SHINGLES)).cast("int")
    sizes = sizes.withColumn("blocks", blocks)
    bins = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // block_shingles))
    # Families of one block share bins, those of several get every pair of their blocks. Up to a counted number the latter are
    # broadcast; more of them are joined like any table.
    several = written(sizes.where("blocks > 1").select(F.col("family").alias("__large"), "blocks"), "minhash-large")
    several = F.broadcast(several) if several.count() <= _MOST_BROADCAST else several
    dealt = rows.join(several, F.col("family") == F.col("__large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    one = F.struct(F.pmod(F.xxhash64("family"), F.lit(bins)).alias("key"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("family").alias("key"), F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    pair = F.filter(pair, lambda p: p["i"] < p["j"])
    task = F.explode(F.when(F.col("blocks") == 1, F.array(one)).otherwise(pair)).alias("task")
    placed = dealt.select("id", "family", "shingles", task).select("id", "family", "shingles", "task.key", "task.i", "task.j")
    return placed.groupBy("key", "i", "j").applyInArrow(_settle(percent), "a long, b long")


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _verdicts(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, folding: str, bands: int, rows: int, block_shingles: int) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, text_key, row, n_shingles, set_key`` and of its component ``component_id`` and ``best``.

    ``best`` (no id?, id, text, row) is the least row of the component; both are null for a row without shingles.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _text_key(F.col(text_col)).alias("text_key"))
    signed = written(source.mapInArrow(_sign(words, folding, bands, rows), _SIGNED).withColumn("row", F.monotonically_increasing_id()), "minhash")
    best = F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "text_key", "row")
    classes = signed.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("c"), F.min(best).alias("best"), F.first("bands").alias("bands"))
    classes = written(classes, "minhash-classes")
    banded = written(classes.select(F.col("c").alias("id"), F.explode("bands").alias("value")), "minhash-bands")
    shared = banded.groupBy("value").agg(F.count("*").alias("n"), F.min("id").alias("pivot"), F.max("id").alias("last")).where("n > 1 AND pivot < last")
    shared = written(shared, "minhash-shared")
    star = possibly_in(banded, "value", shared, "value").join(shared, "value").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    families = components(star, "a", "b").withColumnRenamed("node", "id").withColumnRenamed("component", "family")
    # One row of each class in a family has its shingles made again; the other texts need none.
    hashed = F.xxhash64("doc_id", "text_key")
    members = families.join(classes.select(F.col("c").alias("id"), "best.doc_id", "best.text_key"), "id").withColumn("h", hashed)
    members = written(members, "minhash-families")
    wanted = possibly_in(source.withColumn("h", hashed), "h", members, "h")
    sets = wanted.mapInArrow(_sets(words, folding), "doc_id long, text_key binary, h long, shingles array<long>")
    named = members.select("id", "family", F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("h").alias("g"))
    found = sets.join(named, (F.col("h") == F.col("g")) & (F.col("text_key") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")))
    found = found.groupBy("h", "text_key", "id").agg(F.first("family").alias("family"), F.first("shingles").alias("shingles"))  # rows that repeat all they have
    found = written(found.select("id", "family", "shingles"), "minhash-sets")
    final = components(_links(found, percent, block_shingles), "a", "b").withColumnRenamed("node", "c")
    joined = written(final.join(classes.select("c", "best"), "c"), "minhash-joined")
    roots = joined.groupBy("component").agg(F.min("best").alias("root"))
    rooted = joined.join(roots, "component").select("c", "root")
    judged = written(classes.select("set_key", "c", "best").join(rooted, "c", "left").select("set_key", F.coalesce("root", "best").alias("best")), "minhash-judged")
    for table in (classes, banded, shared, members, found, joined):
        dropped(table)
    out = signed.select("doc_id", "text_key", "row", "n_shingles", "set_key").join(judged, "set_key", "left")
    return out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, folding: str = "alnum",
                    bands: int = 32, rows: int = 5, block_shingles: int = _TASK_SHINGLES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Two rows are linked when the distinct ``words``-word shingles they share are at least ``percent`` per cent of those
    either has; components are over all links, named by their smallest id, and ``kept`` is that document. With 32
    bands of 5 coordinates a pair at exactly 0.8 stays a candidate with probability 1 - 3e-6, and more above.

    Null, empty and wordless texts have no shingles, stand alone and are kept. Very long texts are taken whole. Every row
    is compared by its own text: rows that repeat an id with different texts are linked each by its text, and rows
    without an id like any other. A component without any id has a null ``component_id`` and one row that is kept. Ids are
    64-bit integers. Other columns are not read, whatever their names. Empty tables give no rows.
    """
    found = _verdicts(docs, id_col, text_col, words, percent, folding, bands, rows, block_shingles)
    own = F.when(F.col("component_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id"))).otherwise(F.col("row") == F.col("best.row"))
    return found.select("doc_id", "n_shingles", "component_id", F.when(F.col("set_key").isNull(), True).otherwise(own).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, folding: str = "alnum",
                 bands: int = 32, rows: int = 5, block_shingles: int = _TASK_SHINGLES) -> DataFrame:
    """``docs`` with one row of each component of :func:`near_duplicates`; columns unchanged.

    The row that stays has the smallest id (rows without one come last), of several with that id the least digest of the
    text, and of rows equal in both any one. Rows without shingles all stay. Only texts that may have to go are shuffled.
    """
    found = _verdicts(docs, id_col, text_col, words, percent, folding, bands, rows, block_shingles).where("set_key IS NOT NULL")
    first = F.col("text_key").eqNullSafe(F.col("best.text_key")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    rows_ = found.groupBy("doc_id", "text_key").agg(F.bool_and(first).alias("stays"), F.count("*").alias("n"))
    rows_ = written(rows_.select(F.xxhash64("doc_id", "text_key").alias("__key"), F.col("doc_id").alias("__d"), F.col("text_key").alias("__t"), "stays", "n"), "minhash-verdicts")
    key = [F.col(id_col).cast("long").alias("__id"), _text_key(F.col(text_col)).alias("__text")]
    marked = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key).withColumn("__h", F.xxhash64("__id", "__text"))
    same = (F.col("__h") == F.col("__key")) & (F.col("__text") == F.col("__t")) & F.col("__id").eqNullSafe(F.col("__d"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    gone = rows_.where("NOT stays").select("__key", "__d", "__t")
    hinted = with_hint(marked, "__h", gone, "__key")
    out = hinted.where("NOT __maybe").drop("__maybe").unionByName(hinted.where("__maybe").drop("__maybe").join(gone, same, "left_anti"))
    twice = rows_.where("stays AND n > 1").select("__key", "__d", "__t")
    if twice.isEmpty():
        return out.select(*names)
    hinted = with_hint(out, "__h", twice, "__key")
    doubtful = hinted.where("__maybe").drop("__maybe")
    once = doubtful.join(twice, same, "left_semi").dropDuplicates(["__id", "__text"])
    return hinted.where("NOT __maybe").drop("__maybe").unionByName(doubtful.join(twice, same, "left_anti")).unionByName(once).select(*names)
