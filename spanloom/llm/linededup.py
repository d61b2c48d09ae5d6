"""Line deduplication over levelled sorted runs of line hashes.

All lines are hashed in one scan and dealt once, by digest, into a table of sorted buckets: ``part, digest, docs``, how many
documents of each batch of arrivals hold the line. Every later step is a merge of tables with these buckets and needs no
further shuffle. A run is such a table of one batch. A new batch is merge-anti-joined with the digests already known as
frequent, which need no further counting, and what is left becomes a run of level 0. (With a threshold of two, known digests
would be all those of the runs, and this the plain anti-join of a batch with them; with ten a digest must be counted until then.) Whenever a level holds ``fanout`` runs
they are merged into one run of the next level, so a digest is rewritten once per level, and the digests found frequent
then are a run of their own for the anti-joins to come.

A line's key is the line without the six ASCII spaces at its ends, A-Z lower-cased; its digest is 128 bits (XXH3).
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitmap import bitmap
from .scratch import drop, new_folder, written

_SPACES = " \t\n\x0b\x0c\r"


def keys_of(lines: pa.Array) -> list[bytes]:
    return pc.cast(pc.ascii_lower(pc.ascii_trim(lines, characters=_SPACES)), pa.binary()).to_pylist()


def digests_of(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """A text's lines, and for each the digest of its key, None where the key is too short to count."""
    lines = (text or "").split("\n")
    keys = keys_of(pa.array(lines, pa.large_string()))
    return lines, [xxhash.xxh3_128_digest(k) if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars) else None for k in keys]


def _counts(min_chars: int, most: int = 200_000):
    """``part, digest, docs`` of ``part, text``: added up inside the task, at most ``most`` digests at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[int, bytes]] = Counter()

        def emit() -> pa.RecordBatch:
            made = pa.record_batch([pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary()), pa.array(list(found.values()), pa.int64())], ["part", "digest", "docs"])
            found.clear()
            return made

        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.update((part, d) for d in set(digests_of(text.as_py(), min_chars)[1]) if d is not None)
                if len(found) >= most:
                    yield emit()
        if found:
            yield emit()

    return count


class LineRuns:
    """Runs of line hashes by level, as bucketed tables whose files lie in the shared folder. :meth:`delete` removes them."""

    def __init__(self, spark: SparkSession, *, buckets: int | None = None, fanout: int = 4, min_docs: int = 10, min_chars: int = 1):
        self.spark, self.fanout, self.min_docs, self.min_chars = spark, fanout, min_docs, min_chars
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.known: list[str] = []
        self.tables: dict[str, str] = {}

    def _save(self, rows: DataFrame, *partitions: str) -> str:
        """A table of sorted buckets; ``rows`` must be dealt like its buckets already, or the write has a file for each task and bucket."""
        name, path = f"spanloom_lines_{uuid.uuid4().hex}", new_folder(self.spark, "lines")
        self.tables[name] = path
        writer = rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path)
        (writer.partitionBy(*partitions) if partitions else writer).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop(self.spark, self.tables.pop(name))

    def hashed(self, rows: DataFrame) -> str:
        """The line table of ``rows(part, text)``: the only scan of the texts and the only shuffle."""
        counted = rows.mapInArrow(_counts(self.min_chars), "part int, digest binary, docs long")
        dealt = counted.repartition(self.buckets, "digest").groupBy("part", "digest").agg(F.sum("docs").alias("docs"))
        return self._save(dealt.select("digest", "docs", "part"), "part")

    def without_known(self, batch: DataFrame) -> DataFrame:
        """``batch(digest, docs)`` without the digests known as frequent: a merge of sorted buckets for each run of them."""
        for name in self.known:
            batch = batch.hint("merge").join(self.spark.table(name).select("digest"), "digest", "left_anti")
        return batch

    def append(self, batch: DataFrame) -> None:
        """Adds a batch ``digest, docs`` with this object's buckets, then merges levels that are full."""
        self.runs.append((0, self._save(self.without_known(batch).select("digest", "docs"))))
        level = 0
        while len(full := [t for n, t in self.runs if n == level]) >= self.fanout:
            self.runs = [r for r in self.runs if r[1] not in full]
            self.runs.append((level + 1, merged := self._merged(full)))
            self.known.append(self._save(self.spark.table(merged).where(F.col("docs") >= self.min_docs).select("digest")))
            level += 1

    def _merged(self, names: list[str]) -> str:
        """One run of several, which go: two at a time by a merge join, whose sides need no exchange. (A union would not keep the buckets.)"""
        first, *rest = names
        for name in rest:
            both = self.spark.table(first).join(self.spark.table(name).select("digest", F.col("docs").alias("more")), "digest", "full_outer")
            merged = self._save(both.select("digest", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs")))
            self._drop(first)
            self._drop(name)
            first = merged
        return first

    def frequent(self) -> DataFrame:
        """Digests that at least ``min_docs`` documents hold, from all runs, which are merged into one of the highest level."""
        if not self.runs:
            return self.spark.createDataFrame([], "digest binary")
        if len(self.runs) > 1:
            top = max(n for n, _ in self.runs)
            self.runs = [(top, self._merged([t for _, t in sorted(self.runs)]))]
        return self.spark.table(self.runs[0][1]).where(F.col("docs") >= self.min_docs).select("digest")

    def delete(self) -> None:
        for name in list(self.tables):
            self._drop(name)
        self.runs, self.known = [], []


_CLEAN = "doc_id long, text string, n_lines long, n_dropped long"
_SLICE = 1 << 20


def _clean(min_chars: int, shared):
    """Drops lines: those in the broadcast set, or in the row's own list where there is one. Some million characters at a time."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2) if batch.num_columns > 2 else None
            begin, size, texts, totals, gone = 0, 0, [], [], []

            def emit(end: int) -> pa.RecordBatch:
                return pa.record_batch([batch.column(0).slice(begin, end - begin), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], [c.split()[0] for c in _CLEAN.split(", ")])

            for i, text in enumerate(batch.column(1)):
                lines, digests = digests_of(text.as_py(), min_chars)
                bad = shared.value if own is None else set(own[i].as_py() or ())
                kept = [x for x, d in zip(lines, digests, strict=True) if d is None or d not in bad]
                texts.append("\n".join(kept))
                totals.append(len(lines))
                gone.append(len(lines) - len(kept))
                size += len(texts[-1])
                if size >= _SLICE:
                    yield emit(i + 1)
                    begin, size, texts, totals, gone = i + 1, 0, [], [], []
            if texts:
                yield emit(batch.num_rows)

    return clean


#: Bits of the map in front of the shuffled join of lines and frequent digests: 16 MB, whatever their number, made in chunks by tasks.
_MAP_BITS = 1 << 27


def _hits(min_chars: int, held):
    """``key, digest`` of the lines of each text that the map lets through."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for d in set(digests_of(text.as_py(), min_chars)[1]) - {None}:
                    place = int.from_bytes(d[:4], "big") % _MAP_BITS
                    if held.value[place >> 3] >> (place & 7) & 1:
                        keys.append(key)
                        found.append(d)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["key", "digest"])

    return explode


def _map_of(frequent: DataFrame) -> np.ndarray:
    place = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(_MAP_BITS))
    return bitmap(frequent, place, _MAP_BITS)


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
                 batches: int = 3, fanout: int = 2, broadcast_limit: int = 500_000) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped``: every document without the lines that ``min_docs`` documents share.

    Documents arrive in ``batches`` parts (by hash of the id), each appended to a :class:`LineRuns`. The frequent digests
    are broadcast only when their count is at most ``broadcast_limit`` (16 bytes each); otherwise each text gets the
    list of its own frequent digests by joins. Both ways drop the same lines.

    A row is a document; repeated rows count as several, a line repeated inside one row counts once. Null and empty texts
    are one empty line, which has no key and stays. A null id is a value like any other. Texts are processed whole. Other
    columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    index = LineRuns(spark, fanout=fanout, min_docs=min_docs, min_chars=min_chars)
    part = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(batches)).cast("int")
    lines = index.hashed(rows.select(part.alias("part"), "text"))
    for k in range(batches):
        index.append(spark.table(lines).where(F.col("part") == k).select("digest", "docs"))
    frequent = written(index.frequent(), "frequent-lines")
    index.delete()
    if frequent.count() <= broadcast_limit:
        shared = spark.sparkContext.broadcast({bytes(d) for d in frequent.toArrow().column(0).to_pylist()})
        return rows.mapInArrow(_clean(min_chars, shared), _CLEAN)
    keyed = rows.withColumn("key", F.unhex(F.md5("text")))
    held = spark.sparkContext.broadcast(_map_of(frequent))
    hits = keyed.where("text IS NOT NULL").select("key", "text").mapInArrow(_hits(min_chars, held), "key binary, digest binary").join(frequent, "digest")
    lists = hits.groupBy("key").agg(F.collect_set("digest").alias("digests"))
    return keyed.join(lists, "key", "left").select("doc_id", "text", "digests").mapInArrow(_clean(min_chars, None), _CLEAN)


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the SHA-256 of the kept text in place of the text; for checks that compare results."""
    for batch in batches:
        sha = [hashlib.sha256((t.as_py() or "").encode()).hexdigest() for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
