"""SimHash near-duplicates with vantage-point trees over fingerprints.

A fingerprint has a bit for each bit of the shingles' XXH64 that is set in over half of them. Equal fingerprints are one row
from the start. Two fingerprints that differ in at most ``radius`` bits differ in at most ``radius // trees`` bits of one of
``trees`` equal parts, so each part has a tree of its own with that smaller bound; one tree over all bits is ``trees=1``.

A node of a tree has a vantage point and a radius: fingerprints within it go inside, others outside. Distances to a point
change by no more than the distance of two fingerprints (triangle inequality), so a fingerprint need only visit the side it
is not on if it lies near the boundary. A node measures the part's bits with the part's bound, or all bits with the whole
bound, whichever prunes more for its copies on the sample from which the tree is grown. Leaves are shards: every fingerprint
is at home in one, and seeks partners there and in the shards of smaller number that its boundaries reach. A shard is settled
inside one task, by the same splits, and returns at most one link a fingerprint, never pairs. A ball of close fingerprints
is linked through its centre and not compared with itself.

The trees are grown on the driver from a sample of at most ``sample`` fingerprints; they never drop a pair, whatever the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import with_hint
from ..operators.graph import components
from .scratch import dropped, written

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are split into words at once, and shingles whose bits are counted at once.
_PIECE, _CHUNK = 1 << 22, 1 << 15
ALL = (1 << 64) - 1


def _hashes(own: list[bytes], words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, joined by spaces."""
    line = b" ".join(own)
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(sizes + 1) - 1
    begins = (ends - sizes)[: len(own) - words + 1].tolist()
    spans = map(slice, begins, ends[words - 1 :].tolist())
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), map(line.__getitem__, spans)), np.uint64, len(begins))


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, repeats included, in pieces; of fewer words than a shingle, of all as one; none without words."""
    data, at, carry, seen = (text or "").encode("utf-8", "surrogatepass").lower(), 0, [], False
    while at < len(data):
        end = at + _PIECE
        if end < len(data):
            space = _SPACE.search(data, end)
            end = space.start() if space else len(data)
        own = carry + data[at:end].split()
        at, carry = end, own
        if len(own) >= words:
            yield _hashes(own, words)
            carry, seen = own[len(own) - words + 1 :], True
    if carry and not seen:
        yield _hashes(carry, len(carry))


def fingerprint(text: str | None, words: int = 3) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for k in range(0, len(hashes), _CHUNK):
            bits = np.unpackbits(hashes[k : k + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _sign(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.fromiter((fingerprint(x.as_py(), words) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    return sign


def distances(codes: np.ndarray, point: np.uint64, mask: np.uint64 = np.uint64(ALL)) -> np.ndarray:
    return np.bitwise_count((codes ^ point) & mask)


def _best_split(codes: np.ndarray, tests: list[tuple[int, int]], points: int = 8) -> tuple[int, int, int, int] | None:
    """``(vantage, mask, bound, radius)`` that leaves least work for its copies on ``codes``; None where nothing is pruned.

    Of the pairs of one home and one visitor, a split leaves a share (work) and makes ``copies`` rows of a visitor.
    """
    best, chosen = 0.0, None
    for v in codes[:: max(1, len(codes) // points)][:points]:
        for mask, bound in tests:
            share = np.cumsum(np.bincount(distances(codes, v, np.uint64(mask)), minlength=65)) / len(codes)
            for r in np.flatnonzero((share >= 0.2) & (share <= 0.8)).tolist():
                inside, outside = share[min(64, r + bound)], 1 - (share[r - bound] if r >= bound else 0)
                work, copies = share[r] * inside + (1 - share[r]) * outside, max(inside + outside, 1.001)
                if work < 0.9 and -log(work) / log(copies) > best:
                    best, chosen = -log(work) / log(copies), (int(v), mask, bound, r)
    return chosen


class Tree:
    """A vantage-point tree: for each node its test and two children, of which a negative one is the leaf ``~child``."""

    def __init__(self, sample: np.ndarray, tests: list[tuple[int, int]], depth: int, least: int = 16):
        self.nodes: list[list[int]] = []
        self.leaves = 0
        self.tests, self.least = tests, least
        self.root = self._grown(sample, depth)

    def _grown(self, codes: np.ndarray, depth: int) -> int:
        split = _best_split(codes, self.tests) if depth and len(codes) >= 2 * self.least else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        v, mask, bound, r = split
        at = len(self.nodes)
        self.nodes.append([v, mask, bound, r, 0, 0])
        inside = distances(codes, np.uint64(v), np.uint64(mask)) <= r
        self.nodes[at][4:] = self._grown(codes[inside], depth - 1), self._grown(codes[~inside], depth - 1)
        return at

    def homes(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.int64)
        work = [(self.root, np.arange(len(codes)))]
        while work:
            node, own = work.pop()
            if node < 0:
                out[own] = ~node
                continue
            v, mask, _, r, inner, outer = self.nodes[node]
            inside = distances(codes[own], np.uint64(v), np.uint64(mask)) <= r
            work += [(inner, own[inside]), (outer, own[~inside])]
        return out

    def visits(self, codes: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which code must seek in which leaf below its own: every pair in reach is met, from its higher-numbered home."""
        who, where = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        work = [(self.root, np.arange(len(codes)))]
        while work:
            node, own = work.pop()
            if node < 0:
                own = own[homes[own] > ~node]
                who.append(own)
                where.append(np.full(len(own), ~node))
                continue
            v, mask, bound, r, inner, outer = self.nodes[node]
            d = distances(codes[own], np.uint64(v), np.uint64(mask)).astype(np.int64)
            work += [(inner, own[d <= r + bound]), (outer, own[d > r - bound])]
        return np.concatenate(who), np.concatenate(where)


class _Classes:
    """Union-find over numbers, many unions at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (q := self.parent[r]).tolist() != r.tolist():
            r = q
        self.parent[x] = r
        return r

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            low, high = np.minimum(a, b), np.maximum(a, b)
            apart = low != high
            a, b = low[apart], high[apart]
            self.parent[b] = a  # of several parents one wins; the next pass joins the others


#: Pairs compared at once.
_CELLS = 1 << 22


def _compare(codes: np.ndarray, homes: np.ndarray, seekers: np.ndarray, radius: int, classes: _Classes) -> None:
    step = max(1, _CELLS // max(1, len(homes)))
    for k in range(0, len(seekers), step):
        own = seekers[k : k + step]
        i, j = np.nonzero(np.bitwise_count(codes[own][:, None] ^ codes[homes][None, :]) <= radius)
        classes.unite(own[i], homes[j])


def settle(codes: np.ndarray, homes: np.ndarray, seekers: np.ndarray, radius: int, tests: list[tuple[int, int]], classes: _Classes, depth: int = 0) -> None:
    """Joins each seeker's class with those of all homes within ``radius``; both are places in ``codes``."""
    if not len(homes) or not len(seekers):
        return
    if len(homes) * len(seekers) <= _CELLS // 4 or depth > 60:
        _compare(codes, homes, seekers, radius, classes)
        return
    near = [(p, distances(codes[homes], codes[p])) for p in homes[:: max(1, len(homes) // 8)][:8]]
    p, d = max(near, key=lambda x: int((x[1] <= radius).sum()))
    ball = d <= radius
    if ball.sum() * 16 >= len(homes):  # all of the ball is one class: only what lies outside can link to its members
        e = distances(codes[seekers], codes[p])
        classes.unite(homes[ball], np.full(int(ball.sum()), p))
        classes.unite(seekers[e <= radius], np.full(int((e <= radius).sum()), p))
        settle(codes, homes[ball & (d > 0)], seekers[(e > radius) & (e <= 2 * radius)], radius, tests, classes, depth + 1)
        settle(codes, homes[~ball], seekers, radius, tests, classes, depth + 1)
        return
    split = _best_split(codes[homes[:: max(1, len(homes) // 2048)]], tests)
    if split is None:
        _compare(codes, homes, seekers, radius, classes)
        return
    v, mask, bound, r = split
    d, e = (distances(codes[x], np.uint64(v), np.uint64(mask)).astype(np.int64) for x in (homes, seekers))
    settle(codes, homes[d <= r], seekers[e <= r + bound], radius, tests, classes, depth + 1)
    settle(codes, homes[d > r], seekers[e > r - bound], radius, tests, classes, depth + 1)


def _parts(trees: int, radius: int) -> list[tuple[int, int]]:
    """Mask and bound of each tree's part of the bits."""
    cuts = [64 * k // trees for k in range(trees + 1)]
    return [((1 << high) - (1 << low), radius // trees) for low, high in zip(cuts[:-1], cuts[1:], strict=True)]


def _tests(part: tuple[int, int], radius: int) -> list[tuple[int, int]]:
    return [part] if part == (ALL, radius) else [part, (ALL, radius)]


_PLACED = "tree int, shard long, code long, home boolean"


def _placed(forest):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t, tree in enumerate(forest.value):
                homes = tree.homes(codes)
                who, where = tree.visits(codes, homes)
                n, both = len(codes), np.concatenate((codes, codes[who])).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(both), t, np.int32)), pa.array(np.concatenate((homes, where))), pa.array(both), pa.array(np.arange(len(both)) < n)], ["tree", "shard", "code", "home"])

    return place


def _settled(forest, radius: int):
    def settled(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy().astype(np.int64).view(np.uint64)
        own = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        classes, everyone = _Classes(len(codes)), np.arange(len(codes))
        settle(codes, everyone[own], everyone, radius, forest.value[table.column("tree")[0].as_py()].tests, classes)
        root = classes.roots(everyone)
        other = root != everyone
        return pa.table([pa.array(codes[root[other]].view(np.int64)), pa.array(codes[other].view(np.int64))], ["a", "b"])

    return settled


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, code`` (the 64 bits as a long) of every row; nulls, empty and wordless texts have code 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_sign(words), "doc_id long, code long")


def links(codes: DataFrame, *, radius: int = 3, trees: int = 2, shard_size: int = 2_048, sample: int = 10_000) -> DataFrame:
    """Links ``a, b`` that connect what is connected among the distinct ``codes(code)``: no two codes within ``radius`` bits stay apart."""
    spark = codes.sparkSession
    n = codes.count()
    drawn = codes.select("code").orderBy(F.xxhash64("code"), "code").limit(sample).toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
    depth = ceil(log2(max(1, n / shard_size)))
    forest = spark.sparkContext.broadcast([Tree(drawn, _tests(part, radius), depth) for part in _parts(trees, radius)])
    placed = codes.select("code").mapInArrow(_placed(forest), _PLACED)
    return written(placed.groupBy("tree", "shard").applyInArrow(_settled(forest, radius), "a long, b long"), "simhash-links")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, trees: int = 2,
                    shard_size: int = 2_048, sample: int = 10_000) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id reachable over
    links, itself included (null if no row of the component has an id). Null, empty and wordless texts have the
    fingerprint zero and are linked like any other. Very long texts are read whole, in pieces. Rows are judged one by one
    by their text, also where they repeat all or part of each other. Other columns are not read. An empty table gives no rows.
    """
    signed = written(fingerprints(docs, id_col=id_col, text_col=text_col, words=words), "simhash")
    codes = written(signed.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-codes")
    joined = components(links(codes, radius=radius, trees=trees, shard_size=shard_size, sample=sample), "a", "b")
    grouped = written(codes.join(joined.withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code")), "simhash-grouped")
    several = grouped.groupBy("component").agg(F.min("least").alias("component_id"), F.sum("n").alias("total")).where("total > 1")
    named = written(grouped.join(several, "component").select("code", "component_id", "n"), "simhash-named")
    # Codes of many rows are few and broadcast; rows whose code is surely alone are not joined at all.
    most = signed.count() // 10_000 + 1
    hot = named.where(F.col("n") > most).select(F.col("code").alias("__hot"), F.col("component_id").alias("__id"))
    seen = signed.join(F.broadcast(hot), F.col("code") == F.col("__hot"), "left")
    rest = with_hint(seen.where("__hot IS NULL").select("doc_id", "code"), "code", named, "code")
    met = rest.where("__maybe").select("doc_id", "code").join(named.where(F.col("n") <= most).select("code", F.col("component_id").alias("__id"), F.lit(True).alias("__met")), "code", "left")
    own = met.select("doc_id", "code", F.when(F.col("__met"), F.col("__id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = own.unionByName(rest.where("NOT __maybe").select("doc_id", "code", F.col("doc_id").alias("component_id")))
    out = out.unionByName(seen.where("__hot IS NOT NULL").select("doc_id", "code", F.col("__id").alias("component_id")))
    for table in (codes, grouped):
        dropped(table)
    return out.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
