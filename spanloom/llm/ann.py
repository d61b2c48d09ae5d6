"""Approximate nearest neighbours by cosine with multi-index hashing.

A learned rotation (ITQ on a bounded sample) turns vectors into binary codes; a code is split into substrings of eight
bits, each with an index from value to rows. If two codes differ in at most r bits, some substring differs in at most its
share of r, so probing the near values of every substring finds every code within radius r; the candidates are then
ranked by the exact cosine of the float vectors.

The index rows stay where the scan puts them: a task builds the index of some rows once and searches it for a chunk of the
stated query set, which is broadcast. Chunks have a bound in bytes and follow each other, so neither side is copied between
tasks; what is shuffled is at most k rows a query and task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

_BYTE = 8


@dataclass(frozen=True)
class Coder:
    """``rotation`` has a column per bit; ``radius`` is the Hamming radius that holds nearly all true neighbours of the sample."""

    rotation: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors @ self.rotation > 0).astype(np.uint64)
        return (signs << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def learned(sample: np.ndarray, *, k: int = 5, rounds: int = 25, trials: int = 400, coverage: float = 0.985, seed: int = 5) -> Coder:
    """Rotation by iterative quantisation, and the radius that covers ``coverage`` of the sample's k nearest neighbours.

    Neighbours in all the data are nearer than those in a sample of it, so the radius errs on the large side.
    """
    x = unit(sample)
    bits = min(64, x.shape[1])
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    projected = np.zeros((len(x), bits))
    projected[:, : min(bits, len(axes))] = x @ axes[:bits].T
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ rotation > 0, 1.0, -1.0).T @ projected)
        rotation = (u @ vt).T
    basis = np.zeros((x.shape[1], bits))
    basis[:, : min(bits, len(axes))] = axes[:bits].T
    coder = Coder(basis @ rotation, bits)
    if len(x) <= k + 1:
        return coder
    codes, picked = coder.codes(x), np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)
    near = x[picked] @ x.T
    near[np.arange(len(picked)), picked] = -2
    top = np.argpartition(-near, k, axis=1)[:, :k]
    distances = np.bitwise_count(codes[top] ^ codes[picked][:, None])
    return Coder(coder.rotation, int(np.quantile(distances, coverage, method="higher")))


@lru_cache(maxsize=None)
def _near(width: int, reach: int) -> np.ndarray:
    """Differences of at most ``reach`` bits in a substring of ``width``."""
    values = np.arange(1 << width, dtype=np.uint64)
    return values[np.bitwise_count(values) <= reach].astype(np.int64)


class MultiIndex:
    """Substring indexes over an array of codes."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.tables = codes, []
        for low in range(0, bits, _BYTE):
            width = min(_BYTE, bits - low)
            values = self.substring(codes, low, width)
            order = np.argsort(values, kind="stable")
            self.tables.append((low, width, order, np.searchsorted(values[order], np.arange((1 << width) + 1))))

    @staticmethod
    def substring(codes, low: int, width: int):
        return ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        reach, extra = divmod(radius, len(self.tables))
        found = np.zeros(len(self.codes), bool)
        for j, (low, width, order, starts) in enumerate(self.tables):
            # If the first extra + 1 substrings all differ in more than reach bits and the rest in at least reach, the sum is over the radius.
            own = reach if j <= extra else reach - 1
            if own < 0:
                continue
            values = _near(width, min(own, width)) ^ int(self.substring(code, low, width))
            begin, n = starts[values], starts[values + 1] - starts[values]
            total = int(n.sum())
            found[order[np.repeat(begin - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(total)]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


FOUND = "query_id long, vec_id long, score double"
_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def best_of(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the k largest cosines, ties to the smaller id, and those cosines.

    A product of matrix and vector is fast but may give equal rows scores that differ in the last bits by their place, so it
    only finds who can be among the k; each finalist's score is then the sum over its own row, which depends on nothing else.
    """
    rough = (x @ q) / (norms * norm)
    finalists = np.arange(len(x))
    if len(x) > k:
        finalists = np.flatnonzero(rough >= np.partition(rough, len(x) - k)[len(x) - k] - 1e-9)
    score = (x[finalists] * q).sum(axis=1) / (norms[finalists] * norm)
    order = np.lexsort((ids[finalists], -score))[:k]
    return finalists[order], score[order]


def _search(k: int, block: int, coders, asked):
    """Index of up to ``block`` rows at a time, each built once and searched for all queries of the chunk."""

    def one(d: int, ids: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        query_ids, queries = asked.value[d]
        coder = coders.value.get(d)
        norms, query_norms = _norms(x), _norms(queries)
        tables, codes = (MultiIndex(coder.codes(x), coder.bits), coder.codes(queries)) if coder else (None, None)
        out = []
        for i, q in enumerate(queries):
            other = ids != query_ids[i]
            if tables is None:  # a length so rare that nothing was learned for it: all its rows are ranked
                rows = np.flatnonzero(other)
            else:
                radius = coder.radius
                rows = tables.within(codes[i], radius)
                rows = rows[other[rows]]
                while len(rows) < k and radius < coder.bits:  # too few: look further, up to all
                    radius = min(coder.bits, radius + 4)
                    rows = tables.within(codes[i], radius)
                    rows = rows[other[rows]]
            if len(rows):
                best, score = best_of(x[rows], norms[rows], ids[rows], q, query_norms[i], k)
                out.append((np.full(len(best), query_ids[i]), ids[rows][best], score))
        if out:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], _NAMES)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows: dict[int, int] = {}
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                if d not in asked.value:
                    continue
                part = batch.filter(pa.array(lengths == d))
                for at in range(0, part.num_rows, block):
                    piece = part.slice(at, block)
                    held.setdefault(d, []).append((piece.column(0).to_numpy(), _matrix(piece.column(1), d)))
                    rows[d] = rows.get(d, 0) + piece.num_rows
                    if rows[d] >= block:
                        yield from one(d, *(np.concatenate(c) for c in zip(*held.pop(d), strict=True)))
                        rows[d] = 0
        for d, parts in held.items():
            yield from one(d, *(np.concatenate(c) for c in zip(*parts, strict=True)))

    return search


def _valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample: int = 20_000, least_sample: int = 200, block: int = 65_536, chunk_bytes: int = 32 << 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``queries`` its k nearest found rows of ``vectors``, itself left out.

    The measure is the cosine in double precision, summed row by row, so equal vectors have equal scores wherever they lie;
    ties go to the smaller id. Rotation and radius are fitted to at most ``sample`` vectors of each vector
    length, by hash order of the id; lengths of which the table has fewer than ``least_sample`` rows are ranked without an
    index. Every valid vector is searched, each length apart. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows without an id. Where there are fewer than k other rows of the query's length all are returned.
    Repeated rows are candidates each; a repeated query returns once. Empty tables give no rows. Columns other than the id
    and the vector are not read, so clashing names do not matter.
    """
    spark = vectors.sparkSession
    rows, asked = _valid(vectors, id_col, vector_col), _valid(queries, id_col, vector_col).dropDuplicates(["id"])
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"))
    by_length: dict[int, list] = {}
    for d, n in sorted(lengths.collect()):  # a row a length; each has a sample of its own
        if n >= least_sample:
            by_length[d] = rows.where(F.size("vector") == d).orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()["vector"].tolist()
    coders = spark.sparkContext.broadcast({d: learned(np.array(vs, dtype=np.float64), k=k) for d, vs in by_length.items() if len(vs) >= least_sample})
    size = asked.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    out = None
    for j in range(chunks):
        own = asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("id", F.lit("chunk")), F.lit(chunks)) == j)
        held: dict[int, tuple[list, list]] = {}
        for r in own.toPandas().itertuples(index=False):
            ids, xs = held.setdefault(len(r.vector), ([], []))
            ids.append(r.id)
            xs.append(r.vector)
        shared = spark.sparkContext.broadcast({d: (np.array(ids, np.int64), np.array(xs, np.float64)) for d, (ids, xs) in held.items()})
        found = rows.mapInArrow(_search(k, block, coders, shared), FOUND)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        top = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if chunks > 1:  # one chunk is in memory at a time
            top = written(top, "nearest")
            shared.destroy()
        out = top if out is None else out.unionByName(top)
    return out
