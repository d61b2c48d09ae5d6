"""Prefix trie of conversations by partition refinement.

All conversations start in one class. Every round splits each active class by the next turns, ``block`` of them at a time:
a class is a digest chained over the turns so far, so splitting is one aggregation. Classes of one conversation retire: their
tail is a unary chain, made from two lengths without another look at the turns. Classes of several stay active for the next
round and are the trie's shared nodes. At the end the shared nodes are folded back: each stands in its smallest member, whose
sums run from the deepest turn up, and what the members of a node hold from its depth on is the node's subtree.

Turns travel as digests and byte counts; texts are read in one scan. Positions of turns come from ranges of the order, so a
conversation of very many turns is numbered by many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import positioned
from .scratch import dropped, written

_NOTHING = hashlib.sha256(b"").hexdigest()
#: Ids joined in one row before they are hashed in order.
_CHUNK = 4_096


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, n, digest, bytes``: the turns of every conversation, numbered from 1 by ``turn`` (null first), then role and text digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return positioned(turns, [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")], ("conv",), "n").select("conv", "n", "digest", "bytes")


def borrowed(conv: Column, cycle: int) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(cycle)).cast("int")


def rebuilt(turns: DataFrame, family: int, cycle: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family: ``conv, total`` and, in blocks, ``conv, block, turns(depth, digest, bytes)``.

    A conversation c takes the first h turns of c - c % family (h by its id, below ``cycle``), then its own after its first h.
    """
    sizes = turns.groupBy("conv").agg(F.count("*").alias("own"))
    head = turns.where(F.col("n") < cycle).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("n", "digest", "bytes"))).alias("head"))
    head = head.select(F.col("conv").alias("base"), "head")
    wanted = sizes.withColumn("h", borrowed(F.col("conv"), cycle)).withColumn("base", F.col("conv") - F.col("conv") % family)
    taken = F.coalesce(F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))), F.array())
    plan = wanted.join(head, "base", "left").select("conv", "own", "h", taken.alias("taken"))
    plan = written(plan.withColumn("total", F.size("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-plan")
    first = plan.select("conv", F.explode("taken").alias("t")).select("conv", F.col("t.n").alias("depth"), "t.digest", "t.bytes")
    shift = plan.select("conv", "h", (F.size("taken") - F.col("h")).alias("shift"))
    rest = turns.join(shift, "conv").where(F.col("n") > F.col("h")).select("conv", (F.col("n") + F.col("shift")).alias("depth"), "digest", "bytes")
    both = first.unionByName(rest).withColumn("block", F.floor((F.col("depth") - 1) / block).cast("int"))
    blocks = both.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "digest", "bytes"))).alias("turns"))
    return plan.select("conv", "total"), written(blocks, "trie-blocks")


def _chained(start: Column, turns: Column) -> Column:
    """The class before each of the turns and after it."""
    step = lambda done, t: F.concat(done, F.array(F.struct(
        t["depth"].alias("depth"), F.element_at(done, -1)["key"].alias("parent"), F.unhex(F.md5(F.concat(F.element_at(done, -1)["key"], t["digest"]))).alias("key"), t["bytes"].alias("bytes"))))
    empty = F.array(F.struct(F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), start.alias("key"), F.lit(0).cast("long").alias("bytes")))
    return F.slice(F.aggregate(turns, empty, step), 2, F.size(turns))


def _ends(members: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of ``members(key, conv)``: the digest of each key's ids in order, comma-joined.

    Ids are sorted by ranges and joined into chunks there; only the chunks of a key meet in one task, which streams them,
    since a SHA-256 is sequential.
    """

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def made() -> pa.RecordBatch:
            return pa.record_batch([pa.array([key], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["key", "first", "ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= _CHUNK):
                    yield made()
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if state is not None and k != key:
                    done.append((key, state.hexdigest()))
                    state = None
                if state is None:
                    key, state = k, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["key", "ends_sha256"])
        if state is not None:
            yield pa.record_batch([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    parts = members.select("key", "conv").repartitionByRange("key", "conv").sortWithinPartitions("key", "conv").mapInArrow(chunk, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, *, family: int = 5, cycle: int = 9, block: int = 8) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node of the trie of rebuilt conversations.

    ``conversations`` has ``conv_id, turn, role, text``. A node is a distinct sequence of first turns, named by its depth and
    its smallest member; the root has depth 0 and no parent. Null roles and texts are empty. Rows of one turn number follow
    role, then the digest of the text; repeated rows are turns of their own. Rows without a conv_id belong to no
    conversation and are left out. Turnless rebuilt conversations are members of the root only. An empty table has no
    nodes. Other columns are not read. Very long texts are digested where they are read; any ``block`` gives the same rows.
    """
    turns = turns_of(conversations)
    lengths, blocks = rebuilt(turns, family, cycle, block)
    total, least = lengths.agg(F.count("*"), F.min("conv")).first()
    root = lengths.where("conv IS NOT NULL").agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    nodes = root.select(F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.col("conv"), "n", F.lit(0).cast("long").alias("bytes"))
    active = lengths.select("conv", F.lit(b"").alias("key"))
    log = active.select("conv", F.lit(0).cast("long").alias("depth"), "key")
    k = 0
    while total > 1:  # one round a block; a single conversation is a chain below the root
        own = blocks.where(F.col("block") == k).join(active, "conv")
        rows = written(own.select("conv", F.inline(_chained(F.col("key"), F.col("turns")))), "trie-rows")
        classes = rows.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
        shared = written(classes.where("n > 1"), "trie-nodes")
        kept = written(rows.select("conv", "depth", "key").join(shared.select("key"), "key", "left_semi"), "trie-log")
        dropped(rows)
        nodes, log = nodes.unionByName(shared), log.unionByName(kept.select("conv", "depth", "key"))
        active, k = kept.where(F.col("depth") == (k + 1) * block).select("conv", "key"), k + 1
        if active.isEmpty():
            break
    return _folded(written(nodes, "trie-shared"), written(log, "trie-members"), lengths)


def _folded(nodes: DataFrame, log: DataFrame, lengths: DataFrame) -> DataFrame:
    """All nodes, from shared ones ``nodes(key, parent, depth, conv, n, bytes)`` and their members ``log(conv, depth, key)``."""
    last = log.groupBy("conv").agg(F.max(F.struct("depth", "key")).alias("m")).select("conv", F.col("m.depth").alias("s"), F.col("m.key").alias("key"))
    tails = written(lengths.join(last, "conv").select("conv", "total", "s", "key"), "trie-tails")
    below = nodes.where("parent IS NOT NULL").select(F.col("parent").alias("key")).unionAll(tails.where("total > s").select("key"))
    children = below.groupBy("key").agg(F.count("*").alias("n_children"))
    known = written(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")
    # Each shared node stands once in its smallest member: what it saves, and a leaf where it has no child. A tail is a leaf of its own.
    stands = known.select("conv", "depth", ((F.col("n") - 1) * F.col("bytes")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    tail = tails.where("total > s").select("conv", F.col("s").alias("depth"), F.lit(0).cast("long").alias("saves"), F.lit(1).cast("long").alias("leaf"))
    counted = stands.unionByName(tail).groupBy("conv", "depth").agg(F.sum("saves").alias("saves"), F.sum("leaf").alias("leaf"))
    upward = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = log.join(counted, ["conv", "depth"], "left").select("key", *[F.sum(F.coalesce(c, F.lit(0))).over(upward).alias(c) for c in ("saves", "leaf")])
    subtrees = sums.groupBy("key").agg(F.sum("saves").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = _ends(tails.where("total = s"))
    above = known.select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv_id"))
    inner = known.join(above, "parent", "left").join(subtrees, "key").join(ends, "key", "left")
    inner = inner.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))
    # Tails in runs of a bounded length, so that a very long one is no array.
    run = 4_096
    runs = tails.where("total > s").join(known.select("key", F.col("conv").alias("top")), "key").withColumn("from", F.explode(F.sequence(F.col("s") + 1, F.col("total").cast("long"), F.lit(run).cast("long"))))
    chain = runs.withColumn("depth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + run - 1, F.col("total").cast("long")))))
    final = F.col("depth") == F.col("total")
    outer = chain.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("s") + 1, F.col("top")).otherwise(F.col("conv")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (~final).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(final, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(_NOTHING).alias("ends_sha256"),
    )
    return inner.unionByName(outer).select(*_NODE)
