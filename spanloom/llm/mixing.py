"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a word budget. Whole epochs over a source come first; what remains of its budget is drawn without
replacement: every document has the key ``-ln(u) / weight`` with u hashed from its id, and the documents with the smallest
keys are taken while the prefix sum of their sizes is nearer to the budget with them than without.

The prefix sum never sorts a source in one task. Keys fall into slices by the exponential distribution they follow, slice
totals are summed per source (at most ``slices`` rows), and rows are ordered within their slice only.

What is drawn of a source is a prefix of its order, so the last document drawn tells for every row by itself whether it was:
:func:`materialised` makes the mix from these cutoffs, one row a source, and moves no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import with_hint
from .scratch import written

#: What counts as space between words.
SPACES = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    """Runs of non-space characters; null counts 0. One pass, and memory bounded by the text."""
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(SPACES)), _WORD, "x")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """Number in (0, 1) from the hash of a key; the same in every run."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """Word budget of each source from ``source, source_size``.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words. A budget stops
    at ``ceiling`` times its source's size; the excess goes to the others by weight until none is above. That fixed point
    is a water level: with sources ordered by ceiling over weight, a prefix is at its ceiling and the rest get level x
    weight. One row per source, so the ordering is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(ceiling))).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    capped, weighed = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = (total - capped) / (F.sum("w").over(whole) - weighed)
    levels = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("first", first).select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("first.level") * F.col("w")), F.col("cap")).alias("target"))


#: Most rows of a table that is broadcast: labels of 12 bytes, cutoffs of under 100.
MAX_LABELS, MAX_SOURCES = 500_000, 10_000


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", name: str = "weight", good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """``docs`` with a weight: ``good`` for a quality label of 1, ``bad`` for 0, else 1. Of several labels of an id the larger counts.

    Few labels are broadcast; of more, only rows that may have one are joined. Rows without an id have none and are never joined.
    """
    judged = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__label")).agg(F.max("quality").alias("__quality"))
    weight = F.when(F.col("__quality") == 1, good).when(F.col("__quality") == 0, bad).otherwise(1.0)
    named = docs.withColumn("__id", F.col(id_col).cast("long"))

    def joined(rows: DataFrame, right: DataFrame) -> DataFrame:
        return rows.join(right, F.col("__id") == F.col("__label"), "left").withColumn(name, weight).drop("__id", "__label", "__quality")

    if judged.limit(MAX_LABELS + 1).count() <= MAX_LABELS:
        return joined(named, F.broadcast(judged))
    hinted = with_hint(named, "__id", judged, "__label")
    return joined(hinted.where("__maybe").drop("__maybe"), judged).unionByName(hinted.where("NOT __maybe").drop("__maybe", "__id").withColumn(name, F.lit(1.0)))


def _quality(weight_col: str | None) -> Column:
    quality = F.when(F.col(weight_col) > 0, F.col(weight_col).cast("double")).otherwise(F.lit(1.0)) if weight_col else F.lit(1.0)
    return F.coalesce(quality, F.lit(1.0))


def _tag(id_col: str, content: Column | None) -> Column:
    """What stands for a document in the draw: its id, or the digest of its text where it has none."""
    return F.coalesce(F.col(id_col).cast("string"), content if content is not None else F.lit(""), F.lit(""))


def content_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _ranked(docs: DataFrame, id_col: str, text_col: str, source_col: str, size_col: str | None, weight_col: str | None, content_col: str | None,
            weights: tuple[float, ...], share: float, ceiling: float, seed: int, slices: int) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, source, size, tag, key, source_size, target, epochs, drawn``."""
    size = F.col(size_col).cast("long") if size_col else word_count(F.col(text_col))
    tag = _tag(id_col, F.col(content_col) if content_col else None if size_col else content_key(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _quality(weight_col).alias("quality"), tag.alias("tag"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("tag"), seed)) / F.col("quality"))
    rows = written(rows, "mixing")  # sizes are counted once, not once for each use below
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("quality").alias("mean_quality"))
    targets = source_targets(per_source.select("source", "source_size"), weights, share, ceiling)
    plan = (
        per_source.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source"))
        .select("p.source", "p.source_size", "p.mean_quality", "t.target")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    )
    slice_of = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key") * F.col("mean_quality"))) * slices), F.lit(slices - 1)).cast("int")
    sliced = (
        rows.alias("r").join(plan.alias("s"), F.expr("r.source <=> s.source"))
        .select("r.doc_id", "r.source", "size", "tag", "key", "source_size", "target", "epochs", "budget", slice_of.alias("slice"))
    )
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sliced.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")).withColumn("offset", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
    inside = Window.partitionBy("source", "slice").orderBy("key", "size", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        sliced.withColumn("upto", F.sum("size").over(inside)).alias("a")
        .join(offsets.alias("o"), F.expr("a.source <=> o.source AND a.slice = o.slice"))
        .withColumn("before", F.col("offset") + F.col("upto") - F.col("size"))
    )
    drawn = F.col("before") + F.col("size") / 2.0 <= F.col("budget")
    return ranked.select("a.doc_id", "a.source", "size", "tag", "key", "source_size", "target", "epochs", drawn.alias("drawn"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, weight_col: str | None = None, content_col: str | None = None,
          weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0, seed: int = 17, slices: int = 1024) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is a multiple of ``size``: epochs in full, and one time more for documents in the fractional draw. Documents
    without words (null, empty, only spaces) have size 0 and take 0; very long texts are counted whole. Null sources are
    one source. A null or non-positive quality weight counts as 1. Rows without an id draw by the digest of their text.
    Repeated rows are separate documents with equal keys; among equal keys the smaller ones are taken first. An empty table
    gives no rows. Other columns of ``docs`` are not read, whatever their names; with ``size_col`` the text is not read
    either, and ``content_col`` has the digests (:func:`content_key`).
    """
    ranked = _ranked(docs, id_col, text_col, source_col, size_col, weight_col, content_col, weights, share, ceiling, seed, slices)
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("drawn").cast("long"))).alias("taken"))


def cutoffs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size_col: str | None = None, weight_col: str | None = None, content_col: str | None = None,
            weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, ceiling: float = 2.0, seed: int = 17, slices: int = 1024) -> DataFrame:
    """The mix of :func:`mixed` as one row a source: ``source, epochs, cut, n_cut, n_all, seed``.

    ``cut`` (key, size, tag) is the last place drawn in the source's order, null if none is; ``n_cut`` of the ``n_all`` rows that
    share that place are drawn.
    """
    ranked = _ranked(docs, id_col, text_col, source_col, size_col, weight_col, content_col, weights, share, ceiling, seed, slices)
    ranked = written(ranked.select("source", "epochs", "drawn", F.struct("key", "size", "tag").alias("place")), "mixing-places")
    cuts = ranked.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max(F.when(F.col("drawn"), F.col("place"))).alias("cut"))
    held = F.broadcast(cuts) if cuts.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else cuts
    at = ranked.alias("r").join(held.alias("c"), F.expr("r.source <=> c.source AND r.place = c.cut")).groupBy("c.source").agg(F.count_if("drawn").alias("n_cut"), F.count("*").alias("n_all"))
    out = cuts.alias("c").join(at.alias("a"), F.expr("c.source <=> a.source"), "left")
    return written(out.select("c.source", "epochs", "cut", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("n_all", F.lit(0)).alias("n_all"), F.lit(seed).alias("seed")), "mixing-cutoffs")


def materialised(docs: DataFrame, cuts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``, from :func:`cutoffs` of the same rows.

    Every row is judged by itself, also if its id repeats or is null. Only of rows that are equal in source, id (or text), size
    and weight, and that the budget takes in part, one stands for all. Rows without words go. An empty table gives no rows.
    """
    seed = cuts.select("seed").first()
    if seed is None:
        return docs.limit(0)
    names = docs.columns
    tag = _tag(id_col, content_key(F.col(text_col)))
    rows = docs.withColumn("__tag", tag).withColumn("__key", -F.log(uniform(F.col("__tag"), seed[0])) / _quality(weight_col))
    right = cuts.select(F.col("source").alias("__source"), "epochs", "cut", "n_cut", "n_all").select("__source", *[F.col(c).alias(f"__{c}") for c in ("epochs", "cut", "n_cut", "n_all")])
    right = F.broadcast(right) if right.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else right
    rows = rows.join(right, F.col(source_col).eqNullSafe(F.col("__source")))
    # Sizes are counted only where the keys are equal.
    rest = F.struct(word_count(F.col(text_col)).alias("size"), F.col("__tag").alias("tag"))
    cut_rest = F.struct(F.col("__cut.size").alias("size"), F.col("__cut.tag").alias("tag"))
    side = F.when(F.col("__cut").isNull() | (F.col("__key") > F.col("__cut.key")), 1).when(F.col("__key") < F.col("__cut.key"), -1).when(rest < cut_rest, -1).when(rest == cut_rest, 0).otherwise(1)
    spoken = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    rows = rows.where(spoken).withColumn("__side", side)
    whole = F.col("__n_cut") == F.col("__n_all")
    times = F.col("__epochs") + F.when((F.col("__side") < 0) | ((F.col("__side") == 0) & whole), 1).otherwise(0)
    every = lambda df, n: df.withColumn("__copy", F.explode(F.sequence(F.lit(1), n.cast("int")))).select(*[F.col(f"`{c}`") for c in names])
    out = every(rows.where(times > 0), times)
    if cuts.where("n_cut < n_all").isEmpty():
        return out
    once = rows.where((F.col("__side") == 0) & ~whole & (F.col("__n_cut") > 0)).dropDuplicates(["__source"])
    return out.unionByName(every(once, F.col("__n_cut")))
