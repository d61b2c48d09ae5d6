"""Closed integer spans ``[lo, hi]`` under an equi key: merge, overlap, containment, subtraction, nearest.

A pure deletion between lines N and N + 1 is stored on doubled positions (``2 N + 1``), so every comparison stays integral.

Joins of points and spans do not pair all rows of a key. A span lies in one or two cells of the grid whose cells are as wide as
itself or up to sixteen times that, a point in one cell of each grid that spans use; they are joined on key, grid and cell, so a
key with very many spans is dealt over many tasks and compares only what is near. Grids are that far apart since a point is
shuffled once for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Scan
from .tables import stored


def merge_spans(spans: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", gap: int = 1, bucket_rows: int | None = None) -> DataFrame:
    """Overlapping or adjacent spans of a key as one (``lo <= furthest hi before + gap``).

    Spans of one start are one row. A span that begins beyond all before it starts an island, and every other one belongs to the
    last start before it. Both are running maxima, so a key with very many spans is dealt over many tasks.
    """
    furthest = spans.where(F.col(lo).isNotNull()).groupBy(*keys, lo).agg(F.max(hi).alias(hi))
    scan = Scan(furthest, keys, lo, bucket_rows)
    seen = scan.running(scan.rows, {"__reach": ("max", hi)}, before=True)
    begins = seen.withColumn("__begin", F.when(F.col("__reach").isNull() | (F.col(lo) > F.col("__reach") + gap), F.col(lo)))
    placed = scan.running(begins, {"__island": ("max", "__begin")})
    return placed.groupBy(*keys, F.col("__island").alias(lo)).agg(F.max(hi).alias(hi))


def widened(lo: Column, hi: Column, context: int = 3, least: int = 1) -> tuple[Column, Column]:
    """A span with ``context`` lines more at both ends; only the lower end is clipped."""
    return F.greatest(F.lit(least), lo - context), hi + context


#: Grids' cells are 1, 16, 256, ... wide: powers of two so far apart.
_GRIDS = 4


def _same(keys: list[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__{k}"))
    return condition


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], point: str, carried: list[Column] = ()) -> DataFrame:
    """Points with each span that holds them: the points' columns, ``__lo, __hi`` and what is ``carried`` of the span. Points outside all spans go."""
    level = (F.ceil(F.log2((F.col("hi") - F.col("lo") + 1).cast("double")) / _GRIDS) * _GRIDS).cast("int")
    cell = lambda c, n: F.call_function("shiftright", c.cast("long"), n)
    sized = spans.where("lo <= hi").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), level.alias("__grid"), *carried)
    levels = sized.agg(F.collect_set("__grid")).scalar()
    both = F.array_distinct(F.array(cell(F.col("__lo"), F.col("__grid")), cell(F.col("__hi"), F.col("__grid"))))
    dealt = sized.withColumn("__cell", F.explode(both))
    asked = points.where(F.col(point).isNotNull()).withColumn("__g", F.explode(levels)).withColumn("__c", cell(F.col(point), F.col("__g")))
    met = asked.join(dealt, _same(keys) & (F.col("__g") == F.col("__grid")) & (F.col("__c") == F.col("__cell")) & (F.col(point) >= F.col("__lo")) & (F.col(point) <= F.col("__hi")))
    return met.drop("__g", "__c", "__grid", "__cell", *[f"__{k}" for k in keys])


def _touching(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """Distinct ``keys, lo, hi`` of ``left`` that lie within ``tolerance`` of a span of ``right``: one begins inside the other."""
    own = left.where("lo IS NOT NULL AND hi IS NOT NULL").select(*keys, "lo", "hi").distinct()
    wide = right.select(*keys, (F.col("lo") - tolerance).alias("lo"), (F.col("hi") + tolerance).alias("hi")).distinct()
    begins = stabbed(own, wide, keys, "lo").select(*keys, "lo", "hi")
    starts = wide.select(*keys, F.col("lo").alias("__at")).distinct()
    holds = stabbed(starts, own, keys, "__at").select(*keys, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"))
    return begins.union(holds).distinct()


def meeting(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every pair of a span of ``left`` and one of ``right`` of their key that share a position: ``keys, left_id, right_id``, once each.

    Both have ``id, lo, hi``. Of two spans that meet one begins inside the other, so all pairs come from two joins by cells.
    """
    a, b = (df.where("lo <= hi").select(*keys, "id", "lo", "hi") for df in (left, right))
    begins = stabbed(b.withColumnRenamed("id", "right_id"), a, keys, "lo", [F.col("id").alias("left_id")]).select(*keys, "left_id", "right_id")
    holds = stabbed(a.withColumnRenamed("id", "left_id"), b, keys, "lo", [F.col("id").alias("right_id")]).where(F.col("lo") > F.col("__lo")).select(*keys, "left_id", "right_id")
    return begins.unionByName(holds)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left_semi", tolerance: int = 0) -> DataFrame:
    """Rows of ``left`` that lie (``left_semi``), or do not lie (``left_anti``), within ``tolerance`` of a span of ``right`` (0: overlap)."""
    return left.join(_touching(left, right, keys, tolerance), [*keys, "lo", "hi"], how).select(*left.columns)


def site_states(sites: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``state`` to call sites: ``unknown`` without a line, ``updated`` where a changed range overlaps, else ``untouched``."""
    hit = _touching(sites, changed, keys).withColumn("__hit", F.lit(True))
    state = F.when(F.col("lo").isNull() | F.col("hi").isNull(), "unknown").when(F.col("__hit"), "updated").otherwise("untouched")
    return sites.join(hit, [*keys, "lo", "hi"], "left").withColumn("state", state).select(*sites.columns, "state")


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], point: str = "at", rank: tuple[str, ...] = ("id",)) -> DataFrame:
    """For every point the smallest span that holds it (ties by ``rank``), as columns of the span; points outside all spans stay, with nulls.

    One row per distinct (keys, point).
    """
    names = [c for c in spans.columns if c not in keys]
    packed = F.struct((F.col("hi") - F.col("lo")).alias("size"), *[F.col(c) for c in rank], *[F.col(c).alias(f"_{c}") for c in names if c not in rank]).alias("__span")
    wanted = points.select(*keys, point).distinct()
    found = stabbed(wanted, spans, keys, point, [packed]).select(*keys, point, "__span")
    none = wanted.select(*keys, point, F.lit(None).cast(found.schema["__span"].dataType).alias("__span"))
    best = found.unionByName(none).groupBy(*keys, point).agg(F.min("__span").alias("__span"))
    return best.select(*keys, point, *[F.col(f"__span.{c if c in rank else '_' + c}").alias(c) for c in names])


def owners_of_ranges(ranges: DataFrame, spans: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """``keys, lo, hi, id`` for each changed range and each span that owns a line of it, innermost per line.

    Positions are doubled lines: a range of lines has even ends; a pure deletion is one odd position, and belongs only to a span that
    holds the lines on both sides. A range meets new owners only where a span begins or ends, so only those lines are asked.
    """
    own = spans.select(*keys, F.col(id_col).alias("id"), "lo", "hi")
    lines = ranges.where("lo % 2 = 0")
    edges = own.select(*keys, F.explode(F.array("lo", "hi", F.col("hi") + 2)).alias("at")).distinct()
    ends = lines.select(*keys, "lo", "hi", F.explode(F.array("lo", "hi")).alias("at"))
    inside = stabbed(edges, lines.select(*keys, "lo", "hi").distinct(), keys, "at").select(*keys, F.col("__lo").alias("lo"), F.col("__hi").alias("hi"), "at")
    gaps = ranges.where("lo % 2 <> 0").select(*keys, "lo", "hi", F.col("lo").alias("at"))
    asked = stored(ends.unionByName(inside).unionByName(gaps).distinct(), "owners-lines")  # each step's shuffles go before the next one's come
    best = innermost(asked.select(*keys, "at"), own, keys)
    held = stored(best.where("id IS NOT NULL").select(*keys, "at", "id"), "owners-held")
    return asked.join(held, [*keys, "at"]).select(*keys, "lo", "hi", "id").distinct()


def row_at(points: DataFrame, rows: DataFrame, outside: DataFrame, keys: list[str], point: str = "at") -> DataFrame:
    """Where a line leads: the innermost row that holds it, else the row of top-level lines that does, else the file: ``keys, at, id, level``.

    ``rows`` and ``outside`` have the keys, ``id, lo, hi``.
    """
    inner = innermost(points, rows.select(*keys, "id", "lo", "hi"), keys, point).select(*keys, point, F.col("id").alias("__row"))
    outer = innermost(points, outside.select(*keys, "id", "lo", "hi"), keys, point).select(*keys, point, F.col("id").alias("__outside"))
    level = F.when(F.col("__row").isNotNull(), "row").when(F.col("__outside").isNotNull(), "outside").otherwise("file")
    return inner.join(outer, [*keys, point]).select(*keys, point, F.coalesce("__row", "__outside").alias("id"), level.alias("level"))


def holders_without_smaller(spans: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """Spans that contain no strictly smaller span of their key."""
    own = spans.select(*keys, "lo", "hi").distinct()
    others = own.select(*keys, F.col("lo").alias("__at"), F.col("hi").alias("__end"))
    holding = stabbed(others, own, keys, "__at").where((F.col("__end") <= F.col("__hi")) & (F.col("__end") - F.col("__at") < F.col("__hi") - F.col("__lo")))
    return spans.join(holding.select(*keys, F.col("__lo").alias("lo"), F.col("__hi").alias("hi")).distinct(), [*keys, "lo", "hi"], "left_anti").select(*spans.columns)


def subtract(spans: DataFrame, minus: DataFrame, keys: list[str], bucket_rows: int | None = None) -> DataFrame:
    """What is left of each key's spans after taking away ``minus``: maximal spans, sorted and disjoint.

    A sweep: starts and ends of both sides are summed by position, and running counts tell which stretch lies in a span and
    in nothing to take away. Spans whose ``lo`` is behind their ``hi``, or with a null end, are nothing.
    """
    side = lambda df, own, other: df.where("lo <= hi").select(*keys, F.explode(F.array(F.struct(F.col("lo").cast("long").alias("at"), F.lit(1).alias("d")), F.struct((F.col("hi").cast("long") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*keys, "e.at", F.col("e.d").alias(own), F.lit(0).alias(other))
    steps = side(spans, "held", "taken").unionByName(side(minus, "taken", "held")).groupBy(*keys, "at").agg(F.sum("held").alias("held"), F.sum("taken").alias("taken"))
    scan = Scan(steps, keys, "at", bucket_rows)
    counted = scan.running(scan.rows, {"__held": ("sum", "held"), "__taken": ("sum", "taken")})
    # A stretch reaches to the next position; it is kept, or it is where a kept one ends.
    kept = counted.withColumn("__kept", (F.col("__held") > 0) & (F.col("__taken") <= 0))
    off = kept.withColumn("__off", F.when(~F.col("__kept"), F.col("at")))
    on = scan.running(off, {"__end": ("min", "__off")}, before=True, reverse=True).where("__kept")
    kind = spans.schema["lo"].dataType
    return on.groupBy(*keys, "__end").agg(F.min("at").alias("lo")).select(*keys, F.col("lo").cast(kind).alias("lo"), (F.col("__end") - 1).cast(spans.schema["hi"].dataType).alias("hi"))


#: Fixed value: a line that is blank or only opens, continues or is a comment.
TRIVIA = r"^\s*(//|/\*|\*|$)"


def outside_lines(ranges: DataFrame, spans: DataFrame, keys: list[str], deletions: DataFrame, deleted: DataFrame, base_spans: DataFrame, base_lines: DataFrame, trivia: str = TRIVIA) -> DataFrame:
    """``keys, lo, hi``: what of the changed ``ranges`` no span stands for; positions are doubled lines, as in :func:`owners_of_ranges`.

    ``ranges`` (changed lines, even ends, or a pure deletion at one odd position) and ``spans`` (changed functions at the head) have ``lo,
    hi``; ``deletions`` has ``at`` (odd), ``old_start, old_end`` (lines removed from the base) and ``new_end`` (last added line of a
    replacement, null where only lines went); ``deleted`` (functions that went) and ``base_spans`` (all functions of the base) have
    ``lo, hi`` in lines, ``base_lines`` has ``line, text``.

    Changed lines: those outside all spans, as maximal ranges. A pure deletion counts unless a span holds the lines on both sides,
    or it is explained: it removed lines of deleted functions, and beside these only trivia. A replacement that is not explained
    counts at its place if nothing outside was added there and it removed a line outside all functions of the base (trivia
    beside a deleted function belongs to that one). A key without ``base_lines`` explains nothing.
    """
    even = lambda df: df.where("lo % 2 = 0").select(*keys, (F.col("lo") / 2).cast("long").alias("lo"), (F.col("hi") / 2).cast("long").alias("hi"))
    loose = stored(subtract(even(ranges), even(spans), keys), "outside-loose")
    gaps = ranges.where("lo % 2 <> 0").select(*keys, F.col("lo").cast("long").alias("at")).distinct()
    inside = stabbed(gaps, spans.select(*keys, "lo", "hi"), keys, "at").select(*keys, "at").distinct()

    removed = deletions.select(*keys, F.col("at").cast("long").alias("at"), F.explode(F.sequence(F.col("old_start").cast("long"), F.col("old_end").cast("long"))).alias("line")).distinct()
    removed = stored(removed, "outside-removed")
    whole = lambda df: merge_spans(df.where("lo <= hi").select(*keys, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")), keys)
    held = lambda df, name: stabbed(removed, whole(df), keys, "line").select(*keys, "at", "line", F.lit(True).alias(name))
    texts = base_lines.select(*keys, F.col("line").cast("long").alias("line"), F.coalesce("text", F.lit("")).rlike(trivia).alias("__trivial")).dropDuplicates([*keys, "line"])
    known = base_lines.select(*keys).distinct().withColumn("__known", F.lit(True))
    lines = removed.join(held(deleted, "__gone"), [*keys, "at", "line"], "left").join(held(base_spans, "__own"), [*keys, "at", "line"], "left").join(texts, [*keys, "line"], "left").join(known, keys, "left")
    gone, own, has = (F.coalesce(c, F.lit(False)) for c in ("__gone", "__own", "__known"))
    trivial = has & F.coalesce("__trivial", F.lit(True))  # beyond the last line there is nothing
    judged = lines.groupBy(*keys, "at").agg(F.bool_or(gone).alias("__touches"), F.bool_and(gone | trivial).alias("__all"), F.bool_or(has).alias("__has"), F.bool_or(~own & ~trivial).alias("__other"), F.bool_or(~own).alias("__out"))
    judged = stored(judged, "outside-judged")
    explained = F.col("__has") & F.col("__all") & F.col("__touches")
    pure = gaps.join(inside, [*keys, "at"], "left_anti").join(judged.where(explained).select(*keys, "at"), [*keys, "at"], "left_anti")
    bare = judged.where(~explained & F.when(F.col("__touches"), F.col("__other")).otherwise(F.col("__out"))).select(*keys, "at")
    swapped = deletions.where("new_end IS NOT NULL").select(*keys, F.col("at").cast("long").alias("at"), ((F.col("at") + 1) / 2).cast("long").alias("lo"), F.col("new_end").cast("long").alias("hi")).join(bare, [*keys, "at"])
    swapped = overlapping(swapped, loose, keys, "left_anti")
    marks = pure.select(*keys, "at").unionByName(swapped.select(*keys, "at")).distinct().select(*keys, F.col("at").alias("lo"), F.col("at").alias("hi"))
    return loose.select(*keys, (F.col("lo") * 2).alias("lo"), (F.col("hi") * 2).alias("hi")).unionByName(marks)


def nearest_line(wanted: DataFrame, spans: DataFrame, keys: list[str], preferred: str = "preferred", bucket_rows: int | None = None) -> DataFrame:
    """Line of the key's spans that is nearest to ``preferred``; the earlier of two equally near ones. ``line`` is null without spans.

    Running values over the spans' starts and the wanted lines: the furthest end of the spans that begin up to a line, and the
    first start behind it.
    """
    number = lambda: F.lit(None).cast("long")
    asked = wanted.where(F.col(preferred).isNotNull()).select(*keys, F.col(preferred).cast("long").alias("__at"), F.lit(True).alias("__asked"), number().alias("__lo"), number().alias("__hi"))
    known = spans.where("lo <= hi").select(*keys, F.col("lo").cast("long").alias("__at"), F.lit(False).alias("__asked"), F.col("lo").cast("long").alias("__lo"), F.col("hi").cast("long").alias("__hi"))
    marks = asked.unionByName(known).groupBy(*keys, "__at").agg(F.bool_or("__asked").alias("__asked"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    scan = Scan(marks, keys, "__at", bucket_rows)
    seen = scan.running(scan.running(scan.rows, {"__before": ("max", "__hi")}), {"__after": ("min", "__lo")}, before=True, reverse=True).where("__asked")
    before, after, at = F.col("__before"), F.col("__after"), F.col("__at")
    line = F.when(before >= at, at).when(after.isNull() | (at - before <= after - at), before).otherwise(after)
    kind = spans.schema["lo"].dataType
    return seen.select(*keys, at.cast(wanted.schema[preferred].dataType).alias(preferred), line.cast(kind).alias("line"))


def commentable(spans: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Lines a comment may start on: diff spans of the shown side, cut to the document's ``lines``; spans outside it go."""
    lo, hi = F.greatest(F.lit(1), F.col("lo")), F.least(F.col("lines"), F.col("hi"))
    return spans.join(documents.select(*keys, "lines"), keys).select(*keys, lo.alias("lo"), hi.alias("hi")).where("lo <= hi")


def accepted_comments(comments: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``accepted`` for comments ``start_line, line``: both ends in one span of the diff on that side, the start not behind the end."""
    own = comments.select(*keys, "start_line", "line").distinct()
    good = stabbed(own.where("start_line <= line"), spans.select(*keys, "lo", "hi"), keys, "start_line").where(F.col("line") <= F.col("__hi"))
    marked = good.select(*keys, "start_line", "line").distinct().withColumn("accepted", F.lit(True))
    return comments.join(marked, [*keys, "start_line", "line"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def same_lines(plans: DataFrame, lines: DataFrame, other: DataFrame) -> DataFrame:
    """``unchanged`` for plans ``id, path, start_line, line, other_start``: every line is there and equal in both versions, line for line with the offset.

    ``lines`` and ``other`` have ``path, line, text``.
    """
    each = plans.withColumn("at", F.explode(F.sequence("start_line", "line"))).withColumn("there", F.col("at") - F.col("start_line") + F.col("other_start"))
    a = lines.select("path", F.col("line").alias("at"), F.col("text").alias("__a"))
    b = other.select("path", F.col("line").alias("there"), F.col("text").alias("__b"))
    same = F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))
    return each.join(a, ["path", "at"], "left").join(b, ["path", "there"], "left").groupBy("id").agg(F.bool_and(same).alias("unchanged"))
