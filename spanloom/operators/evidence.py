"""Evidence: severity scores, repeated patterns, moved facts and the strength of hints between groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import informative
from .tables import stored

#: The weight of each kind of signature change, heaviest first.
KIND_WEIGHTS = {
    "new-throw": 80, "optional-param": 70, "optional-param-changed": 70, "default-changed": 65, "param-removed": 55, "async-changed": 45,
    "type-changed": 30, "required-param": 25, "access-changed": 25, "return-changed": 20, "body": 10,
}


def kind_weight(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in KIND_WEIGHTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(0))


def severity(kinds: Column, stale: Column) -> Column:
    """The heaviest kind (10 at least) plus twice the stale callers, of which ten count."""
    heaviest = F.coalesce(F.array_max(F.transform(kinds, kind_weight)), F.lit(0))
    return F.greatest(heaviest, F.lit(10)) + 2 * F.least(stale, F.lit(10))


def is_finding(kinds: Column) -> Column:
    return F.exists(kinds, lambda k: k != "body")


def caller_states(callers: DataFrame, group: list[str]) -> DataFrame:
    """Per change: production callers, those not updated, and those not updated though they changed elsewhere.

    ``callers`` has ``is_test`` and ``call_state`` (updated-at-call, changed-elsewhere, unchanged).
    """
    live = ~F.col("is_test")
    stale = live & (F.col("call_state") != "updated-at-call")
    return callers.groupBy(*group).agg(
        F.count_if(live).alias("callers"), F.count_if(stale).alias("stale"), F.count_if(stale & (F.col("call_state") == "changed-elsewhere")).alias("stale_changed"), F.count_if(F.col("is_test")).alias("tests")
    )


def repeated_patterns(edits: DataFrame, pattern: str, item: str, group: str, least_items: int = 5, least_groups: int = 2, useful: Column | None = None) -> DataFrame:
    """Patterns that at least ``least_items`` items in ``least_groups`` groups share, with both counts.

    An item lies in one group, and ``edits`` has a row for each pattern and item at most, so items are counted by group and
    the groups' counts added up. ``useful`` is a condition on rows (:func:`~spanloom.functions.text.informative` of edit keys).
    """
    known = edits.where(F.col(pattern).isNotNull()) if useful is None else edits.where(F.col(pattern).isNotNull() & useful)
    by_group = known.groupBy(pattern, group).agg(F.count("*").alias("n"))
    counts = by_group.groupBy(pattern).agg(F.sum("n").alias("items"), F.count("*").alias("groups"))
    return counts.where((F.col("items") >= least_items) & (F.col("groups") >= least_groups))


def settled_keys(edits: DataFrame, item: str, record: str, literal: str, shape: str, group: str, least_items: int = 5, least_groups: int = 2) -> DataFrame:
    """``item, record, level`` for every hunk record with edits, and its ``shape``.

    ``edits`` has a row for each edit: its item (in one group), its record, its ``literal`` key (null: too long for one) and the
    ``shape`` of the whole record (null: says nothing). A record is ``literal`` where every key of it is an informative one that
    repeats; else ``shape`` where its shape repeats among the records that are not literal; else null.
    """
    named = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.xxhash64(c).alias("h"), F.xxhash64(c, F.lit(1)).alias("g")))
    keys = edits.select(item, record, group, named(literal).alias("__literal"), (F.col(literal).isNotNull() & informative(F.col(literal))).alias("__useful"), named(shape).alias("__shape"))
    keys = stored(keys, "settled-keys")  # texts are read once and go no further: 128 bits stand for them
    repeats = repeated_patterns(keys.where("__useful").select(item, group, "__literal").distinct(), "__literal", item, group, least_items, least_groups)
    repeats = stored(repeats.select(F.col("__literal").alias("__repeats")), "settled-literals")
    marked = keys.join(repeats, F.col("__literal") == F.col("__repeats"), "left")
    records = marked.groupBy(item, record).agg(F.first(group).alias(group), F.first("__shape").alias("__shape"), F.bool_and(F.col("__repeats").isNotNull()).alias("__settled"))
    records = stored(records, "settled-records")
    open_ = records.where("NOT __settled AND __shape IS NOT NULL").select(item, group, "__shape").distinct()
    shapes = repeated_patterns(open_, "__shape", item, group, least_items, least_groups).select("__shape")
    texts = edits.where(F.col(shape).isNotNull()).groupBy(named(shape).alias("__shape")).agg(F.first(shape).alias("__text"))
    shapes = stored(texts.join(shapes, "__shape", "left_semi").select(F.col("__shape").alias("__repeats"), "__text"), "settled-shapes")
    judged = records.join(shapes, F.col("__shape") == F.col("__repeats"), "left")
    level = F.when(F.col("__settled"), "literal").when(F.col("__repeats").isNotNull(), "shape")
    return judged.select(item, record, level.alias("level"), F.when(level == "shape", F.col("__text")).alias(shape))


def pooled(counts: DataFrame, key: str, n: str, least: int = 8) -> DataFrame:
    """Groups of at least ``least``; the smaller ones together as ``other`` if they come to that many."""
    large = counts.where(F.col(n) >= least).select(key, n)
    rest = counts.where(F.col(n) < least).agg(F.sum(n).alias(n)).where(F.col(n) >= least).select(F.lit("other").alias(key), F.col(n).cast(counts.schema[n].dataType).alias(n))
    return large.unionByName(rest)


def strength(evidence: DataFrame, pair: list[str]) -> DataFrame:
    """Distinct kinds of counted evidence for each pair, and all pieces; pairs without a counted kind go.

    ``evidence`` has ``type`` and ``counted`` (false for a shared folder and for a weak or broad commit).
    """
    found = evidence.groupBy(*pair).agg(F.countDistinct(F.when(F.col("counted"), F.col("type"))).alias("strength"), F.count("*").alias("pieces"))
    return found.where("strength > 0")


#: First words of subjects that say little.
WEAK_SUBJECT = r"(?i)^(chore|docs?|style|lint|format|wip|merge|revert)\b"


def weak_commit(subject: Column) -> Column:
    """Subjects that begin with a word of :data:`WEAK_SUBJECT`, or have fewer than three words."""
    text = F.trim(F.coalesce(subject, F.lit("")))
    return text.rlike(WEAK_SUBJECT) | (F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) < 3)


def broad_commit(commit_files: Column, changed_files: Column) -> Column:
    """More than half of the changed files, where there are ten at least."""
    return F.coalesce((changed_files >= 10) & (commit_files * 2 > changed_files), F.lit(False))
