"""Orders, tops, caps, budgets, pages and neighbours. Every order ends in a column that makes it total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    ranked = df.withColumn(rank or "__rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    ranked = ranked.where(F.col(rank or "__rank") <= n)
    return ranked if rank else ranked.drop("__rank")


def dominant(df: DataFrame, group: list[str], value: str, weight: str | None = None, by_total: bool = False) -> DataFrame:
    """Most frequent value of each group; ties by ``weight`` (descending, where given), or by how many groups have the value at all, and then the value."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"), *([F.max(weight).alias("__w")] if weight else []))
    if by_total:
        counts = counts.join(counts.groupBy(value).agg(F.count("*").alias("__w")), value)
    order = [F.desc("n"), *([F.desc("__w")] if weight or by_total else []), F.col(value)]
    return top_per_group(counts, group, order).select(*group, value, "n")


def capped_list(df: DataFrame, group: list[str], item: Column, order: list[Column], most: int) -> DataFrame:
    """First ``most`` items of each group in order as an array, with the true count. Only the first ones are gathered."""
    counts = df.groupBy(*group).agg(F.count("*").alias("total"))
    first = top_per_group(df.withColumn("__item", item), group, order, most, rank="__n")
    lists = first.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__item"))), lambda x: x["__item"]).alias("items"))
    return counts.join(lists, group)


def within_budget(df: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group up to the first that would pass the budget; later smaller rows are not taken."""
    running = F.sum(size).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("running", running).where(F.col("running") <= budget)


def whole_number(value: int | None, fallback: int, most: int, name: str) -> int:
    """An argument from 1 to ``most``; ``fallback`` where it is left out, and an error where it is anything else."""
    if value is None:
        return fallback
    if isinstance(value, bool) or not isinstance(value, int) or not 1 <= value <= most:
        raise ValueError(f"{name} must be an integer from 1 to {most}")
    return value


def page(df: DataFrame, order: list[Column], number: int | None = None, size: int | None = None, largest: int = 200, text: Column | None = None, most_chars: int = 40_000) -> DataFrame:
    """One page, 1-based, with ``position``, ``total``, ``pages`` (1 at least) and ``page_size``. The top ``number * size`` rows are found without sorting the rest.

    With ``text``, what a row shows, the page size is halved until the page's text fits ``most_chars``, or down to one row.
    """
    number, size = whole_number(number, 1, 100_000, "page"), whole_number(size, 25, largest, "page size")
    total = df.agg(F.count("*")).scalar()
    first = df.orderBy(*order).limit(number * size).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    fitting = F.lit(size)
    if text is not None:
        sizes = [size]
        while sizes[-1] > 1:
            sizes.append(sizes[-1] // 2)
        first = first.withColumn("__chars", F.length(text))
        whole = Window.partitionBy()  # the top rows of one page and those before it
        fitting = F.lit(1)
        for s in reversed(sizes[:-1]):
            used = F.sum(F.when((F.col("position") > (number - 1) * s) & (F.col("position") <= number * s), F.col("__chars"))).over(whole)
            fitting = F.when(F.coalesce(used, F.lit(0)) <= most_chars, s).otherwise(fitting)
    placed = first.withColumn("page_size", fitting.cast("int"))
    placed = placed.where((F.col("position") > (number - 1) * F.col("page_size")) & (F.col("position") <= number * F.col("page_size"))).drop("__chars")
    return placed.withColumn("total", total).withColumn("pages", F.greatest(F.ceil(F.col("total") / F.col("page_size")), F.lit(1)).cast("long"))


def page_count(df: DataFrame, size: int = 25) -> DataFrame:
    """``total, pages`` of a paged list in one row, also for an empty one, which has one page."""
    return df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long"))


def neighbours(df: DataFrame, group: list[str], order: list[str], id_col: str) -> DataFrame:
    """Next and previous id of each row in its group, wrapping around once."""
    w, whole = Window.partitionBy(*group).orderBy(*order), Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn("next_id", F.coalesce(F.lead(id_col).over(w), F.first(id_col).over(whole))).withColumn("previous_id", F.coalesce(F.lag(id_col).over(w), F.last(id_col).over(whole)))


def next_unreviewed(df: DataFrame, group: list[str], order: list[str], id_col: str, reviewed: str) -> DataFrame:
    """For each row the next and the previous row of its group that is not reviewed, wrapping around once; null if there is no other."""
    open_ = F.when(~F.col(reviewed), F.col(id_col))
    up = Window.partitionBy(*group).orderBy(*order)
    down = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    whole = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nearest = lambda w: F.last(open_, ignorenulls=True).over(w)
    other = lambda c: F.when(c != F.col(id_col), c)
    found = df.withColumn("next_id", F.coalesce(nearest(down), other(F.first(open_, ignorenulls=True).over(whole))))
    return found.withColumn("previous_id", F.coalesce(nearest(up.rowsBetween(Window.unboundedPreceding, -1)), other(F.last(open_, ignorenulls=True).over(whole))))


def upper_median(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Least, upper median (element n // 2 of the sorted values, from 0) and largest value of each group, without gathering a group.

    Values are counted, and the counts' running sum finds the element.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    running = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    placed = counts.withColumn("upto", F.sum("c").over(running)).withColumn("n", F.sum("c").over(whole))
    return placed.groupBy(*group).agg(F.min(value).alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value))).alias("median"), F.max(value).alias("largest"), F.max("n").alias("n"))
