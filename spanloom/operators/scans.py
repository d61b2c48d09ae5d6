"""Running values along an order inside a key, for keys of any size.

A window over a key is one task. Here a key with more than ``bucket_rows`` rows is cut into ranges of its order (buckets),
windows run inside buckets, and what earlier buckets add up to is carried over their borders, one row a bucket. Small keys
are left whole. Large keys and their buckets are few by construction, so what is known of them is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Rows of a key beyond which it is cut, and about how many buckets all such keys have together at most.
BUCKET_ROWS, _MOST = 1_000_000, 5_000
_BUCKET = "__bucket"

#: For each kind of value its aggregate, and how a bucket's own value and the carried one make the running one.
_KINDS = {
    "sum": (F.sum, lambda own, carried: F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))),
    "max": (F.max, lambda own, carried: F.greatest(own, carried)),
    "min": (F.min, lambda own, carried: F.least(own, carried)),
}


class Scan:
    """Rows of ``df`` dealt by ``keys`` and, in large keys, by ranges of ``at``; :attr:`rows` has them with their bucket.

    ``at`` is a whole number, not null, and differs between the rows of a key. Keys may be null. :meth:`running` can be used
    several times on rows that keep the keys, ``at`` and the bucket: they need no further shuffle.
    """

    def __init__(self, df: DataFrame, keys: list[str], at: str, bucket_rows: int | None = None):
        self.keys, self.at = keys, at
        named = [F.col(k).alias(f"__k_{k}") for k in keys]
        sizes = df.groupBy(*named).agg(F.count("*").alias("__n"))
        total, most = sizes.agg(F.sum("__n"), F.max("__n")).first()
        limit = max(bucket_rows or BUCKET_ROWS, -(-(total or 0) // _MOST))
        self.cut = (most or 0) > limit
        self.rows = self._dealt(df, sizes.where(F.col("__n") > limit), limit, -(-most // limit)) if self.cut else df.withColumn(_BUCKET, F.lit(-1))

    def _same(self) -> Column:
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return condition

    def _dealt(self, df: DataFrame, large: DataFrame, limit: int, parts: int) -> DataFrame:
        names = [f"__k_{k}" for k in self.keys]
        known = df.join(F.broadcast(large), self._same()).groupBy(*names)
        bounds = known.agg(F.max("__n").alias("__n"), F.percentile_approx(F.col(self.at).cast("long"), [i / parts for i in range(1, parts)], 10_000).alias("__bounds"))
        # A key with fewer rows than the largest one keeps only so many of the bounds as it needs.
        share = lambda i: F.floor(i * F.ceil(F.col("__n") / limit) / parts)
        kept = F.array_distinct(F.filter("__bounds", lambda b, i: share(i + 1) > share(i)))
        bounds = stored(bounds.select(*names, kept.alias("__bounds")), "scan-bounds")
        met = df.join(F.broadcast(bounds), self._same(), "left")
        number = F.size(F.filter("__bounds", lambda b: b < F.col(self.at)))
        return met.withColumn(_BUCKET, F.when(F.col("__bounds").isNull(), -1).otherwise(number)).drop("__bounds", *names)

    def running(self, rows: DataFrame, values: dict[str, tuple[str, str]], before: bool = False, reverse: bool = False) -> DataFrame:
        """``rows`` with ``{name: (sum, max or min, column)}`` over all rows of the key up to each one, in the order of ``at``.

        The row itself counts unless ``before``; ``reverse`` runs from the largest ``at`` down. Nulls are passed over: a
        ``max`` or ``min`` of nothing is null, a ``sum`` 0.
        """
        turn = F.desc if reverse else F.asc
        own = Window.partitionBy(*self.keys, _BUCKET).orderBy(turn(self.at)).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        local = rows.select("*", *[_KINDS[kind][0](column).over(own).alias(name) for name, (kind, column) in values.items()])
        if not self.cut:
            return local.fillna(0, [name for name, (kind, _) in values.items() if kind == "sum"])
        names = [f"__k_{k}" for k in self.keys]
        sums = rows.where(F.col(_BUCKET) >= 0).groupBy(*[F.col(k).alias(f"__k_{k}") for k in self.keys], F.col(_BUCKET).alias("__b"))
        sums = sums.agg(*[_KINDS[kind][0](column).alias(f"__c_{name}") for name, (kind, column) in values.items()])
        earlier = Window.partitionBy(*names).orderBy(turn("__b")).rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(*names, "__b", *[_KINDS[kind][0](f"__c_{name}").over(earlier).alias(f"__c_{name}") for name, (kind, _) in values.items()])
        met = local.join(F.broadcast(carried), self._same() & (F.col(_BUCKET) == F.col("__b")), "left")
        return met.select(*rows.columns, *[_KINDS[kind][1](F.col(name), F.col(f"__c_{name}")).alias(name) for name, (kind, _) in values.items()])
