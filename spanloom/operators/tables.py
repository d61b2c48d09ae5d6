"""Tables in the folder that driver and executors share, for cutting the lineage of iterative operators.

A lost executor then costs a reread, not a recomputation from the start. The folder is ``spark.checkpoint.dir`` of the
session; only a session with an in-process master, as in tests, may do without the setting and gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
#: Writer options. A row group of 16 MB instead of 128 MB is what a writer gathers, and a reader loads, at once.
ROW_GROUPS = {"parquet.block.size": str(16 << 20)}
#: Spark's own setting: a query's shuffle files go when it ends, not when the driver's collector finds that nothing needs them.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get(SETTING, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set(SETTING, base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call returns."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a write drops its shuffle files at its end: what it wrote is read from then on, so disk holds the shuffles of one step only."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: the same rows without their lineage."""
    path = new_folder(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.write.options(**ROW_GROUPS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_count(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """:func:`stored`, and how many rows meet a condition, counted while they are written: no further job."""
    seen = Observation()
    path = new_folder(df.sparkSession, name)
    with _shuffles_dropped(df.sparkSession):
        df.observe(seen, F.count_if(condition).alias("n")).write.options(**ROW_GROUPS).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get.get("n") or 0


def swept(spark: SparkSession) -> int:
    """Deletes every folder that :func:`new_folder` named in this process and that is still there; returns how many.

    Results are read lazily from such folders, so this is for a caller who has taken all results out of them.
    """
    found = 0
    while _MADE:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        found += target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    return found


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this module's making, through the Hadoop file system that holds it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Deletes the folder that :func:`stored` made for ``df``, once nothing reads it any more."""
    files = df.inputFiles()
    if files:
        drop(df.sparkSession, files[0].rsplit("/", 1)[0])
