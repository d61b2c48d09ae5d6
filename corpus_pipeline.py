"""A training corpus from raw documents: language, copies, benchmark leaks, source mix, shards.

Each stage takes ``(spark, docs, sf_dir)``; :func:`run` writes its result as Parquet and hands what is read back to the next
stage. All stages but the last return the columns of ``documents``, and other columns that come with them, whatever their
names. Null texts and texts without letters go in the first stage; repeated rows are one document from the second on; null
ids, empty tables and very long texts pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, minhash, mixing, shards
from spanloom.llm.scratch import new_folder, written

#: Bytes of an Arrow batch. Spark's own 64 MB put a whole task's texts into one batch: in the JVM and in Python, in and out.
BATCH_BYTES = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Bounds the batches that this session's tasks exchange with Python, while the stage's lazy result is written too."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: null, empty, without letters, or with a posterior under one half, they go."""
    _small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): each row by its own text, the smallest id stays."""
    _small_batches(spark)
    return minhash.deduplicated(docs, words=5, percent=80, folding="spaced")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are judged by their text alone."""
    _small_batches(spark)
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their shares: a document is repeated for each epoch that takes it, and goes if the mix takes none of it.

    Rows are judged one by one, also where ids repeat or are missing; documents without words go.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    content = F.when(F.col("doc_id").isNull(), mixing.content_key(F.col("text")))
    counted = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), content.alias("content"))
    cuts = mixing.cutoffs(mixing.labelled(counted, labels), size_col="size", weight_col="weight", content_col="content")
    return mixing.materialised(mixing.labelled(docs, labels, name="__weight"), cuts, weight_col="__weight").drop("__weight")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A compacted store of the corpus, of every row as it is; returns where each lies: ``doc_id, run, shard, version, n_chars``."""
    store = shards.sharded(docs, new_folder(spark, "corpus"))
    run, number, version = store.own_columns(docs.columns)
    return store.read().select("doc_id", F.col(run).alias("run"), F.col(number).alias("shard"), F.col(version).alias("version"), F.length("text").cast("long").alias("n_chars"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Naive Bayes and MinHash stages have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
