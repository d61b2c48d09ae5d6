"""What tasks hold at once: batches for Python, row groups of stored tables."""

from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import shards
from spanloom.llm.scratch import written

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def noise(spark, rows, kilobytes):
    """One task's rows of texts that don't shrink to nothing."""
    return spark.range(0, rows, 1, 1).select("id", F.concat_ws("", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8 * kilobytes)]).alias("text"))


def row_groups(df):
    """Bytes of each row group of a stored table."""
    files = [pq.ParquetFile(urlparse(f).path).metadata for f in df.inputFiles()]
    return [m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)]


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontaminate"])
def test_texts_reach_python_in_small_batches(spark, tmp_path, name):
    """A task's texts used to be one batch of up to 64 MB, held several times over by the JVM and by Python."""

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes], pa.int64())], ["n"])

    spark.createDataFrame([(1, "a passage of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "some words of a text", "en", "a", 20)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.conf.unset(BATCH)
    try:
        dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect()
        found = [r.n for r in noise(spark, 6_000, 4).mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(BATCH)
    assert sum(found) > 24_000_000 and max(found) < 5_000_000


def test_stored_tables_have_small_row_groups(spark):
    """A writer gathers a row group in memory and a reader loads one; they used to be as large as a file."""
    table = written(noise(spark, 24_000, 2), "row-groups")
    assert sum(row_groups(table)) > 45_000_000 and max(row_groups(table)) < 24_000_000
    assert table.count() == 24_000


def test_stores_have_small_row_groups(spark, tmp_path):
    """Appended runs and the compacted one: a compaction used to gather a whole shard in memory."""
    docs = noise(spark, 24_000, 2).withColumnRenamed("id", "doc_id")
    whole = shards.ShardStore(spark, f"{tmp_path}/whole")
    whole.append(docs)
    assert max(row_groups(whole.read())) < 24_000_000
    one = shards.ShardStore(spark, f"{tmp_path}/one")
    one.append_arrivals(docs.withColumn("part", F.lit(1)), "part")
    assert max(row_groups(one.read())) < 24_000_000
    store = shards.sharded(docs, f"{tmp_path}/dealt", arrivals=4)
    assert len(store.read().inputFiles()) == 1 and max(row_groups(store.read())) < 24_000_000
    assert store.read().select("doc_id", "text").exceptAll(docs).isEmpty() and store.read().count() == 24_000
