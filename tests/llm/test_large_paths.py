"""The ways that only large inputs take, at a size at which they matter."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ann, decontam, langid
from spanloom.llm.bitmap import bitmap

ROOT = str(Path(__file__).resolve().parent.parent.parent)


@pytest.mark.parametrize("bits", [64, 1 << 20, (1 << 21) + 24])
def test_bitmap(spark, bits):
    places = sorted({(i * i * 7919 + i) % bits for i in range(5000)} | {0, bits - 1})
    df = spark.createDataFrame([(p,) for p in places + places[:9]], "p long")
    held = bitmap(df, F.col("p"), bits)
    assert len(held) == bits // 8 and np.flatnonzero(np.unpackbits(held, bitorder="little")).tolist() == places


_FULL = """
from pyspark.sql import SparkSession, functions as F
from spanloom.llm.bitmap import bitmap
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "750m").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
held = bitmap(spark.range(1 << 24), F.col("id") * 8 + 3, 1 << 27)
print("set", int((held == 8).sum()))
"""


def test_sixteen_million_bytes_with_a_small_driver():
    """Every byte of the map is set, with the driver's heap that a cluster may have."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", _FULL], env=env, capture_output=True, text=True, timeout=600)
    assert f"set {1 << 24}" in done.stdout, done.stderr[-2000:]


def test_any_window_gives_the_same_rows_both_ways(spark):
    words = [f"w{i}" for i in range(60)]
    bench = spark.createDataFrame([(1, " ".join(words[:40])), (2, " ".join(words[30:45]))], "item_id long, text string")
    texts = [" ".join(["lead"] * 7 + words[5:30] + ["tail"]), " ".join(words[:19]), " ".join(w if i % 9 else "odd" for i, w in enumerate(words[3:35])), " ".join(words[30:45])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for window in (13, 20, 31):
        one, other = (Counter(tuple(x) for x in decontam.contaminated(docs, bench, window=window, block_chars=b).collect()) for b in (4_000_000, 0))
        assert one == other and one


def test_rare_vector_lengths_are_indexed(spark):
    """Three hundred short vectors beside five thousand long ones: each length has its own sample and index."""
    r = np.random.default_rng(4)
    rows = [(i, r.normal(size=8 if i < 300 else 4).tolist()) for i in range(5300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fitted = []
    learned = ann.learned
    try:
        ann.learned = lambda x, **k: fitted.append(x.shape) or learned(x, **k)
        got = ann.nearest(df, df.where("vec_id IN (7, 400)"), sample=1000).collect()
    finally:
        ann.learned = learned
    assert sorted(fitted) == [(300, 8), (1000, 4)] and len(got) == 10


def test_more_languages_than_a_task_holds(spark):
    """Two thousand languages, each with letters of its own; the counts are those of a task that holds all of them."""
    rows = [(chr(0x4E00 + i % 2000) * 3 + " x", f"l{i % 2000}") for i in range(6000)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    model = langid.fit(df)
    assert len(model.languages) == 2000
    counts = {(x.lang, x.bucket): x.n for x in model.counts.where("lang = 'l5'").collect()}
    assert counts["l5", -1] == 3
    held = langid._HELD
    try:
        langid._HELD = 10_000
        assert {(x.lang, x.bucket): x.n for x in langid.fit(df).counts.where("lang = 'l5'").collect()} == counts
    finally:
        langid._HELD = held


def test_a_list_of_many_rules(spark):
    """Two hundred thousand rules of many lengths below many hosts, past the broadcast; extra columns; a very long url."""
    from spanloom.llm import urls

    rules = spark.range(200_000).select(F.concat(F.lit("h"), (F.col("id") % 50_000).cast("string"), F.lit(".example")).alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("p"), (F.col("id") % 40).cast("int")), F.lit("/"), F.floor(F.col("id") / 50_000).cast("string")).alias("path"), F.when(F.col("id") % 2 == 0, "block").otherwise("allow").alias("verdict"), F.lit(1).alias("url"))
    pages = [(1, "https://a.h7.example/ppppppp/0/x"), (2, "https://h7.example/pppppppppppppppppppppppppppp/2"), (3, "https://h7.example/q"), (4, "http://xh7.example/ppppppp/0"), (5, None), (6, "https://h8.example/pppppppp/0" + "/y" * 100_000), (7, "https://h8.EXAMPLE/pppppppp/0?x")]
    got = {x.page_id: (x.rule and x.rule[:12], x.verdict) for x in urls.judged(spark.createDataFrame([(*p, "v") for p in pages], "page_id long, url string, verdict string"), rules).collect()}
    assert got == {1: ("h7.example/p", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("h8.example/p", "block"), 7: ("h8.example/p", "block")}
    assert spark.range(1).count() == 1 and urls.judged(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
