"""The pipeline on a small corpus, held against a version in plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_tables import brute_components, waterfill
from tests.llm.test_text_operators import brute_matches

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = {"en": ["the", "house", "with", "shining", "windows", "stood", "where", "rivers", "meet", "and", "they", "which"], "de": ["das", "haus", "mit", "hellen", "fenstern", "stand", "wo", "flüsse", "sich", "treffen", "und", "größe"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with copies, near copies, leaks, junk and odd rows, and the benchmark and labels they go with."""
    r = random.Random(21)
    write = lambda n, lang: " ".join(f"{r.choice(VOCABULARY[lang])}{r.choice(['', '', 'a', 'en', 'o'])}" for _ in range(n))
    items = [" ".join(f"q{r.randint(0, 500)}" for _ in range(25)) for _ in range(4)]
    rows, leaks = [], set()
    for i in range(160):
        lang = r.choice(["en", "de"])
        text = write(r.randint(20, 120), lang)
        if i % 10 == 0:
            words = items[i % 4].split()
            words[3] = words[17] = "other"
            text, _ = text + " " + " ".join(words), leaks.add(i)
        rows.append((i, text, lang, r.choice(["a", "b", "c", None])))
    for i in range(160, 200):
        base = rows[r.randint(0, 159)]
        words = base[1].split()
        if i % 2:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), base[2], r.choice(["a", "b", "c", None])))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, "123 --- 456", None, "b"), (903, "the house and they " * 3_000, "en", "c"), rows[1]]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 200, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, items


def staged(spark, folder):
    """Rows after each stage, as the pipeline hands them on."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"test-{name}")
        out.append(docs)
    return out


def test_stages_equal_plain_python(spark, corpus):
    folder, rows, items = corpus
    language, copies, clean, mix, shard = staged(spark, folder)
    for df in (language, copies, clean, mix):
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    known = [x for x in rows if re.search(r"[^\W\d_]", x[1] or "")]
    assert Counter(x.doc_id for x in language.collect()) == Counter(x[0] for x in known)

    groups = brute_components([(x[0], x[1]) for x in known], 5)
    kept = {i for i, (_, _, keep) in groups.items() if keep}
    assert Counter(x.doc_id for x in copies.collect()) == Counter(kept) and len(kept) < len(groups)

    left = [x for x in dict((x[0], x) for x in known).values() if x[0] in kept]
    bad = {left[i][0] for i, _ in brute_matches([x[1] for x in left], items)}
    left = [x for x in left if x[0] not in bad]
    assert Counter(x.doc_id for x in clean.collect()) == Counter(x[0] for x in left) and len(bad) > 5

    size = {x[0]: len(x[1].split()) for x in left}
    sizes, taken = defaultdict(int), defaultdict(int)
    for x in left:
        sizes[x[3]] += size[x[0]]
    for x in mix.collect():
        assert x.text == next(y[1] for y in left if y[0] == x.doc_id)
        taken[x.source] += size[x.doc_id]
    for source, target in waterfill(sizes, (3.0, 1.0, 2.0), 1.5, 2.0).items():
        largest = max(size[x[0]] for x in left if x[3] == source)
        assert abs(taken[source] - target) <= largest / 2 + 1
    assert max(Counter(x.doc_id for x in mix.collect()).values()) <= 2

    assert Counter((x.doc_id, x.n_chars) for x in shard.collect()) == Counter((x.doc_id, len(x.text)) for x in mix.collect())


def test_run_is_the_stages_in_turn(spark, corpus):
    folder, *_ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert Counter(x.doc_id for x in got.collect()) == Counter(x.doc_id for x in staged(spark, folder)[-1].collect())


def test_empty_documents(spark, corpus, tmp_path):
    folder, *_ = corpus
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_pass_through(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("kept", F.lit(True))
    docs = docs.withColumn("run", F.lit("r")).withColumn("Shard", F.lit("s")).withColumn("version", F.lit(0))
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns[-6:] == ["score", "size", "kept", "run", "Shard", "version"]
    docs = corpus_pipeline.written(docs, "test-extra")
    out = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert out.columns == ["doc_id", "run", "shard", "version", "n_chars"] and out.count() == docs.count() > 0


def test_rows_without_ids_and_repeated_ids(spark, corpus):
    """Every row is its own document: two texts under one id both go through, and so do rows without an id."""
    folder, rows, _ = corpus
    clean = [x for i, x in enumerate(rows[:160]) if i % 10]
    odd = [(7 if i % 2 else None, x[1], x[2], "z", len(x[1])) for i, x in enumerate(clean[:30])]
    docs = spark.createDataFrame(odd + odd[:4], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), f"odd-{name}")
    assert Counter((x.doc_id, x.text) for x in docs.collect()) == Counter((x[0], x[1]) for x in odd)
    mixed = corpus_pipeline.written(corpus_pipeline.mix(spark, docs, folder), "odd-mix")
    size = sum(len(x[1].split()) for x in odd)
    assert abs(mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] - 1.5 * size) <= 60
    assert corpus_pipeline.shard(spark, mixed, folder).count() == mixed.count()


