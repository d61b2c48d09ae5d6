"""Language ID, line dedup, decontamination and quality on small inputs."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontam, langid, linededup, quality, queries, text
from tests.parity import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, l, "s", 0) for i, t, l in rows], DOCS)


def test_word_hashes_follow_words():
    texts = ["The cat, the CAT", "", "é1 x", " \n", "cat"]
    h, starts = text.word_hashes(texts, text.fold_alnum)
    assert starts.tolist() == [0, 4, 4, 6, 6, 7]
    assert h[0] == h[2] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 4


def test_long_texts_are_cut_at_separators(monkeypatch):
    whole = " ".join(random.Random(1).choices(["alpha", "be", "x" * 90, "d"], k=4000))
    want = text.word_hashes([whole, "be"], text.fold_spaced)
    monkeypatch.setattr(text, "PIECE", 64)
    got = text.word_hashes([whole, "be"], text.fold_spaced)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_language_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, good = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 100 and good / n > 0.98


def test_language_edge_cases(spark):
    train = docs(spark, (1, "the cat sat on the mat", "en"), (2, "le chat est ici là", "fr"), (3, None, "en"), (4, "x", None))
    model = langid.fit(train)
    assert model.languages == ("en", "fr")
    odd = spark.createDataFrame([(1, None, "p", 0.5), (2, "", "p", 0.5), (3, "12 !?", "p", 0.5), (4, "the mat " * 90_000, "p", 0.5), (4, "là", "p", 0.5)], "doc_id long, text string, lang_pred string, score double")
    got = langid.predict(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [(r.lang_pred, r.score > 0) for r in got.orderBy("doc_id", F.length("text").desc()).collect()] == [("und", False)] * 3 + [("en", True), ("fr", True)]
    assert langid.predict(train.limit(0), model).count() == 0
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.predict(train, empty).collect()} == {"und"}
    assert langid.keep_known(odd, model).count() == 2


def test_language_ties_and_pieces(monkeypatch):
    both = langid.Block(("aa", "bb"), np.log([0.5, 0.5]), np.zeros((65, 2)))
    assert langid.scored(["xyz"], both, (1, 2, 3))[0].tolist() == ["aa"]
    texts = ["hello wörld, this is a longer text" * 20, "b"]
    count = lambda: [Counter(np.concatenate([b.ravel() for _, _, b, _ in langid.buckets_of([t], 64, (1, 2, 3))]).tolist()) for t in texts]
    whole = count()
    monkeypatch.setattr(langid, "_PIECE", 7)
    for a, b in zip(whole, count(), strict=True):
        assert {k: v for k, v in a.items() if k != 64} == {k: v for k, v in b.items() if k != 64}


def brute_language(train, texts, n_buckets, orders=(1, 2, 3), smoothing=0.5):
    """Multinomial naive Bayes in plain Python: the same n-grams and hashes, one character at a time."""
    def grams(t):
        codes = [ord(c.lower()) if c.isalpha() else 32 for c in t]
        for k in range(len(codes)):
            value = 0
            for n in range(1, max(orders) + 1):
                value = (value * 0x100000001B3 + (codes[k - n + 1] if k - n + 1 >= 0 else 32) + n) % 2**64
                if n in orders:
                    h = value * 0x9E3779B97F4A7C15 % 2**64
                    h ^= h >> 29
                    yield (h * 0xBF58476D1CE4E5B9 % 2**64 >> 33) % n_buckets

    counts, docs = {}, Counter()
    for t, lang in train:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
            docs[lang] += 1
    out = []
    for t in texts:
        if not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        logs = {}
        for lang in sorted(counts):
            total = sum(counts[lang].values()) + smoothing * n_buckets
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(math.log((counts[lang][b] + smoothing) / total) for b in grams(t))
        best = max(logs, key=logs.get)
        out.append((best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


@pytest.mark.parametrize("block", [64, 2, 1])
def test_language_equals_plain_python(spark, block):
    """Also in blocks of languages, which then take a scan each."""
    r = random.Random(8)
    words = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["größe", "haus", "wo"], "cc": ["la", "maison", "où"], "dd": ["ipsum", "haus", "là"], "ee": ["ξένος", "λόγος"]}
    train = [(" ".join(r.choices(words[x], k=r.randint(1, 12))), x) for x in r.choices(list(words), k=60)] + [(None, "aa"), ("lorem", None)]
    texts = [" ".join(r.choices(sum(words.values(), []), k=r.randint(1, 4))) for _ in range(40)] + [None, "", "1 2 -", "HAUS", "q"]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"), n_buckets=512, block=block)
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Score", F.lit("clash"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in langid.predict(data, model).collect()}
    for i, (lang, score) in enumerate(brute_language(train, texts, 512)):
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-9, (i, texts[i])
    kept = {x.doc_id for x in langid.keep_known(data, model).collect()}
    assert kept == {i for i, (_, s) in got.items() if s >= 0.5}


def kept_lines(rows, least):
    lines = [(t or "").split("\n") for t in rows]
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for own in lines for k in {key(x) for x in own} if k)
    return ["\n".join(x for x in own if not (key(x) and seen[key(x)] >= least)) for own in lines]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_line_dedup_equals_brute_force(spark, limit):
    r = random.Random(7)
    pool = ["Menu", " menu\t", "É", "é", "", "   ", "one", "two", "x\x85", "Line " * 400]
    texts = ["\n".join(r.choices(pool, k=r.randint(0, 6))) for _ in range(60)] + [None, "", "menu\nmenu\nmenu"]
    data = spark.createDataFrame([(i if i != 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    got = linededup.deduplicated(data, min_docs=10, broadcast_limit=limit, batches=4, fanout=2)
    want = Counter((i if i != 3 else None, t) for i, t in enumerate(kept_lines(texts, 10)))
    assert Counter((x.doc_id, x.text) for x in got.collect()) == want


def test_line_dedup_repeated_and_empty(spark):
    data = spark.createDataFrame([(1, "same\nline")] * 10, "doc_id long, text string")
    got = linededup.deduplicated(data, min_docs=10).collect()
    assert len(got) == 10 and {(r.text, r.n_lines, r.n_dropped) for r in got} == {("", 2, 2)}
    assert linededup.deduplicated(data.limit(0)).count() == 0
    assert linededup.deduplicated(data, min_docs=10, min_chars=5).where("n_dropped = 0").count() == 10


def test_line_runs_compact_by_level(spark):
    runs = linededup.LineRuns(spark, fanout=2, min_docs=4)
    lines = runs.hashed(spark.createDataFrame([(k, f"a\nb{k}") for k in range(4)] + [(0, "a")], "part int, text string"))
    for k in range(4):
        runs.append(spark.table(lines).where(F.col("part") == k).select("digest", "docs"))
    assert [level for level, _ in runs.runs] == [2]
    assert Counter(r.docs for r in spark.table(runs.runs[0][1]).collect()) == Counter({5: 1, 1: 4})
    assert runs.frequent().count() == 1 and [spark.table(t).count() for t in runs.known] == [0, 0, 1]
    later = runs.without_known(spark.table(runs.runs[0][1]))
    assert later.count() == 4
    names = list(runs.tables)
    runs.delete()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_are_merged_without_exchange(spark):
    """Anti-joins and merges read sorted buckets: the hash table's write holds the only exchange."""
    runs = linededup.LineRuns(spark, fanout=2, min_docs=2)
    lines = runs.hashed(spark.createDataFrame([(k % 3, f"a\nb\nc{k}") for k in range(40)], "part int, text string"))
    for k in range(3):
        runs.append(spark.table(lines).where(F.col("part") == k).select("digest", "docs"))
    assert runs.known
    for df in (runs.without_known(spark.table(lines).where("part = 2").select("digest", "docs")), runs.frequent()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, plan
    assert "SortMergeJoin" in runs.without_known(spark.table(lines).select("digest", "docs"))._jdf.queryExecution().executedPlan().toString()
    runs.delete()


def test_line_dedup_of_long_texts_and_copies(spark):
    """Long texts whole, and copies without ids, on both sides of the broadcast limit."""
    shared = "x" * 300_000
    data = spark.createDataFrame([(None, f"{shared}\nown\n{'y ' * 400_000}")] * 9 + [(1, f"{shared.upper()}\nelse")] + [(None, None)], "doc_id long, text string")
    for limit in (500_000, 0):
        got = linededup.deduplicated(data, min_docs=10, broadcast_limit=limit).collect()
        assert Counter((r.doc_id, len(r.text), r.n_lines, r.n_dropped) for r in got) == Counter({(None, 800_004, 3, 1): 9, (1, 4, 2, 1): 1, (None, 0, 1, 0): 1})


def test_line_dedup_equals_sql(spark):
    more, fewer = same(spark, SF, queries.QUERIES["op9_line_dedup"], queries.SQL["op9_line_dedup"])
    assert not more and not fewer


@pytest.mark.parametrize("masks,lengths", [(decontam.MASKS, [13]), (decontam.SHORT_MASKS, range(5, 13))])
def test_masks_find_every_window(masks, lengths):
    """Whatever words of a window are substituted, as long as 80 % stay, some seed lies on kept words only."""
    for n in lengths:
        for k in range(n * 20 // 100 + 1):
            for bad in combinations(range(n), k):
                assert any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in masks for s in range(n - len(m) + 1)), (n, bad)


def brute_matches(texts, items):
    out = set()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, t in enumerate(texts):
        w = words(t)
        for j, item in enumerate(items):
            v = words(item)
            n = min(13, len(v))
            if (0 < len(v) < 5 and w == v) or len(v) >= 5 and any(sum(a == b for a, b in zip(w[p : p + n], v[q : q + n], strict=False)) * 100 >= 80 * n for p in range(len(w) - n + 1) for q in range(len(v) - n + 1)):
                out.add((i, j))
    return out


@pytest.mark.parametrize("block", [4_000_000, 150])
def test_decontamination_equals_brute_force(spark, block):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(r.choices(vocabulary, k=k)) for k in (3, 5, 6, 9, 12, 13, 14, 30, 40)]
    texts = [None, "", "..."]
    for _ in range(120):
        item = r.choice(items).split()
        part = item[r.randint(0, 3) :][: r.randint(4, 30)]
        part = [x if r.random() > 0.15 else r.choice(vocabulary) for x in part]
        texts.append(", ".join(r.choices(vocabulary, k=r.randint(0, 12)) + part + r.choices(vocabulary, k=r.randint(0, 12))).upper())
    texts += [items[0].upper(), items[0] + " x"]
    texts += [texts[5]] * 2 + [" ".join(r.choices(vocabulary, k=20_000)) + " " + items[-1]]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)) + [(99, None)], "item_id long, text string")
    got = decontam.contaminated(data, bench, block_chars=block)
    want = brute_matches(texts[:-1], items)
    assert {(x.doc_id, x.item_id) for x in got.collect() if x.doc_id < len(texts) - 1} == want and len(want) > 30
    assert got.where(F.col("doc_id") == len(texts) - 1).where("item_id = 8").count() == 1
    flagged = {x.doc_id for x in got.select("doc_id").distinct().collect()}
    assert {x.doc_id for x in decontam.clean(data, bench, block_chars=block).collect()} == set(range(len(texts))) - flagged
    assert decontam.contaminated(data, bench.limit(0)).count() == 0 and decontam.contaminated(data.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [4_000_000, 0])
def test_repeated_items_are_one(spark, block):
    """Ten thousand copies of an item cost as much as one; rows of one id, or without one, are judged by their own text."""
    r = random.Random(13)
    item = " ".join(f"q{r.randint(0, 9)}" for _ in range(60))
    bench = spark.createDataFrame([(i, item if i % 2 else item.upper()) for i in range(5, 10_005)] + [(None, "what is this"), (None, None), (1, "...")], "item_id long, text string")
    long = " ".join(r.choices(["some", "other", "words"], k=1100))
    data = spark.createDataFrame([(1, long + " " + item, "a"), (1, long, "b"), (None, item, "c"), (None, "What is this?", "d"), (2, "what is this thing", "e")], "doc_id long, text string, words string")
    got = decontam.contaminated(data, bench, block_chars=block).collect()
    assert Counter((x.doc_id, x.item_id, x.n_equal, x.doc_word, x.item_word) for x in got) == Counter([(1, 5, 13, 1100, 0), (None, 5, 13, 0, 0), (None, None, 3, 0, 0)])
    kept = decontam.clean(data, bench, block_chars=block)
    assert kept.columns == data.columns and sorted(x.words for x in kept.collect()) == ["b", "e"]
    classes = decontam.item_classes(bench)
    assert classes.count() == 10_001 and {x.representative for x in classes.collect()} == {5, None}


def test_seed_join_equals_broadcast_index(spark):
    """Both sides of the switch give the same rows, places included."""
    r = random.Random(14)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 40)))) for i in range(30)]
    rows = []
    for i in range(80):
        own = " ".join(x if r.random() > 0.1 else "z" for x in r.choice(items)[1].split())
        rows.append((i % 60, " ".join(r.choices(vocabulary, k=r.randint(0, 30))) + " " + own))
    data, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, other = (Counter(tuple(x) for x in decontam.contaminated(data, bench, block_chars=b).collect()) for b in (4_000_000, 0))
    assert one == other and len(one) > 50


def test_kth_largest(spark):
    r = random.Random(5)
    values = [r.choice([r.gauss(0, 1), 0.25, 1e-9 * r.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 250, 499, 500):
        assert quality.kth_largest(df, "v", k, bins=8) == sorted(values, reverse=True)[k - 1]


def brute_ratios(rows, good, smoothing):
    """Summed log-ratio of n-gram models over unhashed features: cased words, word pairs in lower case, punctuation runs."""
    def grams(t):
        words = re.findall(r"[^\W_]+", t or "")
        low = [w.lower() for w in words]
        return [("w", w) for w in words] + [("p", *p) for p in zip(low, low[1:], strict=False)] + [("m", m) for m in re.findall(r"(?:[^\w\s]|_)+", t or "")]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in good:
            target.update(grams(t))
    scale = sum(target.values()) / sum(raw.values())
    return {i: sum(math.log((target[g] + smoothing) / (raw[g] * scale + smoothing)) for g in grams(t)) for i, t in rows}


def test_quality_equals_plain_python(spark):
    """With so many buckets no two of these features meet; kept are the k largest sums of log-ratio and noise."""
    r = random.Random(16)
    pool = ["Apple", "apple", "tree", "green", "Haus", "win$$$", "a,", "über", "-- so", "x_y"]
    rows = [(i, " ".join(r.choices(pool[: 5 + i % 6], k=r.randint(0, 25)))) for i in range(80)] + [(80, None), (81, "tree " * 70_000)]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(0, 80, 2)]
    good = {i for i, q, t in labels if q == 1 and t == 0}
    data, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.resampled(data, marks, share=0.4).collect()}
    want = brute_ratios(rows, good, 10.0)
    for i, v in want.items():
        assert abs(got[i].log_ratio - v) < 1e-6 * max(1, abs(v)), (i, got[i].log_ratio, v)
    noise = {x.doc_id: x.g for x in data.select("doc_id", quality.gumbel(F.col("doc_id"), 29).alias("g")).collect()}
    top = sorted(want, key=lambda i: -(want[i] + noise[i]))[: round(0.4 * len(rows))]
    assert {i for i, x in got.items() if x.kept} == set(top)


def test_inclusion_follows_the_weights(spark):
    """The largest of weight + noise is each of three documents in proportion to the weights 1, 2 and 5; two of three follow too."""
    n = 20_000
    rows = spark.range(3 * n).select(F.floor(F.col("id") / 3).alias("draw"), (F.col("id") % 3).alias("doc"), quality.gumbel(F.col("id"), 5).alias("g"))
    keyed = rows.withColumn("key", F.log(F.when(F.col("doc") == 0, 1.0).when(F.col("doc") == 1, 2.0).otherwise(5.0)) + F.col("g"))
    first = {x.doc: x.n / n for x in keyed.groupBy("draw").agg(F.max_by("doc", "key").alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).collect()}
    last = {x.doc: x.n / n for x in keyed.groupBy("draw").agg(F.min_by("doc", "key").alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).collect()}
    w = [1 / 8, 2 / 8, 5 / 8]
    for i in range(3):
        assert abs(first[i] - w[i]) < 0.015
        out = sum(w[a] * w[b] / (1 - w[a]) for a in range(3) for b in range(3) if len({a, b, i}) == 3)
        assert abs(last[i] - out) < 0.015


def test_quality_keeps_good_and_drops_bad(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choices(["apple", "pear", "the", "of", "tree", "green"], k=60))
    bad = lambda: " ".join(r.choices(["SPAM!!", "click***", "win$$$", "the"], k=60))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)] + [(None, "the tree"), (500, None), (500, None), (501, "")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)], "doc_id long, quality int, toxic int")
    data = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    got = quality.resampled(data, labels, share=0.7)
    by = {r_.doc_id: r_ for r_ in got.where("doc_id < 200").collect()}
    assert got.count() == len(rows)
    assert sum(by[i].kept for i in range(200) if i % 4 == 0) == 0
    assert sum(by[i].kept for i in range(200) if i % 4) >= 130
    assert {r_.log_ratio for r_ in got.where("doc_id IN (500, 501)").collect()} == {0.0}
    again = {r_.doc_id: r_.kept for r_ in quality.resampled(data, labels, share=0.7).where("doc_id < 200").collect()}
    assert again == {i: x.kept for i, x in by.items()}
    assert quality.resampled(data.limit(0), labels).count() == 0
    assert quality.resampled(data, labels.limit(0)).where("NOT kept").count() == 0


def test_quality_query_ranks_toxic_below_clean(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    clean, toxic, junk = got[(got.quality == 1) & (got.toxic == 0)], got[got.toxic == 1], got[got.quality == 0]
    assert clean.kept.mean() > 0.95 and junk.kept.mean() < 0.05 and toxic.kept.mean() < 0.7


def test_digest_column(spark):
    data = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    got = linededup.deduplicated(data).mapInArrow(linededup.digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").first()
    assert got.kept_sha256 == hashlib.sha256(b"a\nb").hexdigest()
