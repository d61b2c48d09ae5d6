"""Chat formatting, URL filters, sharding, MinHash, mixing and nearest neighbours on small inputs."""

import hashlib
import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import ann, chat, minhash, mixing, queries, shards, urls
from spanloom.llm.scratch import new_folder
from tests.parity import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_url_filter", "op6_minhash", "op7_mix_sources"])
def test_query_equals_sql(spark, name):
    more, fewer = same(spark, SF, queries.QUERIES[name], queries.SQL[name])
    assert not more and not fewer, (list(more)[:2], list(fewer)[:2])


# --- chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE:", "\\", "\\-", "[", "<", "/INST]", "é😀", " ", "\n", "[ROLE:x] ", "ok"]


def test_escape_is_reversible():
    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choices(PIECES, k=r.randint(0, 8)))
        e = chat.INSTRUCT.escaped(s)
        assert chat.INSTRUCT.unescape(e) == s
        assert not any(c in e for c in chat.INSTRUCT.controls)


def test_chat_round_trip(spark):
    r = random.Random(4)
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "system", "tool", None, "[ROLE:", "x] </s>"])
            rows.append((conv, r.choice([turn, 1, None]), role, r.choice([None, "".join(r.choices(PIECES, k=6))]), "extra"))
    rows += [rows[0]] * 2
    rows.append((7, 99, "assistant", "long " * 50_000, "extra"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos string")
    got = {x.conv_id: x for x in chat.read_back(chat.formatted(df)).collect()}
    by = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        spoken = [(role, text) for _, _, role, text in turns]
        assert got[conv].n_turns == len(spoken)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in spoken).encode()).hexdigest()
        loss = "".join(b for a, b in spoken if a == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {x.conv_id: tuple(x) for x in chat.read_back(chat.formatted(df), in_order=True).collect()} == {k: tuple(v) for k, v in got.items()}
    assert chat.read_back(chat.formatted(df.limit(0))).count() == 0


def test_turn_order(spark):
    talk = [(1, 0, "system"), (1, 1, "user"), (1, 2, "assistant"), (2, 0, "assistant"), (3, 0, "user"), (3, 1, "user"), (4, 0, "user"), (4, 1, "assistant"), (4, 2, "tool"), (5, 0, "system"), (6, 0, "system"), (6, 1, "user")]
    df = spark.createDataFrame([(*x, "t") for x in talk], "conv_id long, turn long, role string, text string")
    want = {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}  # 5 ends in a state that is not final
    assert {x.conv_id: x.valid for x in chat.read_back(chat.formatted(df)).collect()} == want
    assert {x.conv_id: x.valid for x in chat.read_back(chat.formatted(df), in_order=True).collect()} == want


# --- urls


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    fits = [(-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.c.example.com", "/d", "allow"), ("", "", "allow")]
URLS = [None, "", "no scheme", "http://", "HTTP://A.Net/x", "x://net", "x://net/", "http://example.net/en/1", "http://m.EXAMPLE.net/en/", "http://example.net/en", "http://example.com/de/?q", "http://notexample.com/de/",
        "http://x.org/fr/a#b", "http://x.org?/fr/", "http://a://b.net/", "http://É.net/É", "http://a.b.c.example.com/de/f", "http://net\n/x", "http://net/\nx", "http://" + "a." * 3000 + "net/" + "y" * 20_000]


@pytest.mark.parametrize("blocks,limit", [(1, 10_000), (1 << 16, 0)])
def test_urls_equal_brute_force(spark, monkeypatch, blocks, limit):
    monkeypatch.setattr(urls, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", limit)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES + RULES[:2], "host string, path string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urls.judged(pages, rules).collect()}
    assert got == {i: brute_verdict(u, RULES) for i, u in enumerate(URLS + URLS)}
    assert urls.judged(pages.limit(0), rules).count() == 0
    assert {x.verdict for x in urls.judged(pages, rules.limit(0)).collect()} == {"allow"}


# --- shards


def test_shards_round_trip(spark):
    rows = [(i % 40 if i % 7 else None, "x" * (i % 50), i) for i in range(300)] + [(1, None, 0), (1, "y" * 500_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    store = shards.sharded(df, new_folder(spark, "test"), target_bytes=8_000)
    back = store.read()
    assert Counter((r.doc_id, r.text, r.extra) for r in back.collect()) == Counter(rows)
    state = store.manifest()
    assert state["version"] == max(store.versions()) and len(state["runs"]) < 8
    assert store.vacuum() == 0 and store.vacuum(min_age_s=0) <= 1 and Counter(r.doc_id for r in store.read().collect()) == Counter(r[0] for r in rows)
    clash = shards.sharded(df.withColumnRenamed("extra", "Run").withColumn("_run", F.lit(1)).withColumn("version", F.lit("v")), new_folder(spark, "test")).read()
    assert clash.columns == ["doc_id", "text", "Run", "_run", "version", "__run", "shard", "_version"] and clash.select("Run", "__run").count() == len(rows)
    empty = shards.sharded(df.limit(0), new_folder(spark, "test"))
    assert empty.read().count() == 0 and "run" in empty.read().columns


def test_tiers_merge_similar_runs_only(spark):
    store = shards.ShardStore(spark, new_folder(spark, "tiers"), target_bytes=1 << 30, fanout=3)
    small = spark.createDataFrame([(1, "a")], "doc_id long, text string").coalesce(1)
    big = spark.createDataFrame([(i, hashlib.sha256(str(i).encode()).hexdigest() * 9) for i in range(3000)], "doc_id long, text string").coalesce(1)
    for df in (small, small, big):
        store.append(df)
    assert len(store.compact()["runs"]) == 3  # two small ones are too few, the big one is another tier
    store.append(small)
    after = store.compact()
    assert len(after["runs"]) == 2 and store.read().count() == 3003


def test_versions_before_a_compaction_stay_until_vacuum(spark):
    store = shards.ShardStore(spark, new_folder(spark, "store"), fanout=2)
    for k in range(2):
        store.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    opened = store.read(2)
    assert store.compact()["version"] == 3
    assert opened.count() == 20 and store.read(1).count() == 10
    assert store.vacuum(keep=3, min_age_s=0) == 0 and store.read(1).count() == 10
    assert store.vacuum() == 0 and store.vacuum(min_age_s=0) == 2 and store.read().count() == 20


def test_compaction_takes_the_earlier_of_equal_runs(spark):
    """Names of folders are random; the numbers of runs do not follow them."""
    seen = set()
    for _ in range(3):
        store = shards.ShardStore(spark, new_folder(spark, "equal"), fanout=3, similar=1.0)
        for k in range(5):
            store.append(spark.createDataFrame([(k, "a")], "doc_id int, text string").coalesce(1))
        store.compact()
        seen.add(tuple(sorted((r.run, r.doc_id) for r in store.read().collect())))
    assert len(seen) == 1


def test_a_taken_version_is_an_error(spark):
    store = shards.ShardStore(spark, new_folder(spark, "race"))
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    base = store.manifest()
    store.append(df)
    with pytest.raises(Exception, match="exist"):
        store._commit(base, [], df.schema.json())
    assert store.versions() == [1] and json.dumps(store.manifest()["runs"])


# --- MinHash


def brute_components(texts, words):
    sets = {}
    for i, t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_copies(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    bases = [r.choices(vocabulary, k=r.choice([1, 3, 5, 30, 80, 200])) for _ in range(6)]
    out = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two")]
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [400_000, 2_000])
def test_minhash_equals_brute_force(spark, block):
    texts = near_copies(9)
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, id string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(df, words=4, folding="spaced", block_shingles=block).collect()}
    assert got == brute_components(texts, 4)


def test_minhash_repeated_ids_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = Counter((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(df, words=4, folding="spaced").collect())
    assert got == Counter({(1, 1, True): 2, (None, 1, False): 1, (2, 1, False): 1, (None, None, True): 1})
    assert Counter(x.doc_id for x in minhash.deduplicated(df, words=4, folding="spaced").collect()) == Counter({1: 1, None: 1})
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.deduplicated(df.limit(0)).count() == 0


def test_minhash_judges_every_row_by_its_own_text(spark):
    """Ids that repeat with different texts, and rows without ids, lose no link."""
    word = lambda k, n=40: " ".join(f"t{k}x{i}" for i in range(n))
    near = lambda k: word(k, 39) + " other"
    rows = [(5, word(1)), (5, word(2)), (7, near(1)), (8, near(2)), (None, word(3)), (None, near(3)), (None, word(4)), (9, word(5) * 3_000), (None, ""), (None, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, __text string").withColumnRenamed("__text", "best")
    got = minhash.near_duplicates(df)
    assert Counter((x.doc_id, x.component_id, x.kept) for x in got.collect()) == Counter([(5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False), (None, None, True), (None, None, False), (None, None, True), (9, 9, True), (None, None, True), (None, None, True)])
    left = minhash.deduplicated(df).collect()
    texts = Counter(x.text for x in left)
    assert len(left) == 7 and texts[word(1)] == texts[word(2)] == texts[word(4)] == 1 and texts[word(3)] + texts[near(3)] == 1 and texts[""] == 2
    assert minhash.deduplicated(df).columns == df.columns


def test_minhash_large_group_of_near_copies(spark):
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        own = list(base)
        own[r.randrange(120)] = f"z{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows + [(1000 + i, rows[0][1]) for i in range(400)], "doc_id long, text string")
    for block in (400_000, 9_000):
        got = minhash.near_duplicates(df, block_shingles=block).collect()
        assert len(got) == 1000 and {x.component_id for x in got} == {0}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], r.integers(0, 1 << 63, 100).astype(np.uint64)))
    sig = minhash.signatures(np.concatenate((a, b)), np.array([0, 400, 800]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    long = r.integers(0, 1 << 63, 100_000).astype(np.uint64)  # over several blocks
    both = minhash.signatures(np.concatenate((a, long)), np.array([0, 400, 100_400]), 8)
    assert (both[1] == minhash.signatures(long, np.array([0, 100_000]), 8)[0]).all()


# --- mixing


def waterfill(sizes, weights, share, ceiling):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[n] for n in free)
        over = {n for n in free if level * w[n] > ceiling * sizes[n]}
        if not over:
            return target | {n: level * w[n] for n in free}
        for n in over:
            target[n] = ceiling * sizes[n]
            left -= target[n]
        free -= over
    return target


@pytest.mark.parametrize("slices", [1024, 1])
def test_mix_meets_targets(spark, slices):
    r = random.Random(12)
    rows = [(i, r.choice(["a", "b", "c", "é", "Z", None]), " ".join(["w"] * r.randint(0, 30))) for i in range(400)]
    rows += [(1000 + i, "tiny", "x y") for i in range(2)] + [(2000, "b", None), (2001, "b", " \n "), (None, "a", "n n n"), (5, "a", "dup dup"), (5, "a", "dup dup"), (3000, "void", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("w", (F.col("doc_id") % 3).cast("double"))
    got = mixing.mixed(df, weight_col="w", slices=slices).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for x in got:
        sizes[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert x.taken in (x.size * k for k in range(3))
        if x.target >= x.source_size:
            assert x.taken >= x.size  # complete epochs come first
    want = waterfill(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    for s, v in want.items():
        assert math.isclose(target[s], v, rel_tol=1e-9) and abs(taken[s] - v) <= 16
    assert Counter((x.doc_id, x.size, x.taken) for x in got) == Counter((x.doc_id, x.size, x.taken) for x in mixing.mixed(df, weight_col="w", slices=1024).collect())


def test_mix_prefers_quality_and_materialises(spark):
    df = spark.createDataFrame([(i, s, "a b c", float(1 + 9 * (i % 2))) for i in range(200) for s in ("p", "q", "r")], "doc_id long, source string, text string, w double").withColumn("doc_id", F.col("doc_id") * 3 + F.when(F.col("source") == "p", 0).when(F.col("source") == "q", 1).otherwise(2))
    mix = mixing.mixed(df, weight_col="w", share=0.5)
    chosen = mix.join(df.select("doc_id", "w"), "doc_id").where("taken > 0").groupBy("w").count().collect()
    n = {r.w: r["count"] for r in chosen}
    assert n[10.0] > 2 * n[1.0]
    out = mixing.materialised(df, mixing.cutoffs(df, weight_col="w"), weight_col="w")
    assert out.columns == df.columns and out.count() * 3 == mixing.mixed(df, weight_col="w").agg(F.sum("taken")).first()[0]
    assert mixing.mixed(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_materialised_rows_are_those_of_the_mix(spark, monkeypatch, most):
    """Row by row, also for repeated ids with other texts, rows without an id, ties and long texts; both sides of the broadcast bounds."""
    monkeypatch.setattr(mixing, "MAX_LABELS", most)
    monkeypatch.setattr(mixing, "MAX_SOURCES", most)
    r = random.Random(31)
    rows = [(i % 150, r.choice(["a", "b", None]), " ".join(r.choices(["x", "y", "zz"], k=r.randint(0, 12)))) for i in range(300)]
    rows += [(None, r.choice(["a", "c"]), " ".join(r.choices(["x", "y", "zz"], k=r.randint(1, 12)))) for _ in range(100)] + [(None, "c", "same text")] * 25 + [(4, "d", "twin")] * 7
    rows += [(900, "a", "long " * 60_000), (901, "b", None), (902, None, " \n")]
    df = spark.createDataFrame([(*x, "clash", n) for n, x in enumerate(rows)], "doc_id long, source string, text string, size string, n int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150, 4)] + [(None, 1), (0, 1)], "doc_id long, quality int")
    weighted = mixing.labelled(df, labels, name="__w")
    want = Counter()
    for x in mixing.mixed(weighted, weight_col="__w").collect():
        if x.size:
            want[x.doc_id, x.source, x.size] += x.taken // x.size
    out = mixing.materialised(weighted, mixing.cutoffs(weighted, weight_col="__w"), weight_col="__w").drop("__w")
    assert out.columns == df.columns
    got = Counter((x.doc_id, x.source, len(x.text.split())) for x in out.collect())
    assert got == +want and len(got) > 150
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, source, text in rows:
        sizes[source] += len((text or "").split())
    for (_, source, size), n in got.items():
        taken[source] += size * n
    for source, target in waterfill(sizes, (3.0, 1.0, 2.0), 1.5, 2.0).items():
        assert abs(taken[source] - target) <= (30_001 if source == "a" else 7)
    assert mixing.materialised(df.limit(0), mixing.cutoffs(df.limit(0))).count() == 0


# --- nearest neighbours


def test_pigeonhole_finds_every_code_in_the_radius():
    r = np.random.default_rng(2)
    for bits in (64, 20, 5):
        codes = r.integers(0, 1 << min(bits, 63), 700).astype(np.uint64)
        index = ann.MultiIndex(codes, bits)
        for radius in (0, 1, 3, 7, 12, bits):
            q = codes[5] ^ np.uint64(3)
            assert index.within(q, radius).tolist() == np.flatnonzero(np.bitwise_count(codes ^ q) <= radius).tolist()


def brute_nearest(vectors, k):
    ok = {i: np.array(v, float) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in ok.items():
        scored = sorted((-(v @ x) / (np.linalg.norm(v) * np.linalg.norm(x)), i) for i, x in ok.items() if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("chunk", [32 << 20, 4_000])
def test_nearest_on_odd_vectors(spark, chunk):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(60)]
    rows += [(100, None), (101, [0.0] * 8), (102, [None] + [1.0] * 7), (103, [float("nan")] * 8), (104, [float("inf")] + [0.0] * 7), (105, [1.0, 2.0]), (201, [2.0, 1.0]), (202, [2.0, 1.0]), (None, [1.0] * 8), (106, rows[3][1]), (107, rows[3][1])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, vector string")
    got = defaultdict(list)
    for x in ann.nearest(df, df, block=30, chunk_bytes=chunk, least_sample=20).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert [i for _, i, _ in got.pop(105)] == [201, 202]  # vectors of another length are searched apart
    assert [i for _, i, _ in got.pop(201)] == [202, 105] and [i for _, i, _ in got.pop(202)] == [201, 105]
    want = brute_nearest([x for x in rows if x[0] not in (105, 201, 202)], 5)
    assert set(got) == set(want)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (5 * len(want)) >= 0.95
    assert [i for _, i, _ in got[3]][:2] == [106, 107] and all([n for n, _, _ in v] == [1, 2, 3, 4, 5] for v in got.values())
    few = ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 1"))
    assert few.count() == 2
    assert ann.nearest(df.where("vec_id = 101"), df).count() == 0 and ann.nearest(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("d", [33, 64, 257])
def test_ties_of_equal_vectors_go_to_the_smaller_id(spark, d):
    r = np.random.default_rng(d)
    rows = [(i, r.normal(size=d).tolist()) for i in range(400)]
    for base in range(0, 40):  # forty groups of copies, their ids all over the table
        rows += [(1000 + 41 * base + 97 * n, rows[base][1]) for n in r.permutation(12).tolist()]
    rows = list(dict(rows).items())
    order = r.permutation(len(rows))
    df = spark.createDataFrame([rows[i] for i in order], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for x in ann.nearest(df, df, block=150, least_sample=50).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    own = dict(rows)
    for q, v in got.items():
        same = sorted(i for i, w in rows if w == own[q] and i != q)[:5]
        assert [i for i, _ in v[: len(same)]] == same
        assert len({s for i, s in v[: len(same)]}) <= 1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([v for _, v in vectors], float)
    ids = np.array([i for i, _ in vectors])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = defaultdict(set)
    for r in queries.op10_nearest(spark, sf).collect():
        found[r.query_id].add(r.vec_id)
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -2
        hits += len(found[ids[q]] & set(ids[np.argsort(-s)[:5]].tolist()))
        n += 5
    assert hits / n >= 0.9
