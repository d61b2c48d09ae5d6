"""Importance resampling against SQL, a plain version and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from spanloom.llm import importance, queries
from tests.parity import same

DOCS = "doc_id long, text string, rank string, feature int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, target, longest, buckets, percent, least, seed):
    """doc_id, n_features, weight, score, rank of each row, in plain Python."""

    def features(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for x in docs for f in features(x[1])[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for row in docs:
        words, found = features(row[1])
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()[:8], 16)
        out.append([row[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = k
    return sorted((tuple(x[:5]) for x in out), key=str)


ROWS = [(i, " ".join(f"w{(i * k * k + k) % (7 + i % 5)}" for k in range(3 + i % 40)), "x", i) for i in range(120)]
ROWS += [(200, None, "x", 1), (201, "", None, 1), (202, "?! --\t", "x", 1), (None, "Ärger mit ÄRGER " * 9, "x", 1), (None, None, "x", 1), (203, "Word\x00word ÉÉ 日本語", "x", 1), ROWS[50], ROWS[50], (204, "long " * 30_000 + "tail", "x", 2), (205, "y" * 300 + " w1 w2", "x", 2)]
TARGET = ["w1 w2 w3 w3", None, "W1, w2; unseen", ""]


@pytest.mark.parametrize(("longest", "hot"), [(1, 50_000), (1, 3), (3, 20)])
def test_equals_plain_python(spark, longest, hot):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(3)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    got = importance.resampled(docs, target, longest=longest, buckets=97, hot=hot, percent=30, least_words=5, seed=7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS, TARGET, longest, 97, 30, 5, 7)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame(ROWS[:30], DOCS), spark.createDataFrame([("a",)], "text string")
    assert importance.resampled(docs.limit(0), target).count() == 0
    got = importance.resampled(docs, target.limit(0), buckets=50, percent=100, least_words=1)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS[:30], [], 1, 50, 100, 1, 2024)


def test_query_equals_sql(spark):
    more, fewer = same(spark, "/root/testdata/sf0.001", queries.op11_importance, queries.SQL["op11_importance"])
    assert not more and not fewer
