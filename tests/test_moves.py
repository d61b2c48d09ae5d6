"""Moves against brute force on small random inputs."""

import random

from spanloom.plans.set_queries import q13_moves


def expected(docs):
    words = {i: frozenset(t.split()) for i, t, _ in docs}
    lang, taken, out, used = {i: g for i, _, g in docs}, set(), [], set()
    for key in {(words[i], lang[i]) for i in words if words[i]}:
        own = sorted(i for i in words if (words[i], lang[i]) == key)
        for a, b in zip([i for i in own if i % 2], [i for i in own if i % 2 == 0], strict=False):
            out.append((lang[a], a, b, len(words[a]), len(words[a])))
            used |= {a, b}
    for a in sorted(i for i in words if i % 2 and i not in used and words[i]):
        best = None
        for b in sorted(i for i in words if i % 2 == 0 and i not in used | taken and lang[i] == lang[a] and words[i]):
            common, total = len(words[a] & words[b]), len(words[a] | words[b])
            if common * 100 >= 60 * total and (best is None or common * best[2] > best[1] * total):
                best = b, common, total
        if best:
            taken.add(best[0])
            out.append((lang[a], a, *best))
    return out


def test_moves_equal_brute_force(spark, tmp_path):
    r = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "echo", "foxtrot"]
    docs = [(i, " ".join(r.sample(names, r.randint(0, 6))), r.choice(["en", "de", None])) for i in range(160)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(x.lang, x.left_id, x.right_id, x.common, x.total) for x in q13_moves(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(expected(docs), key=str)
