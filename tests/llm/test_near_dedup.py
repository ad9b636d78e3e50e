import random

import numpy as np

from siftwork.llm import near_dedup as nd
from tests.llm.helpers import SCHEMA, crowded, empty, odd, rows


def words(r, n):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(n)]


def corpus(seed=1):
    """Texts, and the group of each: originals with copies of which few words differ, and texts that only share a passage."""
    r = random.Random(seed)
    passage = words(r, 55)
    out = []
    for g in range(60):
        base = words(r, 250) + (passage if g % 3 == 0 else [])
        out.append((g, " ".join(base)))
        for _ in range(g % 4):
            w = list(base)
            for _ in range(r.randint(0, 8)):
                w[r.randrange(len(w))] = words(r, 1)[0]
            out.append((g, " ".join(w)))
    r.shuffle(out)
    return out


def test_groups(spark):
    c = corpus()
    df = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, (_, t) in enumerate(c)], SCHEMA)
    got = nd.near_groups(df).collect()
    want = {}
    for i, (g, _) in enumerate(c):
        want.setdefault(g, []).append(i)
    for r in got:
        assert r["group_id"] == want[c[r["id"]][0]][0]
        assert r["keep"] == (r["id"] == r["group_id"])
    assert len(got) == len(c)
    assert {r["doc_id"] for r in nd.keep_one(df).collect()} == {v[0] for v in want.values()}


def test_estimate_is_close():
    r = random.Random(5)
    for differing in (1, 3, 6, 12):
        est, true = [], []
        for _ in range(30):
            w = words(r, 300)
            v = list(w)
            for k in r.sample(range(300), differing):
                v[k] = words(r, 1)[0]
            a, b = " ".join(w), " ".join(v)
            mins, _ = nd.minhashes([a, b])
            odd_ = nd.odd_sketches(mins)
            est.append(float(nd.similarity(np.bitwise_count(odd_[0] ^ odd_[1]).sum())))
            s, at = nd.shingles([a, b])
            x, y = set(s[: at[1]].tolist()), set(s[at[1] :].tolist())
            true.append(len(x & y) / len(x | y))
        assert abs(np.mean(est) - np.mean(true)) < 0.03


def test_minhash_against_loop():
    texts = ["a b c d e", "x", "", "a b c d e a b c", "z y " * 50]
    mins, full = nd.minhashes(texts)
    assert full.tolist() == [0, 1, 3, 4]
    for row, i in enumerate(full):
        s, _ = nd.shingles([texts[i]])
        for j in (0, 5, nd.SAMPLES - 1):
            assert int(mins[row, j]) == min((int(h) * int(nd._A[j]) + int(nd._B[j])) % (1 << 64) for h in s)


def test_long_chain_is_one_group(spark):
    """Each text differs a little from the one before; ends are unlike each other."""
    r = random.Random(2)
    w, texts = words(r, 200), []
    for i in range(40):
        w = list(w)
        for k in range(6):
            w[(6 * i + k) % 200] = words(r, 1)[0]
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    assert {r["group_id"] for r in nd.near_groups(df).collect()} == {0}


def test_hot_group(spark):
    df = spark.createDataFrame([(i, f"the very same words are here again and again in text {'' if i % 2 else 'number'}", "en", "a", 1) for i in range(3000)], SCHEMA)
    assert nd.keep_one(df).count() == 1


def test_buckets_cut_into_parts(spark, monkeypatch):
    """Parts of a few documents give the groups that whole buckets give: one hot band of near copies, chains, and texts of which only some are alike."""
    r = random.Random(8)
    texts = [t for _, t in corpus(4)]
    base = words(r, 120)
    for i in range(150):
        v = list(base)
        # Every third is far from the base, so that a bucket holds several components.
        for k in r.sample(range(len(v)), 45 if i % 3 == 0 else 3):
            v[k] = words(r, 1)[0]
        texts.append(" ".join(v))
    w = list(base)
    for i in range(40):
        w = list(w)
        w[3 * i % 120] = words(r, 1)[0]
        texts.append(" ".join(w))
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    want = rows(nd.near_groups(df).select("id", "group_id", "n_links", "keep"))
    assert len({x[1] for x in want}) > 60 and max(x[2] for x in want) > 50
    monkeypatch.setattr(nd, "PART", 6)
    assert rows(nd.near_groups(df).select("id", "group_id", "n_links", "keep")) == want


def test_survivor_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(1, "the very same text of several words", "en", f"s{i}", i) for i in range(20)], SCHEMA)
    assert {tuple(nd.keep_one(df.repartition(n, "source")).collect()[0]) for n in (1, 3, 5)} == {(1, "the very same text of several words", "en", "s0", 0)}


def test_odd_rows(spark):
    got = rows(nd.near_groups(odd(spark)).select("id", "group_id", "keep"))
    by = {}
    for i, g, k in got:
        by.setdefault(g, []).append((i, k))
    assert len(got) == 13
    assert sorted(by[1], key=repr) == sorted([(1, True), (1, False), (None, False), (1, True)], key=repr) or sum(k for _, k in by[1]) == 2
    assert sorted(by[7]) == [(7, True), (8, False)]
    assert [k for i, _, k in got if i in (2, 3, 4, 5, 6, 9)] == [True] * 6
    assert rows(nd.near_groups(crowded(spark)).select("id", "group_id", "keep")) == got
    assert nd.near_groups(empty(spark)).count() == 0
    kept = nd.keep_one(crowded(spark))
    assert kept.columns == crowded(spark).columns and kept.count() == sum(k for _, _, k in got)
    assert nd.keep_one(empty(spark)).count() == 0
