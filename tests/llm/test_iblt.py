import hashlib
import random

import numpy as np

from siftwork.llm import iblt, queries
from tests.llm.helpers import crowded, empty, odd, rows
from tools.compare import compare


def digest(p):
    return int(hashlib.md5(p.encode()).hexdigest()[:15], 16)


def test_peeling_recovers_what_differs():
    r = np.random.RandomState(1)
    for shared, a, b in ((0, 0, 0), (500, 3, 2), (10, 0, 5), (1000, 5, 5)):
        pool = np.unique(r.randint(0, 1 << 60, 2000))
        pool = r.permutation(pool)[: shared + a + b].astype(np.uint64)
        x, y = np.concatenate([pool[:shared], pool[shared : shared + a]]), np.concatenate([pool[:shared], pool[shared + a :]])
        d = iblt.subtract(iblt.sketch([x], 48), iblt.sketch([y], 48))
        row, keys, signs, whole = iblt.peel(d)
        assert whole[0]
        assert set(keys[signs == 1].tolist()) == set(pool[shared : shared + a].tolist())
        assert set(keys[signs == -1].tolist()) == set(pool[shared + a :].tolist())


def test_too_small_a_sketch_says_so():
    keys = np.arange(1, 500, dtype=np.uint64)
    assert not iblt.peel(iblt.sketch([keys], 24))[3][0]


def brute(docs):
    sets = {}
    for i, t in docs:
        if i is not None:
            s = sets.setdefault(i, set())
            s |= {digest(p) for p in (t or "").split("\n") if p.strip(" ")}
    out = []
    for i in sorted(sets):
        votes = {}
        for p in sets[i]:
            before = [j for j in sets if j < i and p in sets[j]]
            if before:
                votes[max(before)] = votes.get(max(before), 0) + 1
        prev = max(votes, key=lambda j: (votes[j], j)) if votes else None
        out.append((i, len(sets[i]), prev, *((sorted(sets[i] - sets[prev]), sorted(sets[prev] - sets[i])) if votes else (None, None))))
    return out


def test_against_sets_with_retries(spark):
    """Versions that differ in hundreds of paragraphs don't fit the first sketch."""
    base = [f"paragraph {i}" for i in range(3000)]
    docs = [(1, "\n".join(base)), (2, "\n".join(base[:2990] + ["new"])), (3, "\n".join(base[:100])), (5000, "\n".join(base[50:1500])), (9000, "alone"), (9001, "alone"), (9002, "p\n\np\nalone")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in iblt.version_diffs(df).collect())
    assert got == brute(docs)


def test_odd_rows(spark):
    got = iblt.version_diffs(odd(spark))
    assert sorted(r["id"] for r in got.collect()) == list(range(1, 10))
    by = {r["id"]: r for r in got.collect()}
    assert by[1]["n_paragraphs"] == 2 and by[2]["n_paragraphs"] == 0 and by[8]["prev"] == 7 and by[8]["added"] == []
    assert rows(iblt.version_diffs(crowded(spark))) == rows(got)
    assert iblt.version_diffs(empty(spark)).count() == 0


def test_ids_may_be_strings(spark):
    df = spark.createDataFrame([("a", "x\ny"), ("b", "x")], "doc_id string, text string")
    assert rows(iblt.version_diffs(df).select("id", "prev")) == [("a", None), ("b", "a")]


def test_closest_version_against_all_earlier_ids(spark):
    """The lines of documents recur one by one in others, some lines are in nearly all, and there are copies."""
    r = random.Random(3)
    docs = [(1, "a\nb\nc\nd"), (2, "a"), (3, "b\nx"), (4, "c"), (5, "a\nb\nc\nd")]
    for i in range(10, 400):
        if r.random() < 0.3:
            lines = r.choice(docs)[1].split("\n")
        else:
            lines = ["license"] * r.choice([0, 1, 1]) + [f"hot {r.randint(0, 4)}" for _ in range(r.randint(0, 3))] + [f"line {int(r.random() ** 2 * 300)}" for _ in range(r.randint(0, 8))]
        docs.append((i * 50, "\n".join(lines + ([f"own {i}"] if r.random() < 0.5 else []))))
    sets = {i: {p for p in t.split("\n") if p} for i, t in docs}
    first = {i: p for i, _, p, *_ in brute(docs)}
    want = []
    for i, s in sets.items():
        shared = {j: len(s & sets[j]) for j in sets if j < i and s & sets[j]}
        want.append((i, max(shared, key=lambda j: (shared[j], j == first[i], j)) if shared else None))
    assert sum(first[i] != j for i, j in want) > 20
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = iblt.version_diffs(df, closest=True)
    assert rows(got.select("id", "prev")) == sorted(want, key=repr)
    by = {x["id"]: x for x in got.collect()}
    assert by[5]["prev"] == 1 and by[5]["added"] == [] and by[5]["removed"] == []
    assert rows(iblt.version_diffs(crowded(spark), closest=True)) == rows(iblt.version_diffs(odd(spark), closest=True))
    assert iblt.version_diffs(empty(spark), closest=True).count() == 0


def test_closest_query_matches_sql(spark, small):
    said = compare(spark, small, "op4_closest_versions", queries.QUERIES["op4_closest_versions"], queries.ORACLE_SQL["op4_closest_versions"])
    assert said.startswith("ok"), said
