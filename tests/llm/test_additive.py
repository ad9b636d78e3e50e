import numpy as np
import pytest

from siftwork.llm import additive


def clustered(n, d, seed=1, centres=40):
    r = np.random.RandomState(seed)
    return (r.randn(centres, d)[r.randint(0, centres, n)] + 0.4 * r.randn(n, d)).astype(np.float32)


def brute(x, k):
    d = (x.astype(np.float64) ** 2).sum(1)[:, None] + (x.astype(np.float64) ** 2).sum(1)[None] - 2 * x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k], d


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(range(len(x)) if ids is None else ids, x, strict=True)], "vec_id bigint, embedding array<float>")


def recall(got, want, k):
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["neighbour"])
    return np.mean([len(by.get(i, set()) & set(w.tolist())) / k for i, w in enumerate(want)])


def test_recall(spark):
    x = clustered(3000, 24)
    want, d = brute(x, 10)
    got = additive.neighbours(frame(spark, x), k=10, words=64).collect()
    assert recall(got, want, 10) >= 0.9
    assert len(got) == 30_000
    for r in got[:200]:
        assert r["distance"] == pytest.approx(np.sqrt(d[r["id"], r["neighbour"]]), abs=1e-3)


def test_recall_beyond_the_training_sample(spark, monkeypatch):
    """More rows than the codebooks and the search were fitted on, in several blocks, for a stated query set."""
    monkeypatch.setattr(additive, "QUERY_BLOCK", 256)
    monkeypatch.setattr(additive, "ROW_BLOCK", 4096)
    x = np.concatenate([clustered(9000, 24), np.random.RandomState(2).randn(4000, 24).astype(np.float32)])
    df = frame(spark, x)
    got = additive.neighbours(df, k=10, queries=df.filter("vec_id % 20 = 0"), train_rows=4096).collect()
    asks = np.arange(0, len(x), 20)
    d = (x[asks].astype(np.float64) ** 2).sum(1)[:, None] - 2 * x[asks].astype(np.float64) @ x.T + (x.astype(np.float64) ** 2).sum(1)[None]
    d[np.arange(len(asks)), asks] = np.inf
    want = np.argsort(d, axis=1)[:, :10]
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert sorted(by) == asks.tolist() and all(len(v) == 10 for v in by.values())
    assert np.mean([len({r["neighbour"] for r in by[i]} & set(w.tolist())) / 10 for i, w in zip(asks.tolist(), want, strict=True)]) >= 0.9


def test_lists_out_of_reach_are_not_scored():
    x = clustered(8000, 24, centres=40)
    q = additive.train(x, k=10)
    sizes = np.bincount(q.to_lists(x).argmin(axis=1), minlength=256)
    assert (q.probed(x, sizes, 51) @ sizes).mean() < 0.3 * len(x)


def test_too_many_words():
    with pytest.raises(ValueError, match="byte"):
        additive.train(clustered(600, 8), words=512)


def test_recall_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = t.select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float32)
    ids = np.array([r["vec_id"] for r in rows])
    want = ids[brute(x, 10)[0]]
    got = additive.neighbours(t, k=10).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], set()).add(r["neighbour"])
    assert np.mean([len(by[i] & set(w.tolist())) / 10 for i, w in zip(ids.tolist(), want, strict=True)]) >= 0.9


def test_beam_search_is_no_worse_than_greedy():
    x = clustered(2000, 16)
    q = additive.train(x, books=4, words=32, k=5)
    err = lambda beam: float(((x - additive.decode(q.books, additive.encode(q.books, x, beam))) ** 2).sum())
    assert err(8) < err(1)
    assert err(8) < 0.5 * float((x**2).sum())


def test_one_code_is_the_nearest_word():
    x = clustered(500, 8)
    q = additive.train(x, books=1, words=16, k=5)
    d = ((x[:, None] - q.books[0][None]) ** 2).sum(2)
    assert (additive.encode(q.books, x)[:, 0] == d.argmin(1)).mean() > 0.999


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 0.0]), (8, [inf, 0.0]), (None, [0.0, 0.0]), (9, [None, 1.0]), (1, [0.0, 0.0]), (10, [5.0, 5.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in data], "vec_id bigint, embedding array<float>, v string, list int, codes int")
    got = {}
    for r in additive.neighbours(df, k=2).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2], 10: [2, 3]}
    assert additive.neighbours(df.limit(0)).count() == 0
    assert additive.neighbours(df.filter("vec_id = 2")).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    top = [(r["id"], r["neighbour"]) for r in additive.neighbours(same, k=1).collect()]
    assert sorted(top) == [(i, 1 if i == 0 else 0) for i in range(30)]


def test_repeated_ids_do_not_hide_others(spark):
    x = clustered(60, 8)
    df = frame(spark, np.concatenate([x, *[x[1:2]] * 80]), [*range(60), *[1] * 80])
    got = {(r["id"], r["neighbour"]) for r in additive.neighbours(df, k=5).collect()}
    want, _ = brute(x, 5)
    assert len(got) == 300 and recall([{"id": a, "neighbour": b} for a, b in got], want, 5) >= 0.9
