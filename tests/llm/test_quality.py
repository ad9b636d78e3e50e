import random

import numpy as np
import pytest

from siftwork.llm import quality, queries
from tests.llm.helpers import SCHEMA, crowded, empty, odd, rows


def corpus(n, seed):
    """Good prose, and documents of which one passage of many is junk."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(r.randint(8, 20))).capitalize() + "."
    junk = lambda: " | ".join(word().upper() + "###" for _ in range(12))
    out = []
    for i in range(n):
        lines = [line() for _ in range(r.randint(2, 9))]
        bad = r.random() < 0.3
        if bad:
            lines.insert(r.randint(0, len(lines)), junk())
        out.append((i, "\n".join(lines), int(not bad), next((k for k, x in enumerate(lines) if "###" in x), None)))
    return out


def test_held_out(spark):
    train, test = corpus(500, 1), corpus(400, 2)
    frame = lambda c: spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t, _, _ in c], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in train], "doc_id bigint, quality int")
    model = quality.train(frame(train), labels)
    got = {r["doc_id"]: r for r in quality.scored(frame(test), model).collect()}
    right = np.mean([(got[i]["quality_score"] >= 0.5) == bool(y) for i, _, y, _ in test])
    assert right > 0.97
    attended = [got[i]["top_passage"] == k for i, _, y, k in test if not y]
    assert np.mean(attended) > 0.9
    kept = {r["doc_id"] for r in quality.keep_good(frame(test), model).collect()}
    assert kept == {i for i in got if got[i]["quality_score"] >= 0.5}


def test_attention_and_gradient_against_numbers():
    """The loss falls, and attention of each bag sums to one."""
    r = np.random.RandomState(0)
    bag = np.sort(np.concatenate([np.arange(60), r.randint(0, 60, 200)]))
    x = r.randn(len(bag), quality.FEATURES)
    y = r.randint(0, 2, 60).astype(float)
    first = np.searchsorted(bag, np.arange(60))
    x[first[y == 1], 0] += 8
    m = quality.fit(x, bag, y, epochs=60)
    logit, a, _ = m.forward(x, bag, 60)
    assert np.allclose(np.add.reduceat(a, first), 1)
    assert np.mean((logit > 0) == (y > 0.5)) > 0.95


def test_passages_against_loop():
    texts = [b"Ab 1\n\n  \nlonger line here", b"", b"x" * 2500, "é\n".encode()]
    x, owner, begin, end = quality.passages(texts)
    assert owner.tolist() == [0, 0, 2, 2, 2, 3]
    assert (end - begin).tolist() == [4, 16, 1000, 1000, 500, 2]
    assert x.shape == (6, quality.FEATURES) and np.isfinite(x).all()


def test_one_class_and_no_labels(spark):
    docs = odd(spark)
    ones = spark.createDataFrame([(1, 1), (7, 1), (None, 0), (8, None)], "doc_id bigint, quality int")
    assert {r["quality_score"] for r in quality.scored(docs, quality.train(docs, ones)).collect()} == {1.0, None}
    none = quality.train(docs, ones.limit(0))
    assert quality.keep_good(docs, none).count() == 9
    assert quality.train(empty(spark), ones).prior == 1.0


def test_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (7, 1), (9, 0), (99, 0)], "doc_id bigint, quality int")
    model = quality.train(odd(spark), labels)
    got = quality.scored(odd(spark), model)
    assert got.count() == 13
    assert {r["doc_id"] for r in got.collect() if r["quality_score"] is None} == {None, 2, 3, 4}
    assert rows(quality.scored(crowded(spark), model)) == rows(got)
    assert quality.scored(empty(spark), model).count() == 0
    kept = quality.keep_good(crowded(spark), model)
    assert kept.columns == crowded(spark).columns and None not in {r["text"] for r in kept.collect()}


def loss(model, x, bag, y, n):
    """The mean of the weighted log losses, both classes weighing the same."""
    logit, _, _ = model.forward(x, bag, n)
    p = 1 / (1 + np.exp(-logit))
    cost = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    return float((-(y * np.log(p) + (1 - y) * np.log(1 - p)) * cost).mean())


def test_training_follows_numeric_gradients():
    """The first step of Adam moves each parameter by the rate against the sign of its gradient, which is taken here from differences of the loss; later steps lower the loss."""
    r = np.random.RandomState(2)
    n, d = 12, quality.FEATURES
    sizes = r.randint(1, 5, n)
    bag = np.repeat(np.arange(n), sizes)
    x = r.randn(len(bag), d)
    y = (np.arange(n) % 3 == 0).astype(float)
    start = quality.fit(x, bag, y, epochs=0, batch=n, seed=3)
    one = quality.fit(x, bag, y, epochs=1, batch=n, rate=1e-3, decay=0.0, seed=3)
    checked = 0
    for i, p in enumerate(start.params):
        # fit() lowers the rate in the last third of the epochs, which a single epoch is in where 1 >= 2 // 3.
        rate = 1e-3 * 0.1
        for at in [tuple(a) for a in np.array(np.unravel_index(r.permutation(p.size)[:40], p.shape)).T]:
            def moved(by, i=i, at=at):
                params = [q.copy() for q in start.params]
                params[i][at] += by
                return loss(quality.Model(start.mean, start.scale, params, start.prior), x, bag, y, n)

            g = (moved(1e-5) - moved(-1e-5)) / 2e-5
            if abs(g) > 1e-5:
                step = one.params[i][at] - p[at]
                assert step == pytest.approx(-rate * np.sign(g), rel=2e-2), (i, at, g, step)
                checked += 1
    assert checked > 120
    better = quality.fit(x, bag, y, epochs=30, batch=n, seed=3)
    assert loss(better, x, bag, y, n) < 0.5 * loss(start, x, bag, y, n)


def plain_features(text):
    """The features of each passage of one text by plain loops."""
    data = text.encode()
    spans, at = [], 0
    for line in data.split(b"\n"):
        for i in range(0, max(len(line), 1), quality.PASSAGE):
            part = line[i : i + quality.PASSAGE]
            if part.strip(b" \t\r"):
                spans.append((at + i, at + i + len(part)))
        at += len(line) + 1
    whole = data + b"\n"
    out = []
    for a, b in spans:
        grid = np.zeros(quality._CLASSES**2)
        for i in range(a, b):
            if i + 1 < len(whole):
                grid[quality._CLASS[whole[i]] * quality._CLASSES + quality._CLASS[whole[i + 1]]] += 1
        # Words by white space of the whole text; one that a cut passes through counts where it begins.
        words, i = [], 0
        while i < len(whole):
            if chr(whole[i]) in " \t\r\n":
                i += 1
                continue
            j = i
            while chr(whole[j]) not in " \t\r\n":
                j += 1
            words.append((i, whole[i:j]))
            i = j
        own = [w for i, w in words if a <= i < b]
        again = sum(1 for k in range(1, len(words)) if a <= words[k][0] < b and words[k][1] == words[k - 1][1] and a <= words[k - 1][0] < b)
        same = sum(data[p:q] == data[a:b] for p, q in spans)
        extra = [again / max(len(own), 1), sum(map(len, own)) / max(len(own), 1) / 10, np.log1p(len(own)) / 5, np.log1p(b - a) / 7, float(same > 1), np.log1p(len(spans)) / 5]
        out.append(np.concatenate([np.sqrt(grid / (b - a)), extra]))
    return np.array(out).reshape(-1, quality.FEATURES)


def test_features_against_plain_loops(spark, small):
    texts = ["a b b c", "", " \n\t", "Hello, World! 12 12\nHello, World! 12 12\n|x|y|", "é é ñ" * 40, "x" * 2500 + " y", "one\n\ntwo two two"]
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    x, owner, _, _ = quality.passages([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert np.allclose(x[owner == i], plain_features(t), atol=1e-5), i


def test_query_against_plain_model(spark, small):
    """Every score of the query, restated document by document from the trained parameters."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    w, b, v, u, g, o, c = model.params
    got = queries.QUERIES["op5_quality"](spark, small).collect()
    assert len(got) == len(text)
    for r in got[::5]:
        x = (plain_features(text[r["doc_id"]]).astype(np.float32).astype(float) - model.mean) / model.scale
        h = np.tanh(x @ w + b)
        e = np.array([sum(np.tanh(k @ v) * (1 / (1 + np.exp(-(k @ u)))) * g) for k in h])
        a = np.exp(e - e.max())
        a /= a.sum()
        p = 1 / (1 + np.exp(-((a[:, None] * h).sum(axis=0) @ o + c[0])))
        assert r["quality_score"] == pytest.approx(p, abs=1e-4) and r["keep"] == (r["quality_score"] >= 0.5)
        assert r["n_passages"] == len(x) and a[r["top_passage"]] == pytest.approx(a.max(), rel=1e-3)
