"""Selection against plain loops, over random items with ties, zero tokens and oversized items."""

import random
from collections import Counter

import numpy as np
import pytest

from siftwork.operators import ranking, select

f32 = np.float32


def eff(s, t):
    return f32(float(f32(s)) / t) if t > 0 else f32(0)


def greedy(items, budget):
    out, left = [], budget
    for k, t, s, _ in sorted(items, key=lambda x: (-eff(x[2], x[1]), x[0])):
        if t > budget:
            continue
        if t <= left:
            out.append(k)
            left -= t
        if left < 10:
            break
    return out


def diverse(items, budget, decay=0.7):
    rest, left, count, out = [x for x in items if x[1] <= budget], budget, Counter(), []
    while left >= 10:
        fit = [x for x in rest if x[1] <= left]
        if not fit:
            break
        value = lambda x: float("inf") if x[1] == 0 else float(eff(x[2], x[1])) * decay ** count[x[3]]
        best = min(fit, key=lambda x: (-value(x), x[0]))
        rest.remove(best)
        left -= best[1]
        count[best[3]] += 1
        out.append(best[0])
    return out


def kkt(items, budget, decay=None):
    top = max((float(eff(s, t)) for _, t, s, _ in items if t > 0), default=0.0)
    best, most = [], -1.0
    for k in range(1, 31):
        lam = top * 1.1 * 2.0**-k
        few = sorted((x for x in items if x[1] <= budget and float(f32(x[2])) - lam * x[1] > 0), key=lambda x: (-(float(f32(x[2])) - lam * x[1]), x[0]))
        used, total, took, count = 0, 0.0, [], Counter()
        for key, t, s, g in few:
            v = float(f32(s)) * (decay ** count[g] if decay else 1.0)
            if used + t <= budget and v - lam * t > 0:
                used, total = used + t, total + v
                count[g] += 1
                took.append(key)
        if total > most:
            best, most = took, total
    return best


def cases():
    r = random.Random(1)
    for n, budget in ((0, 100), (1, 5), (30, 9), (30, 10), (40, 200), (60, 1000), (80, 400)):
        yield [(i, r.choice([0, 3, 10, 10, 25, r.randint(1, 300), 2000]), round(r.choice([0.0, 0.25, r.random()]), 3), f"d{r.randint(0, 4)}") for i in range(n)], budget


@pytest.fixture(scope="module")
def frames(spark):
    return [(items, budget, spark.createDataFrame(items, "key int, token_count int, composite_score float, g string")) for items, budget in cases()]


def order(df):
    return [r["key"] for r in df.orderBy("pick_order").collect()]


def test_greedy(frames):
    for items, budget, df in frames:
        assert order(select.greedy(df, budget)) == greedy(items, budget)


def test_diverse(frames):
    for items, budget, df in frames:
        assert order(select.greedy_diverse(df, budget, group=df.g)) == diverse(items, budget)


def test_kkt(frames):
    for items, budget, df in frames:
        assert order(select.kkt(df, budget)) == kkt(items, budget)
        assert order(select.kkt(df, budget, select.Diversity(), group=df.g)) == kkt(items, budget, 0.7)


def test_auto_is_not_worse_and_within_budget(frames):
    for items, budget, df in frames:
        by = {k: (t, float(f32(s))) for k, t, s, _ in items}
        auto = order(select.select(df, budget))
        assert sum(by[k][0] for k in auto) <= budget
        assert sum(by[k][1] for k in auto) >= sum(by[k][1] for k in greedy(items, budget)) - 1e-9


def test_same_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, 50, None, "a"), (2, None, 0.5, "a"), (None, 20, 0.5, "a"), (3, 60, 0.9, None)], "key int, token_count int, composite_score float, g string")
    assert order(select.greedy(df, 1000)) == [3, 1]
    assert order(select.greedy_diverse(df, 1000, group=df.g)) == [3, 1]


def test_ranks_of_extreme_values(spark):
    rows = [(i, v) for i, v in enumerate([1e300, 1e-300, 0.0, -1.0, 5.0, 5.0, 4.999999])]
    got = ranking.ranked(spark.createDataFrame(rows, "k int, v double"), select.F.col("v"), ["k"]).orderBy("rank").collect()
    assert [r["k"] for r in got] == [0, 4, 5, 6, 1, 2, 3]
