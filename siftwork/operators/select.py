"""Selection under a token budget: greedy, diverse greedy, Lagrangian, and the better of two.

All solvers take items as key, tokens, score (and group) and return key and pick order. Ties go to the lesser
key. The long run of items that surely fits is found by running sums over the
whole table; only the end of the budget is settled item by item, over candidates
whose number the budget bounds: of items of one size, no more than fit can be taken.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.paths import group_key
from siftwork.functions.scores import efficiency
from siftwork.operators.ranking import ranked
from siftwork.session import stored

LEAST_LEFT = 10
ROUNDS = 30
MARGIN = 1.1


@dataclass(frozen=True)
class Diversity:
    """Each further item of a group counts ``decay`` times the one before."""

    decay: float = 0.7
    grouping: str = "directory"


def _items(df: DataFrame, key: str, tokens: str, score: str, group: Column | None = None) -> DataFrame:
    """The columns that solvers need. Null scores count as 0, rows without key or tokens are left out."""
    cols = [F.col(key).alias("key"), F.col(tokens).cast("long").alias("t"), F.coalesce(F.col(score).cast("float"), F.lit(0.0).cast("float")).alias("s")]
    if group is not None:
        cols.append(F.coalesce(group, F.lit("")).alias("g"))
    return df.select(*cols).filter("key is not null and t is not null and t >= 0")


def _keys(df: DataFrame, kind: str, keys: list, first: int) -> DataFrame:
    rows = [(k, first + i) for i, k in enumerate(keys)]
    return df.sparkSession.createDataFrame(rows, f"key {kind}, pick_order long")


def _kind(items: DataFrame) -> str:
    return items.schema["key"].dataType.simpleString()


def greedy(df: DataFrame, budget: int, key: str = "key", tokens: str = "token_count", score: str = "composite_score") -> DataFrame:
    """First fit by descending efficiency: ``key``, ``pick_order``.

    Items over the budget are passed over; the search ends after an item that leaves less than ten tokens.
    """
    items = _items(df, key, tokens, score)
    fits = stored(ranked(items.filter(F.col("t") <= budget), efficiency(F.col("s"), F.col("t")), ["key"], F.col("t"), rank="r", cum="c"), "ranked")
    over = fits.filter(F.col("c") > budget).agg(F.min("r")).first()[0]
    head = fits if over is None else fits.filter(F.col("r") < over)
    stop = head.filter(budget - F.col("c") < LEAST_LEFT).agg(F.min("r")).first()[0]
    if stop is not None:
        return fits.filter(F.col("r") <= stop).select("key", F.col("r").cast("long").alias("pick_order"))
    picked = head.select("key", F.col("r").cast("long").alias("pick_order"))
    if over is None:
        return picked
    left = budget - (head.agg(F.max("c")).first()[0] or 0)
    rest = fits.filter((F.col("r") > over) & (F.col("t") <= left))
    of_size = F.row_number().over(Window.partitionBy("t").orderBy("r"))
    tail = rest.filter("t > 0").withColumn("n", of_size).filter(F.col("n") <= F.floor(F.lit(left) / F.col("t"))).select("key", "t", "r").orderBy("r").collect()
    chosen, last = [], None
    for row in tail:
        if row["t"] <= left:
            left -= row["t"]
            chosen.append(row)
        if left < LEAST_LEFT:
            last = row["r"]
            break
    extra = df.sparkSession.createDataFrame([(x["key"], x["r"]) for x in chosen], f"key {_kind(items)}, r long")
    free = rest.filter("t = 0" if last is None else f"t = 0 and r < {last}").select("key", F.col("r").cast("long").alias("r"))
    more = extra.unionByName(free)
    order = F.row_number().over(Window.partitionBy().orderBy("r")) + F.lit(over - 1)
    return picked.unionByName(more.select("key", order.cast("long").alias("pick_order")))


def oversized(df: DataFrame, budget: int, picked: DataFrame, key: str = "key", tokens: str = "token_count", score: str = "composite_score") -> DataFrame:
    """``oversized_skipped``: the items over the budget that greedy selection met before it ended."""
    items = _items(df, key, tokens, score).withColumn("e", efficiency(F.col("s"), F.col("t")))
    last = picked.groupBy().agg(F.max_by("key", "pick_order").alias("k"))
    end = items.join(last, F.col("key") == F.col("k")).select(F.col("e").alias("e_end"), F.col("key").alias("k_end"))
    used = items.join(picked.select(F.col("key").alias("pk")), F.col("key") == F.col("pk"), "left_semi").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("used"))
    big = items.filter(F.col("t") > budget).crossJoin(used).join(end, F.lit(True), "left")
    early = (F.lit(budget) - F.col("used") >= LEAST_LEFT) | F.col("e_end").isNull() | (F.col("e") > F.col("e_end")) | ((F.col("e") == F.col("e_end")) & (F.col("key") < F.col("k_end")))
    return big.agg(F.count(F.when(early, F.lit(1))).alias("oversized_skipped"))


def greedy_diverse(df: DataFrame, budget: int, diversity: Diversity = Diversity(), key: str = "key", tokens: str = "token_count", score: str = "composite_score", path: str | None = None, group: Column | None = None) -> DataFrame:
    """Always the item of highest decayed efficiency that fits: ``key``, ``pick_order``. Items without tokens come first."""
    g = group if group is not None else group_key(F.col(path or key), diversity.grouping)
    items = _items(df, key, tokens, score, g).filter(F.col("t") <= budget)
    if budget < LEAST_LEFT:
        return items.limit(0).select("key", F.lit(0).cast("long").alias("pick_order"))
    items = stored(items, "items")
    free = items.filter("t = 0")
    n_free = free.count()
    paid = ranked(items.filter("t > 0"), efficiency(F.col("s"), F.col("t")), ["key"], by=["g"], rank="i")
    taken = free.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("g", "g0")
    paid = paid.join(taken, F.col("g") == F.col("g0"), "left")
    value = efficiency(F.col("s"), F.col("t")).cast("double") * F.pow(F.lit(float(diversity.decay)), F.col("i") - 1 + F.coalesce("n", F.lit(0)))
    paid = stored(ranked(paid.select("key", "t", "s", "g", value.alias("v")), F.col("v"), ["key"], F.col("t"), rank="r", cum="c"), "ranked")
    over = paid.filter((F.col("c") > budget)).agg(F.min("r")).first()[0]
    done = paid.filter(F.col("c") - F.col("t") > budget - LEAST_LEFT).agg(F.min("r")).first()[0]
    end = min([x for x in (over, done) if x is not None], default=None)
    head = paid if end is None else paid.filter(F.col("r") < end)
    order = ranked(free, F.lit(0.0), ["key"], rank="r").select("key", F.col("r").cast("long").alias("pick_order"))
    picked = order.unionByName(head.select("key", (F.col("r") + n_free).cast("long").alias("pick_order")))
    if end is None or end != over:
        return picked
    left = budget - (head.agg(F.max("c")).first()[0] or 0)
    if left < LEAST_LEFT:
        return picked
    counts = head.groupBy("g").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("g", "g1")
    rest = paid.filter((F.col("r") >= over) & (F.col("t") <= left)).join(counts, F.col("g") == F.col("g1"), "left").join(taken, F.col("g") == F.col("g0"), "left")
    rest = rest.select("key", "t", "g", efficiency(F.col("s"), F.col("t")).cast("double").alias("e"), (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("m"))
    rest = rest.withColumn("fresh", F.col("e") * F.pow(F.lit(float(diversity.decay)), F.col("m")))
    # Of a size, a group gives no more than fit; and no more groups can be touched than the least items that fit.
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("g", "t").orderBy(F.desc("e"), "key"))).filter(F.col("n") <= F.floor(F.lit(left) / F.col("t")))
    least = rest.agg(F.min("t")).first()[0]
    if least is None:
        return picked
    heads = rest.filter("n = 1").withColumn("h", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("fresh"), "key"))).filter(F.col("h") <= left // least + 1)
    rest = rest.join(heads.select(F.col("g").alias("hg"), F.col("t").alias("ht")), (F.col("g") == F.col("hg")) & (F.col("t") == F.col("ht")), "left_semi")
    tail = _diverse_tail([tuple(x) for x in rest.select("g", "e", "key", "t", "m").collect()], left, diversity.decay)
    first = (over - 1) + n_free + 1
    return picked.unionByName(_keys(df, _kind(items), tail, first))


def _diverse_tail(rows: list[tuple], left: int, decay: float) -> list:
    """Keys in pick order. A group's next item is its most efficient that fits; what doesn't fit never will."""
    groups: dict[str, list] = defaultdict(list)
    count: dict[str, int] = {}
    for g, e, key, t, m in rows:
        groups[g].append((-e, key, t))
        count[g] = m
    for items in groups.values():
        items.sort()
    at = dict.fromkeys(groups, 0)
    heap: list[tuple] = []

    def push(g: str) -> None:
        items, i = groups[g], at[g]
        while i < len(items) and items[i][2] > left:
            i += 1
        at[g] = i
        if i < len(items):
            heapq.heappush(heap, (items[i][0] * decay ** count[g], items[i][1], items[i][2], g))

    for g in groups:
        push(g)
    out = []
    while heap and left >= LEAST_LEFT:
        _, key, t, g = heapq.heappop(heap)
        if t <= left:
            left -= t
            count[g] += 1
            out.append(key)
            at[g] += 1
        push(g)
    return out


def kkt(df: DataFrame, budget: int, diversity: Diversity | None = None, key: str = "key", tokens: str = "token_count", score: str = "composite_score", path: str | None = None, group: Column | None = None) -> DataFrame:
    """Lagrangian relaxation: ``key``, ``pick_order``.

    Bisection halves the multiplier in each round, so its 30 values are known beforehand;
    for each, items of positive net value are taken first fit by descending net value, and the best total wins, the earliest on a tie.
    """
    g = group if group is not None else group_key(F.col(path or key), diversity.grouping) if diversity else F.lit("")
    every = _items(df, key, tokens, score, g)
    items = every.filter(F.col("t") <= budget)
    top = every.filter("t > 0").agg(F.max(efficiency(F.col("s"), F.col("t")))).first()[0] or 0.0
    # Items of one size keep their order for any multiplier, so of each size (and group) only as many matter as fit.
    by = ["t", "g"] if diversity else ["t"]
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "key"))
    few = items.withColumn("n", n).filter((F.col("t") == 0) | (F.col("n") <= F.floor(F.lit(budget) / F.greatest(F.col("t"), F.lit(1)))))
    if diversity:
        few = stored(few, "few")
        least = few.filter("t > 0").agg(F.min("t")).first()[0] or 1
        heads = few.filter("n = 1").withColumn("h", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("s"), "key")))
        heads = heads.filter((F.col("t") == 0) | (F.col("h") <= budget // least + 1)).select(F.col("g").alias("hg"), F.col("t").alias("ht"))
        few = few.join(heads, (F.col("g") == F.col("hg")) & (F.col("t") == F.col("ht")), "left_semi")
    pdf = few.select("key", "t", "s", "g").orderBy("key").toPandas()
    t, s = pdf["t"].to_numpy(np.int64), pdf["s"].to_numpy(np.float64)
    groups = pdf["g"].astype("category").cat.codes.to_numpy()
    best, best_score = np.zeros(0, np.int64), -np.inf
    for k in range(1, ROUNDS + 1):
        lam = top * MARGIN * 2.0**-k
        net = s - lam * t
        order = np.lexsort((np.arange(len(t)), -net))
        order = order[net[order] > 0]
        took, total = _first_fit(order, t, s, budget) if diversity is None else _first_fit_diverse(order, t, s, groups, budget, lam, diversity.decay)
        if total > best_score:
            best, best_score = took, total
    return _keys(df, _kind(items), pdf["key"].iloc[best].tolist(), 1)


def _first_fit(order: np.ndarray, t: np.ndarray, s: np.ndarray, budget: int) -> tuple[np.ndarray, float]:
    took, left = [], budget
    while len(order):
        n = int(np.searchsorted(np.cumsum(t[order]), left, side="right"))
        took.append(order[:n])
        left -= int(t[order[:n]].sum())
        order = order[n:][t[order[n:]] <= left]
    out = np.concatenate(took) if took else np.zeros(0, np.int64)
    return out, float(np.add.accumulate(s[out])[-1]) if len(out) else 0.0


def _first_fit_diverse(order: np.ndarray, t: np.ndarray, s: np.ndarray, groups: np.ndarray, budget: int, lam: float, decay: float) -> tuple[np.ndarray, float]:
    count: dict[int, int] = defaultdict(int)
    used, total, took = 0, 0.0, []
    for i in order.tolist():
        if used + t[i] > budget:
            continue
        value = s[i] * decay ** count[groups[i]]
        if value - lam * t[i] > 0:
            used += int(t[i])
            total += value
            count[groups[i]] += 1
            took.append(i)
    return np.array(took, np.int64), total


def select(df: DataFrame, budget: int, solver: str = "auto", diversity: Diversity | None = None, key: str = "key", tokens: str = "token_count", score: str = "composite_score", path: str | None = None, group: Column | None = None) -> DataFrame:
    """``greedy``, ``kkt``, or by any other name the one of both with the higher sum of plain scores, greedy on a tie."""
    cols = {"key": key, "tokens": tokens, "score": score}

    def by_greedy() -> DataFrame:
        return greedy(df, budget, **cols) if diversity is None else greedy_diverse(df, budget, diversity, **cols, path=path, group=group)

    if solver == "greedy":
        return by_greedy()
    if solver == "kkt":
        return kkt(df, budget, diversity, **cols, path=path, group=group)
    a, b = stored(by_greedy(), "greedy"), stored(kkt(df, budget, diversity, **cols, path=path, group=group), "kkt")
    scores = _items(df, key, tokens, score)

    def total(picked: DataFrame) -> float:
        found = scores.join(picked.select(F.col("key").alias("pk")), F.col("key") == F.col("pk"), "left_semi")
        return found.agg(F.sum(F.col("s").cast("double"))).first()[0] or 0.0

    return b if total(b) > total(a) else a
