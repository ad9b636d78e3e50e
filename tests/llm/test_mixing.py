import collections

import pytest
from pyspark.sql import functions as F

from siftwork.llm import mixing, queries
from tests.llm.helpers import crowded, empty, odd, rows
from tools.compare import compare


@pytest.mark.parametrize("name", ["op2_mixing", "op4_versions", "op6_warc_archive"])
def test_matches_sql(spark, small, name):
    said = compare(spark, small, name, queries.QUERIES[name], queries.ORACLE_SQL[name])
    assert said.startswith("ok"), said


def table(spark, n=400):
    return spark.createDataFrame([(i, "x", "en", "hot" if i % 10 else f"s{i % 3}", 10 + i % 7) for i in range(n)], "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_copies_are_within_one_of_what_is_expected(spark):
    docs = table(spark)
    rate = {r["source"]: r["rate"] / mixing.UNIT for r in mixing.rates(docs, {"hot": 1, "s0": 2, "s1": 1}).collect()}
    got = collections.Counter((r["doc_id"], r["source"]) for r in mixing.mix(docs, {"hot": 1, "s0": 2, "s1": 1}, seed=3).collect())
    per = collections.Counter()
    for r in docs.collect():
        n = got[(r["doc_id"], r["source"])]
        assert abs(n - rate[r["source"]]) < 1
        per[r["source"]] += n
    sizes = collections.Counter(r["source"] for r in docs.collect())
    assert rate["s2"] == 0 and per["s2"] == 0
    assert all(abs(per[s] - sizes[s] * rate[s]) < 1 + 1e-3 for s in sizes)


def test_brute_force(spark):
    """One running sum for each source in the order of digests."""
    import hashlib

    docs, got = table(spark), mixing.mix(table(spark), seed=9)
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs).collect()}
    want = []
    for s in rate:
        at = int(hashlib.md5(f"9:{s}".encode()).hexdigest()[:8], 16) % mixing.UNIT
        for r in sorted((r for r in docs.collect() if r["source"] == s), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["n_chars"])):
            n = (at + rate[s]) // mixing.UNIT - at // mixing.UNIT
            at += rate[s]
            want += [(r["doc_id"], s, c) for c in range(1, n + 1)]
    assert rows(got) == sorted(want, key=repr)


def test_factors_against_brute_force(spark):
    """Each document expects its own number of copies; the shares of the sources stay as they were set."""
    import hashlib

    data = [(i, "hot" if i % 10 else f"s{i % 3}", 10 + i % 7, [0.25, 1.0, 3.5, None, -1.0][i % 5]) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id bigint, source string, n_chars bigint, score double")
    rate = {r["source"]: r["rate"] for r in mixing.rates(docs, factor_col="score").collect()}
    want = collections.Counter()
    for s in rate:
        at = int(hashlib.md5(f"4:{s}".encode()).hexdigest()[:8], 16) % mixing.UNIT
        total = 0
        for i, _, _, f in sorted((d for d in data if d[1] == s), key=lambda d: (hashlib.md5(str(d[0]).encode()).hexdigest(), d[2])):
            f = round(max(f or 0, 0) * mixing.UNIT)
            before, total = total, total + f
            n = (at + total * rate[s] // mixing.UNIT) // mixing.UNIT - (at + before * rate[s] // mixing.UNIT) // mixing.UNIT
            if n:
                want[i] = n
    got = collections.Counter(r["doc_id"] for r in mixing.mix(docs, seed=4, factor_col="score").collect())
    assert got == want and not any(got[i] for i in range(500) if i % 5 > 2)
    size = {s: sum(got[i] * n for i, src, n, _ in data if src == s) for s in rate}
    weight = {r["source"]: r["weight"] for r in mixing.rates(docs, factor_col="score").collect()}
    assert all(abs(size[s] / sum(size.values()) - weight[s] / sum(weight.values())) < 0.06 for s in rate)


def test_ties_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "a", 6) for i in range(12)] + [(2, "other", "b", 6)], "doc_id bigint, text string, source string, n_chars bigint")
    got = [rows(mixing.mix(docs.repartition(n, "text"), {"a": 1, "b": 1}, total=60, keep_cols=["doc_id", "text", "source"])) for n in (1, 2, 3, 7)]
    assert got[0] == got[1] == got[2] == got[3] and 0 < len({r[1] for r in got[0]}) < 12


def test_keep_all_drops_nothing(spark):
    docs = table(spark)
    assert mixing.mix(docs, keep_all=True).select("doc_id").distinct().count() == docs.count()


def test_odd_rows(spark):
    got = mixing.mix(odd(spark), keep_all=True)
    assert {r["source"] for r in got.collect()} == {None, "a", "b", "c"}
    assert rows(mixing.mix(crowded(spark), keep_all=True)) == rows(got)
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(odd(spark), {"nope": 1.0}).count() == 0
    with pytest.raises(ValueError, match="negative"):
        mixing.mix(odd(spark), {"a": -1.0})
    kept = mixing.mix(crowded(spark), keep_all=True, keep_cols=["doc_id", "copy_no", "tokens"])
    assert kept.columns == ["doc_id", "tokens", "copy_no"]
    assert kept.agg(F.min("copy_no")).first()[0] == 1
