"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import pytest
from pyspark.sql import functions as F

from siftwork.functions import bpe_count
from siftwork.operators import dedup
from siftwork.plans import registry
from tools.compare import compare

WITHOUT_SQL = {"exact_bpe_count"}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - WITHOUT_SQL))
def test_matches_sql(spark, small, name):
    said = compare(spark, small, name, registry.QUERIES[name], registry.ORACLE_SQL.get(name))
    assert said.startswith("ok"), said


def test_every_query_has_sql():
    assert set(registry.QUERIES) - WITHOUT_SQL == set(registry.ORACLE_SQL)


def test_exact_counts(spark, small):
    count = bpe_count.counter()
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = registry.exact_bpe_count(spark, small).collect()
    assert len(got) == len(text) and all(r["tokens"] == count(text[r["doc_id"]]) for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())


def test_links_of_copies_are_told(spark, small):
    """Pairs of leads and members together give every pair of documents, and the number of each document's."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    more = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000)).unionByName(docs.filter("doc_id % 3 = 0").withColumn("doc_id", F.col("doc_id") + 2_000_000))
    prints = dedup.simhash(more, "doc_id", "text").cache()
    lead = prints.groupBy("simhash").agg(F.min("key").alias("key"))
    members = dedup.members(prints, threshold=8).collect()
    of = {r["key"]: r["lead"] for r in members}
    groups = {}
    for k, v in of.items():
        groups.setdefault(v, []).append(k)
    told = {(min(x, y), max(x, y)) for r in dedup.near_pairs(lead, threshold=8).collect() for x in groups[r["a"]] for y in groups[r["b"]]}
    told |= {(x, y) for g in groups.values() for x in g for y in g if x < y}
    want = {(r["a"], r["b"]) for r in dedup.near_pairs(prints, threshold=8).collect()}
    assert told == want and len(want) > more.count() / 2
    n = {}
    for x, y in want:
        n[x], n[y] = n.get(x, 0) + 1, n.get(y, 0) + 1
    assert {r["key"]: r["n_links"] for r in members} == {k: n.get(k, 0) for k in of}
    prints.unpersist()
