"""Exact and near duplicates: digests, simhash fingerprints, banded candidates, connected components."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import forget, stored

SHINGLE, BANDS, THRESHOLD = 3, 4, 3


def exact_dedup(df: DataFrame, digest: Column, order: str) -> DataFrame:
    """The first row by ``order`` of each digest. Null digests are duplicates of each other."""
    n = F.row_number().over(Window.partitionBy(digest).orderBy(order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")


def exact_dedup_stats(df: DataFrame, digest: Column) -> DataFrame:
    """``total``, ``kept``, ``removed``."""
    d = df.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kept")).withColumn("removed", F.col("total") - F.col("kept"))


def fingerprint(text: str, k: int = SHINGLE) -> int:
    """64 majority votes over the digests of the k-word shingles; 0 without words."""
    words = text.split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    raw = np.frombuffer(b"".join([hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:8] for g in grams]), np.uint8).reshape(-1, 8)
    votes = np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(grams)).tobytes(), "big", signed=True)


def simhash(df: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """``key``, ``simhash``; null texts have null fingerprints."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [None if t is None else fingerprint(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], names=["key", "simhash"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, simhash bigint")


def simhash_column(text: Column, k: int = SHINGLE) -> Column:
    """The fingerprint as a column; null texts have none."""

    @F.pandas_udf("bigint")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fingerprint(t, k) for t in texts], dtype="Int64")

    return run(text.cast("string"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def lsh_bands(fp: Column, n: int = BANDS) -> Column:
    """``n`` bands of equal width, the lowest bits first, each cut to 16 bits."""
    if n <= 0:
        return F.array().cast("array<int>")
    width = 64 // n
    mask = (1 << min(width, 16)) - 1
    return F.array(*[F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask)).cast("int") for i in range(n)])


def _masks(threshold: int, bands: int) -> list[int]:
    """Bits of which all must agree, in at least one mask, for a pair to be a candidate.

    Four bands find every pair within three bits, and so does any three of six blocks, with buckets 65,536
    times smaller; these stand in for the bands where they find the same.
    """
    if bands == 4 and threshold <= 3:
        cuts = [0, 11, 22, 33, 44, 54, 64]
        blocks = [((1 << (q - p)) - 1) << p for p, q in itertools.pairwise(cuts)]
        found = [x | y | z for x, y, z in itertools.combinations(blocks, 3)]
    else:
        width = 64 // bands
        found = [((1 << min(width, 16)) - 1) << (i * width) for i in range(bands)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def near_pairs(prints: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """``a``, ``b`` (a < b), ``distance``: keys whose fingerprints share a band and differ in at most ``threshold`` bits.

    Null fingerprints match nothing.
    """
    masks = _masks(threshold, bands)
    keys = F.array(*[F.col("simhash").bitwiseAND(F.lit(m)) for m in masks])
    p = prints.filter("simhash is not null").select("key", "simhash", F.posexplode(keys).alias("mask", "value"))
    left = p.select(F.col("key").alias("a"), F.col("simhash").alias("x"), "mask", "value")
    right = p.select(F.col("key").alias("b"), F.col("simhash").alias("y"), F.col("mask").alias("mask2"), F.col("value").alias("value2"))
    # Spark takes a row exploded by all masks for a single one and would broadcast many times its threshold.
    met = left.join(right.hint("merge"), (F.col("mask") == F.col("mask2")) & (F.col("value") == F.col("value2")) & (F.col("a") < F.col("b")) & (hamming(F.col("x"), F.col("y")) <= threshold))
    # The pair is told by the first mask on which both agree.
    differ = F.col("x").bitwiseXOR(F.col("y"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return met.filter(F.col("mask") == first).select("a", "b", hamming(F.col("x"), F.col("y")).alias("distance"))


def members(prints: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """``key``, ``lead`` (the least key of its fingerprint), ``n_links``: how many other keys ``near_pairs`` pairs it with, counted without listing pairs of copies.

    Null fingerprints are left out.
    """
    p = prints.filter("simhash is not null")
    lead = p.groupBy("simhash").agg(F.min("key").alias("lead"), F.count(F.lit(1)).alias("copies"))
    pairs = near_pairs(lead.select(F.col("lead").alias("key"), "simhash"), threshold, bands)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p")).select("p.*")
    others = both.join(lead.select(F.col("lead").alias("y1"), "copies"), F.col("y") == F.col("y1")).groupBy("x").agg(F.sum("copies").alias("others"))
    total = lead.join(others, F.col("lead") == F.col("x"), "left").select(F.col("simhash").alias("s"), "lead", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return p.join(total, F.col("simhash") == F.col("s")).select("key", "lead", "n_links")


def near_links(prints: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """``a``, ``b``: pairs enough to connect what ``near_pairs`` connects; equal fingerprints are linked to one of them only."""
    lead = prints.filter("simhash is not null").groupBy("simhash").agg(F.min("key").alias("lead"))
    same = prints.join(lead.withColumnRenamed("simhash", "s"), F.col("simhash") == F.col("s")).filter("key > lead").select(F.col("lead").alias("a"), F.col("key").alias("b"))
    near = near_pairs(lead.select(F.col("lead").alias("key"), "simhash"), threshold, bands).select("a", "b")
    return same.unionByName(near)


def components(links: DataFrame) -> DataFrame:
    """``key``, ``label``: each linked key with the least key it is connected with.

    Alternating large and small stars, each round written to the shared folder.
    """
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "links")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        before, now = now, stored(small.select(F.explode(ends).alias("e")).select("e.*").filter("u > v").distinct(), "links")
        forget(before)
        found = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == mark:
            roots = now.select(F.col("v").alias("key")).distinct()
            return now.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(roots.select("key", F.col("key").alias("label")))
        mark = found


def near_groups(prints: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """``key``, ``label`` of the keys that have near duplicates; groups are transitive."""
    return components(near_links(prints, threshold, bands))


def near_dedup(df: DataFrame, prints: DataFrame, key: str, threshold: int = THRESHOLD, bands: int = BANDS) -> DataFrame:
    """``df`` without all but the least key of each near-duplicate group."""
    gone = near_groups(prints, threshold, bands).filter("key <> label").select(F.col("key").alias("_gone"))
    return df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
