"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

Each paragraph's digest is put into one cell of each of three sub-tables. Two versions' sketches are
subtracted cell by cell, what they share cancels, and peeling cells that hold one
digest recovers those that differ. Where peeling gets stuck, the pair is tried
again with larger sketches, until none is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.hashing import mix
from siftwork.session import stored

CELLS, GROWTH, PARTS = 24, 4, 3
BATCH_BYTES = 64 << 20
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u8")])


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each key in each sub-table."""
    part = cells // PARTS
    return np.stack([(mix(keys ^ mix(np.uint64(cells * PARTS + j) * np.ones(1, np.uint64))) % np.uint64(part)).astype(np.int64) + j * part for j in range(PARTS)])


def sketch(sets: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """One row of cells for each set of digests."""
    out = np.zeros(len(sets) * cells, CELL)
    if len(sets) and (keys := np.concatenate(sets).astype(np.uint64)).size:
        at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * cells
        check = _check(keys)
        for p in _places(keys, cells):
            np.add.at(out["count"], at + p, 1)
            np.bitwise_xor.at(out["key"], at + p, keys)
            np.bitwise_xor.at(out["check"], at + p, check)
    return out.reshape(len(sets), cells)


def subtract(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty_like(a)
    out["count"], out["key"], out["check"] = a["count"] - b["count"], a["key"] ^ b["key"], a["check"] ^ b["check"]
    return out


def peel(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of differences of sketches: row, digest and sign of what was recovered, and by row whether that is all."""
    n, cells = d.shape
    d = d.copy().reshape(-1)
    rows, keys, signs = [], [], []
    while True:
        pure = np.flatnonzero((np.abs(d["count"]) == 1) & (d["check"] == _check(d["key"])))
        if not len(pure):
            break
        found = np.empty(len(pure), np.dtype([("row", "<i8"), ("key", "<u8"), ("sign", "<i4")]))
        found["row"], found["key"], found["sign"] = pure // cells, d["key"][pure], d["count"][pure]
        found = np.unique(found)
        rows.append(found["row"])
        keys.append(found["key"])
        signs.append(found["sign"])
        check = _check(found["key"])
        for p in _places(found["key"], cells):
            at = found["row"] * cells + p
            np.subtract.at(d["count"], at, found["sign"])
            np.bitwise_xor.at(d["key"], at, found["key"])
            np.bitwise_xor.at(d["check"], at, check)
        if len(rows) > 4 * cells:
            break
    whole = ~((d["count"] != 0) | (d["key"] != 0) | (d["check"] != 0)).reshape(n, cells).any(axis=1)
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return cat(rows, np.int64), cat(keys, np.uint64), cat(signs, np.int32), whole


def paragraph_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digests``: the sorted set of the 60-bit digests of the non-blank lines of the texts of each non-null id.

    Texts of one id are taken together. Null, empty and blank texts add nothing, but their id keeps its row.
    """
    line = F.explode_outer(F.filter(F.split(F.col(text_col).cast("string"), "\n"), lambda p: F.length(F.trim(p)) > 0)).alias("p")
    lines = docs.select(F.col(id_col).alias("id"), line).filter("id is not null")
    digest = F.conv(F.substring(F.md5("p"), 1, 15), 16, 10).cast("long")
    return lines.select("id", digest.alias("digest")).groupBy("id").agg(F.array_sort(F.collect_set("digest")).alias("digests"))


def stretched(sets: DataFrame) -> DataFrame:
    """``sets`` with ``stretch``, the number of the range of ids that a row lies in, ascending with the ids; stored."""
    return stored(sets.repartitionByRange("id").withColumn("stretch", F.spark_partition_id()), "paragraphs")


def previous_versions(sets: DataFrame) -> DataFrame:
    """``id``, ``prev``: of the ids that come next before it among those with one of its paragraphs, the one met most often (the greatest on a tie).

    ``sets`` is that of ``stretched``. Ids of any type are looked up within their stretch first, so that a paragraph which
    very many documents have is spread over tasks.
    """
    p = sets.select("id", F.explode("digests").alias("digest"), F.col("stretch").alias("s"))
    p = p.withColumn("near", F.lag("id").over(Window.partitionBy("digest", "s").orderBy("id")))
    last = p.groupBy("digest", "s").agg(F.max("id").alias("last"))
    last = last.withColumn("far", F.lag("last").over(Window.partitionBy("digest").orderBy("s"))).filter("far is not null").select(F.col("digest").alias("d2"), F.col("s").alias("s2"), "far")
    p = p.join(last, (F.col("digest") == F.col("d2")) & (F.col("s") == F.col("s2")), "left")
    pairs = p.select("id", F.coalesce("near", "far").alias("prev")).filter("prev is not null").groupBy("id", "prev").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("id").agg(F.max(F.struct("n", "prev")).alias("m")).select("id", F.col("m.prev").alias("prev"))


def closest_versions(sets: DataFrame) -> DataFrame:
    """``id``, ``prev``: of all earlier ids the one that shares the most paragraphs; on a tie the one that ``previous_versions`` names, else the greatest.

    ``sets`` is that of ``stretched``. Ids with the same shared paragraphs form a group, and pairs are counted once for a group. An id
    that shares more than the ``shared`` of ``previous_versions`` holds one of all but ``shared`` of the
    paragraphs that were met before; the rarest of these are looked up, so the choice is exact at any frequency.
    """
    lag = previous_versions(sets)
    one = sets.select("id", F.explode("digests").alias("digest"))
    often = one.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 1").drop("n")
    met = one.join(often, "digest").select("id", "digest", (F.col("id") > F.col("first")).alias("before"))
    met = stored(met.groupBy("id").agg(F.array_sort(F.collect_list("digest")).alias("digests"), F.array_sort(F.collect_list(F.when(F.col("before"), F.col("digest")))).alias("known")), "met")
    group = F.min("id").over(Window.partitionBy(F.md5(F.array_join("digests", ","))))
    member = stored(met.select("id", group.alias("gid")), "groups")
    group = stored(met.join(member.filter("id = gid"), "id").select(F.col("id").alias("gid"), F.col("digests").alias("has")), "shared")
    post = group.select("gid", F.explode("has").alias("digest"))
    count = post.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    old = met.select(F.col("id").alias("prev"), F.col("digests").alias("has"))
    asks = lag.join(met, "id").join(old, "prev").select("id", "prev", "known", F.size(F.array_intersect("known", "has")).alias("shared"))
    asks = stored(asks, "asks")
    open_ = asks.filter(F.size("known") > F.col("shared"))
    rare = open_.select("id", "shared", F.explode("known").alias("digest")).join(count, "digest")
    rare = rare.groupBy("id", "shared").agg(F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("r"))
    rare = rare.select("id", F.explode(F.expr("slice(r, 1, size(r) - shared)")).alias("r")).select("id", F.col("r.digest").alias("digest"))
    pairs = rare.join(post, "digest").filter("gid < id").select("id", "gid")
    pairs = pairs.join(open_.select("id", "known", "shared"), "id").join(group, "gid")
    pairs = pairs.select("id", "gid", "shared", F.size(F.array_intersect("known", "has")).alias("n")).filter("n > shared")
    best = pairs.groupBy("id").agg(F.max("n").alias("most"))
    # Pairs are found anew for the ties, so that not every one of them is stored.
    ties = pairs.join(best, "id").filter("n = most").select("gid", "id").distinct()
    # The last member of a group that comes before the id that asks.
    at = ties.select("gid", "id", F.lit(0).alias("k")).unionByName(member.select("gid", "id", F.lit(1).alias("k")))
    w = Window.partitionBy("gid").orderBy("id", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = at.withColumn("m", F.last(F.when(F.col("k") == 1, F.col("id")), ignorenulls=True).over(w)).filter("k = 0")
    better = last.groupBy("id").agg(F.max("m").alias("better"))
    return asks.select("id", "prev").join(better, "id", "left").select("id", F.coalesce("better", "prev").alias("prev"))


def _sketches(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A batch's sketches are made in slices of bounded size.
            step = max(1, BATCH_BYTES // (cells * CELL.itemsize))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column(1)
                ends = lists.offsets.to_numpy()
                flat = lists.values.to_numpy(zero_copy_only=False)
                rows = sketch([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)], cells)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "sketch"])

    return run


def fingerprints(sets: DataFrame, cells: int = CELLS) -> DataFrame:
    """``id``, ``sketch``: the cells of each set of digests, in bytes."""
    kind = sets.schema["id"].dataType.simpleString()
    return sets.select("id", "digests").mapInArrow(_sketches(cells), f"id {kind}, sketch binary")


def _peeled(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), CELL).reshape(n, cells) for i in (2, 3))
            rows, keys, signs, whole = peel(subtract(a, b))
            order = np.lexsort((keys, rows))
            rows, keys, signs = rows[order], keys[order].astype(np.int64), signs[order]
            sides = []
            for sign in (1, -1):
                on = signs == sign
                ends = np.concatenate([[0], np.cumsum(np.bincount(rows[on], minlength=n))]).astype(np.int32)
                sides.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[on])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sides, pa.array(whole)], names=["id", "prev", "added", "removed", "whole"])

    return run


def differences(sets: DataFrame, pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """``id``, ``prev``, ``added``, ``removed``, ``cells``: for each pair of ids the sorted digests that only one of both has.

    ``sets`` and ``pairs`` are read once for every size tried, so they should be stored. Pairs
    whose ids have no set are left out.
    """
    spark = sets.sparkSession
    kind = sets.schema["id"].dataType.simpleString()
    out = None
    key, kept = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    left = pairs.select("id", "prev")
    while True:
        ids = left.select("id").union(left.select(F.col("prev").alias("id"))).distinct()
        sk = fingerprints(sets.join(ids, "id", "left_semi"), cells)
        new, old = sk.select("id", F.col("sketch").alias("new")), sk.select(F.col("id").alias("prev"), F.col("sketch").alias("old"))
        both = left.join(new, "id").join(old, "prev").select("id", "prev", "new", "old")
        try:
            spark.conf.set(key, max(1, min(int(kept), BATCH_BYTES // (2 * cells * CELL.itemsize))))
            done = stored(both.mapInArrow(_peeled(cells), f"id {kind}, prev {kind}, added array<bigint>, removed array<bigint>, whole boolean"), "peeled")
        finally:
            spark.conf.set(key, kept)
        good = done.filter("whole").select("id", "prev", "added", "removed", F.lit(cells).alias("cells"))
        out = good if out is None else out.unionByName(good)
        left = done.filter("not whole").select("id", "prev")
        if left.isEmpty():
            return out
        cells *= GROWTH


def version_diffs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS, closest: bool = False) -> DataFrame:
    """``id``, ``n_paragraphs``, ``prev``, ``added``, ``removed``: every non-null id, with what changed since its previous version.

    The previous version is that of ``previous_versions``, or with ``closest`` that of ``closest_versions``.
    The last three are null where no earlier id shares a paragraph. Columns other than the id and the text are ignored;
    an empty table gives an empty result, and texts of any length are taken whole: one of many paragraphs has a row of as many digests.
    """
    sets = stretched(paragraph_sets(docs, id_col, text_col))
    pairs = stored((closest_versions if closest else previous_versions)(sets), "versions")
    diff = differences(sets, pairs, cells).withColumnRenamed("id", "i")
    return sets.join(diff, F.col("id") == F.col("i"), "left").select("id", F.size("digests").alias("n_paragraphs"), "prev", "added", "removed")
