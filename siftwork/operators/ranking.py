"""Ranks and running sums over a whole table, or over groups of it, without one task sorting it all.

Rows fall into buckets: by the order of magnitude of their value, and rows of one magnitude by the range of (value, keys) that they lie in, so that even
a table of equal values is spread over tasks. Buckets are ranked among each other from their totals, rows within their bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import stored

STEPS = 64
_LOW = 1 << 16


def bucket(value: Column) -> Column:
    """Ascending as values descend; values that are not positive come last."""
    return F.when(value > 0, -F.floor(F.log2(value) * STEPS)).otherwise(F.lit(_LOW)).cast("int")


def ranked(df: DataFrame, value: Column, keys: Sequence[str], weight: Column | None = None, by: Sequence[str] = (), rank: str = "rank", cum: str | None = None) -> DataFrame:
    """``df`` with ``rank`` from 1 by descending value, then ascending keys, and the running sum ``cum`` of ``weight``.

    ``by`` names the columns of groups that are ranked each for itself; their nulls form one group.
    """
    by = list(by)
    rows = df.withColumns({"_v": value.cast("double"), "_w": F.lit(0).cast("long") if weight is None else weight.cast("long")})
    rows = rows.withColumn("_order", bucket(F.col("_v")))
    groups = [F.coalesce(F.col(c).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    # Ranges are cut at sampled quantiles of the order itself, so a bucket is a range, too; written, as a second sample could cut elsewhere.
    rows = rows.select("*", *groups).repartitionByRange("_order", F.desc("_v"), *keys, *names)
    rows = stored(rows.withColumn("_bucket", F.spark_partition_id()).drop("_order"), "ranges")
    sums = rows.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_s"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(n).alias(n + "x") for n in names],
        F.col("_bucket").alias("_bx"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"),
    )
    within = Window.partitionBy(*names, "_bucket").orderBy(F.desc("_v"), *keys)
    rows = rows.withColumn("_rn", F.row_number().over(within))
    if cum:
        rows = rows.withColumn("_cs", F.sum("_w").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    match = F.col("_bucket") == F.col("_bx")
    for n in names:
        match = match & (F.col(n) == F.col(n + "x"))
    out = rows.join(sums, match).withColumn(rank, F.col("_rn") + F.col("_n0"))
    if cum:
        out = out.withColumn(cum, F.col("_cs") + F.col("_s0"))
    return out.select(*[c for c in df.columns if c not in (rank, cum)], rank, *([cum] if cum else []))
