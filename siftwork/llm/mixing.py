"""Mixing sources to target weights by systematic sampling.

Each document has an expected number of copies, a fixed-point integer. Within
its source the copies are prefix-summed in an order given by a hash of the id, one
random offset is added, and a document is emitted once for each integer boundary that
its own stretch crosses. So the copies of a source differ from its target
by less than one, and a document's copies from its expectation by less than one.

The prefix sum runs in two levels: hash buckets are summed first, and only the
buckets' totals are summed in order, so a hot source is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1_000_000
BUCKET_HEX = 3


def _factor(name: str) -> Column:
    """A document's own factor in millionths."""
    f = F.col(name).cast("double")
    return F.when(f.isNull() | F.isnan(f) | (f < 0), F.lit(0)).otherwise(F.round(F.least(f, F.lit(1e6)) * UNIT)).cast("long")


def rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    keep_all: bool = False,
    source_col: str = "source",
    size_col: str = "n_chars",
    factor_col: str | None = None,
) -> DataFrame:
    """Expected copies per document of factor 1 of each source: ``source``, ``size``, ``weight``, ``rate`` (in millionths).

    ``weights`` are relative shares of the output's size; a source they lack gets none.
    Without them a source's share is its size to the power ``alpha``. ``total`` is the
    output's size, by default the input's; with ``keep_all`` it is the least at which
    no weighted source is thinned. Null sources form one source of their own, null sizes count as 0,
    and a source without size gets rate one if it has weight. With ``factor_col`` a document counts for its size times
    its factor (null, negative and NaN ones count as 0), so that the shares stay as they were set.
    """
    amount = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    amount = F.sum(amount) if factor_col is None else F.sum(amount * _factor(factor_col)) / UNIT
    s = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(amount.cast("long").alias("size"))
    if weights is None:
        s = s.withColumn("weight", F.sqrt(F.col("size").cast("double")) if alpha == 0.5 else F.pow(F.col("size").cast("double"), F.lit(float(alpha))))
    else:
        pairs = [(str(k), float(v)) for k, v in weights.items()]
        if any(v < 0 for _, v in pairs):
            raise ValueError("weights must not be negative")
        table = docs.sparkSession.createDataFrame(pairs, "source string, weight double")
        s = s.join(table, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    per_size = F.try_divide(F.col("weight"), F.col("size").cast("double"))
    if keep_all:
        scale = F.try_divide(F.lit(1.0), F.min(F.when((F.col("size") > 0) & (F.col("weight") > 0), per_size)))
    else:
        whole = F.lit(float(total)) if total is not None else F.sum("size").cast("double")
        scale = F.try_divide(whole, F.sum("weight"))
    # One row, so it can be broadcast whatever the number of sources.
    s = s.withColumn("_one", F.lit(1)).join(F.broadcast(s.agg(scale.alias("_scale")).withColumn("_one", F.lit(1))), "_one")
    scale = F.col("_scale")
    rate = F.when(F.col("size") > 0, F.round(per_size * scale * UNIT)).when(F.lit(weights is None) | (F.col("weight") > 0), F.lit(float(UNIT))).otherwise(F.lit(0.0))
    return s.select("source", "size", "weight", F.coalesce(rate, F.lit(0.0)).cast("long").alias("rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    keep_all: bool = False,
    seed: int = 0,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_chars",
    keep_cols: list[str] | None = None,
    factor_col: str | None = None,
) -> DataFrame:
    """The emitted copies: ``keep_cols`` (by default id, source) and ``copy_no`` from 1.

    A document expects its source's rate times its own factor from ``factor_col`` (a quality score, say), by default 1.
    Repeated ids and rows are sampled as rows of their own; rows that tie in id are
    ordered by size, then by a 64-bit digest of what is kept of them, so only rows that look the same can change places. Null ids share one place in the order. An empty
    input gives an empty result. A column of the input named ``copy_no`` is replaced. Texts of any length are passed on whole.
    """
    keep = [c for c in (keep_cols or [id_col, source_col]) if c != "copy_no"]
    src, place = F.col(source_col).cast("string"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bucket = F.substring(place, 1, BUCKET_HEX)
    key = F.concat(bucket, F.when(src.isNull(), "-").otherwise(F.concat(F.lit("+"), src)))
    own = F.lit(UNIT).cast("long") if factor_col is None else _factor(factor_col)
    sums = docs.select(src.alias("_s"), bucket.alias("_b"), key.alias("_k2"), own.alias("_f")).groupBy("_k2", "_s", "_b").agg(F.sum("_f").alias("_sum"))
    r = rates(docs, weights, alpha, total, keep_all, source_col, size_col, factor_col).select(F.col("source").alias("_s1"), F.col("rate").alias("_e"))
    ahead = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_s", F.lit("")))), 1, 8), 16, 10).cast("long") % UNIT
    plan = (
        sums.withColumn("_before", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
        .join(r, F.col("_s").eqNullSafe(F.col("_s1")))
        .select("_k2", "_e", offset.alias("_off"), "_before")
    )
    row = F.struct(*keep)
    rows = docs.select(row.alias("_row"), key.alias("_k"), place.alias("_h"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_n"), own.alias("_f"), F.xxhash64(*keep).alias("_tie"))
    # The prefix sum of the factors within a bucket; with what the earlier buckets hold it is that of the source.
    rows = rows.withColumn("_sum", F.sum("_f").over(Window.partitionBy("_k").orderBy("_h", "_n", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = rows.join(plan, F.col("_k") == F.col("_k2"))

    def crossed(sum_: str) -> Column:
        """Integer boundaries up to a prefix sum: offset plus rate times sum, floored. The product has up to 38 digits."""
        return F.expr(f"cast((_off + ({sum_}) * cast(_e as decimal(19, 0)) div {UNIT}) div {UNIT} as long)")

    out = out.withColumn("_c", (crossed("cast(_before + _sum as decimal(19, 0))") - crossed("cast(_before + _sum - _f as decimal(19, 0))")).cast("int")).filter("_c > 0")
    return out.select("_row.*", F.explode(F.sequence(F.lit(1), F.col("_c"))).alias("copy_no"))
