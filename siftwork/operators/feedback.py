"""Feedback: utilization, multipliers, learned weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.scores import Weights
from siftwork.functions.text import utilization

HIGH = 0.5


def session_utilization(files: DataFrame, response: DataFrame) -> DataFrame:
    """``session_id``, ``file_path``, ``utilization`` of ``files`` (``session_id``, ``file_path``, ``content``) under ``response`` (``session_id``, ``text``).

    A session without response uses nothing.
    """
    r = response.select(F.col("session_id").alias("_s"), F.col("text").alias("_r"))
    return files.join(r, F.col("session_id") == F.col("_s"), "left").select("session_id", "file_path", utilization(F.col("content"), F.col("_r")).alias("utilization"))


def with_utilization(feedback: DataFrame) -> DataFrame:
    return feedback.filter("utilization is not null")


def multipliers(feedback: DataFrame) -> DataFrame:
    """``path``, ``multiplier``: a half plus the average utilization."""
    return with_utilization(feedback).groupBy(F.col("file_path").alias("path")).agg((F.lit(0.5) + F.avg("utilization")).alias("multiplier"))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("session_id", "file_path")) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys. The columns are those of ``old``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_new")


def feedback_stats(sessions: DataFrame, feedback: DataFrame) -> DataFrame:
    """``sessions``, ``records``, ``avg_utilization`` (null without any)."""
    s = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    return s.crossJoin(feedback.agg(F.count(F.lit(1)).alias("records"), F.avg("utilization").alias("avg_utilization")))


def updated_weights(feedback: DataFrame, current: Weights = Weights(), rate: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each group ``by`` that has used files: ``recency``, ``size``, ``proximity``, ``dependency``, ``records``, ``avg_utilization``.

    If well used files are smaller than others on average, size weighs 1.2 times as much, else 0.8; if others scored higher, recency weighs
    1.3 times as much. Weights move there by ``rate`` and are brought to sum 1. Without well used files they stay.
    """
    high, low = F.col("utilization") >= HIGH, F.col("utilization") < HIGH
    used = with_utilization(feedback)
    a = (used.groupBy(*by) if by else used).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(F.col("utilization").cast("double")).alias("avg_utilization"),
        F.count_if(high).alias("n_high"),
        F.count_if(low).alias("n_low"),
        F.avg(F.when(high, F.col("token_count"))).alias("t_high"),
        F.avg(F.when(low, F.col("token_count"))).alias("t_low"),
        F.avg(F.when(high, F.col("composite_score").cast("double"))).alias("s_high"),
        F.avg(F.when(low, F.col("composite_score").cast("double"))).alias("s_low"),
    )
    both = (F.col("n_low") > 0) & (F.col("n_high") > 0)
    size = F.when(both, F.when(F.col("t_high") < F.col("t_low"), 1.2).otherwise(0.8)).otherwise(1.0)
    recency = F.when(both & (F.col("s_low") > F.col("s_high")), 1.3).otherwise(1.0)
    factor = {"recency": recency, "size": size, "proximity": F.lit(1.0), "dependency": F.lit(1.0)}
    now = dict(zip(factor, current.as_tuple(), strict=True))
    moved = a.withColumns({k: F.lit((1.0 - rate) * now[k]) + F.lit(rate * now[k]) * f for k, f in factor.items()})
    total = F.col("recency") + F.col("size") + F.col("proximity") + F.col("dependency")
    learned = {k: F.when(F.col("n_high") > 0, F.col(k) / total).otherwise(F.lit(float(now[k]))).alias(k) for k in factor}
    return moved.select(*by, *learned.values(), "records", "avg_utilization")


def latest(snapshots: DataFrame) -> DataFrame:
    """The newest weights, the greatest on a tie."""
    return snapshots.orderBy(F.desc("created_at"), *[F.desc(c) for c in snapshots.columns if c != "created_at"]).limit(1)
