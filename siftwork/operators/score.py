"""Scoring of entries: signals, composite score, feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import paths, scores


def score_entries(
    entries: DataFrame,
    as_of: Column,
    weights: scores.Weights = scores.Weights(),
    focus: Sequence[str] = (),
    distances: DataFrame | None = None,
    multipliers: DataFrame | None = None,
    key: str = "path",
) -> DataFrame:
    """Entries with ``recency``, ``size_score``, ``proximity``, ``dependency`` and ``composite_score``.

    Entries have ``key``, ``token_count``, ``last_modified`` and, where known, ``age_days``. ``distances`` has ``node`` and ``distance``; ``multipliers`` has ``path`` and ``multiplier``.
    """
    commit_age = F.col("age_days") if "age_days" in entries.columns else F.lit(None).cast("double")
    df = entries
    if distances is not None:
        d = distances.select(F.col("node").alias("_node"), F.col("distance").alias("_distance"))
        df = df.join(d, F.col(key) == F.col("_node"), "left").drop("_node")
    else:
        df = df.withColumn("_distance", F.lit(None).cast("int"))
    df = df.withColumns(
        {
            "recency": scores.recency(scores.entry_age_days(commit_age, F.col("last_modified"), as_of)),
            "size_score": scores.size_signal(F.col("token_count")),
            "proximity": paths.proximity(F.col(key), focus),
            "dependency": scores.dependency(F.col("_distance")),
        }
    ).drop("_distance")
    df = df.withColumn("composite_score", scores.composite(F.col("recency"), F.col("size_score"), F.col("proximity"), F.col("dependency"), weights))
    return apply_feedback(df, multipliers, key) if multipliers is not None else df


def apply_feedback(scored: DataFrame, multipliers: DataFrame, key: str = "path", score: str = "composite_score") -> DataFrame:
    """Scores times their path's multiplier, where there is one."""
    m = multipliers.select(F.col("path").alias("_path"), F.col("multiplier").alias("_m"))
    return scored.join(m, F.col(key) == F.col("_path"), "left").withColumn(score, scores.with_feedback(F.col(score), F.col("_m"))).drop("_path", "_m")
