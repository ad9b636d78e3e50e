"""Commit history: how often and how lately paths were changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_COMMITS, MOST_CHANGES = 500, 100


def commit_stats(commits: DataFrame, as_of: Column, most_commits: int = MOST_COMMITS, most_changes: int = MOST_CHANGES) -> DataFrame:
    """``path``, ``commit_count``, ``latest``, ``age_days`` from ``commits`` (``commit_id``, ``ts``, ``path``, ``status``).

    The newest ``most_commits`` commits count (ties by greater id), and of a path's changes that add, modify or copy at most
    ``most_changes``. Ages are never negative; paths without such changes are left out.
    """
    # As many keys as the bound says, so they may be broadcast.
    newest = commits.groupBy("commit_id").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), F.desc("commit_id")).limit(most_commits).select(F.col("commit_id").alias("c"))
    seen = commits.join(F.broadcast(newest), F.col("commit_id") == F.col("c"), "left_semi").filter(F.col("status").isin("A", "M", "C"))
    out = seen.groupBy("path").agg(F.least(F.count(F.lit(1)), F.lit(most_changes)).cast("int").alias("commit_count"), F.max("ts").alias("latest"))
    age = F.greatest(F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("latest").cast("timestamp")), F.lit(0)) / F.lit(86400.0)
    return out.withColumn("age_days", age)
