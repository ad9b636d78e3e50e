"""The commit log of a local repository as a table; clusters bring their own."""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.history import MOST_COMMITS

SCHEMA = "commit_id string, ts timestamp, path string, status string"


def parse(raw: str) -> list[tuple[str, int, str, str]]:
    """(commit, seconds, path, status) of every change in ``git log --format=%x00%H%x01%ct --name-status`` output."""
    rows = []
    for block in raw.split("\0")[1:]:
        head, _, body = block.partition("\n")
        commit, _, seconds = head.partition("\1")
        for line in body.splitlines():
            status, _, names = line.partition("\t")
            if names:
                rows.append((commit, int(seconds), names.split("\t")[-1], status[:1]))
    return rows


def log(spark: SparkSession, root: str | Path, most: int = MOST_COMMITS) -> DataFrame | None:
    """The newest ``most`` commits against their first parents, paths relative to ``root``; None where there is no repository."""
    root = str(root)
    if "://" in root or not Path(root).exists():
        return None
    cmd = ["git", "-C", root, "-c", "core.quotepath=off", "log", f"-n{most}", "--first-parent", "-m", "--no-renames", "--relative", "--name-status", "--format=%x00%H%x01%ct"]
    try:
        done = subprocess.run(cmd, capture_output=True, text=True, timeout=120)
    except (FileNotFoundError, subprocess.TimeoutExpired):
        return None
    if done.returncode:
        return None
    rows = spark.createDataFrame(parse(done.stdout), "commit_id string, s bigint, path string, status string")
    return rows.select("commit_id", F.timestamp_seconds("s").alias("ts"), "path", "status")
