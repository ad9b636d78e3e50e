"""Layered output: skeleton lines, metadata blocks, full contents, statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.operators.ranking import ranked

LINE_TOKENS = 12


def _three(c: Column) -> Column:
    return F.format_string("%.3f", F.bround(c.cast("double"), 3))


def l1_prefix(scored: DataFrame, max_tokens: int, key: str = "path", score: str = "composite_score", signatures: str | None = None) -> DataFrame:
    """Rows by descending score, with ``rank``, while their lines fit; at least one."""
    n = F.coalesce(F.size(signatures), F.lit(0)) if signatures else F.lit(0)
    r = ranked(scored, F.col(score).cast("double"), [key], LINE_TOKENS * (1 + F.greatest(n, F.lit(0))), rank="rank", cum="l1_tokens")
    return r.filter((F.col("l1_tokens") <= max_tokens) | (F.col("rank") == 1))


def l1_lines(prefix: DataFrame, key: str = "path", signatures: str | None = None) -> DataFrame:
    """``rank``, ``text``: a line for each file, and one for each signature below it."""
    line = F.format_string("%s  [%d tokens, score=%s]", F.col(key).cast("string"), F.col("token_count"), _three(F.col("composite_score")))
    if signatures:
        below = F.transform(F.coalesce(signatures, F.array()), lambda s: F.format_string("\n  %s: %s", F.replace(F.initcap(F.replace(s["kind"], F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("")), s["text"]))
        line = F.concat(line, F.array_join(below, ""))
    return prefix.select("rank", line.alias("text"))


def l2_blocks(selected: DataFrame, key: str = "path") -> DataFrame:
    """``pick_order``, ``text``: a metadata block for each selected file."""
    s = F.format_string("recency=%s, size=%s, proximity=%s", _three(F.col("recency")), _three(F.col("size_score")), _three(F.col("proximity")))
    parts = [
        F.format_string("\n### %s\n- **Tokens**: %d\n- **Score**: %s\n- **Signals**: %s", F.col(key).cast("string"), F.col("token_count"), _three(F.col("composite_score")), s),
    ]
    if {"age_days", "commit_count"} <= set(selected.columns):
        git = F.format_string("\n- **Git**: %s days ago, %d commits", F.format_string("%.1f", F.bround("age_days", 1)), F.col("commit_count"))
        parts.append(F.when(F.col("age_days").isNotNull(), git).otherwise(F.lit("")))
    if "language" in selected.columns:
        name = F.col("language")
        parts.append(F.when(name.isNotNull(), F.concat(F.lit("\n- **Language**: "), F.when(name == "typescript", "TypeScript").when(name == "javascript", "JavaScript").otherwise(F.initcap(name)))).otherwise(F.lit("")))
    return selected.select("pick_order", F.concat(*parts).alias("text"))


def l3_files(selected: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """``pick_order``, ``text``: each selected file between its tags. Contents are not escaped; a missing one is empty."""
    body = F.coalesce(F.col(content).cast("string"), F.lit(""))
    body = F.when(body.endswith("\n"), body).otherwise(F.concat(body, F.lit("\n")))
    head = F.format_string('<file path="%s" tokens="%d" score="%s">\n', F.col(key).cast("string"), F.col("token_count"), _three(F.col("composite_score")))
    return selected.select("pick_order", F.concat(head, body, F.lit("</file>")).alias("text"))


@dataclass(frozen=True)
class PackStats:
    """What a pack did."""

    total_files_scanned: int
    duplicates_removed: int
    near_duplicates_removed: int
    files_selected: int
    tokens_used: int
    tokens_budget: int
    compression_ratio: float
    solver_used: str = ""


def format_stats(s: PackStats) -> str:
    rows = [("Files scanned", s.total_files_scanned), ("Duplicates removed", s.duplicates_removed)]
    if s.near_duplicates_removed:
        rows.append(("Near-dupes removed", s.near_duplicates_removed))
    share = s.tokens_used / max(s.tokens_budget, 1) * 100
    rows += [("Files selected", s.files_selected), ("Tokens used", f"{s.tokens_used} / {s.tokens_budget} ({share:.1f}%)"), ("Compression ratio", f"{s.compression_ratio:.2f}x")]
    if s.solver_used:
        rows.append(("Solver", s.solver_used))
    title = "Pack Stats"
    return "\n".join([title, "─" * len(title), *[f"  {k + ':':<20}{v}" for k, v in rows]]) + "\n"


def pack_stats(scanned: DataFrame, deduped: DataFrame, near: DataFrame, selected: DataFrame, budget: int) -> DataFrame:
    """One row of statistics; each input needs ``token_count``."""
    a = scanned.agg(F.count(F.lit(1)).alias("scanned"))
    b = deduped.agg(F.count(F.lit(1)).alias("exact_left"))
    c = near.agg(F.count(F.lit(1)).alias("near_left"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("left_tokens"))
    d = selected.agg(F.count(F.lit(1)).alias("files_selected"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens_used"))
    ratio = F.when(F.col("left_tokens") == 0, F.lit(1.0)).otherwise(F.col("left_tokens") / F.greatest("tokens_used", F.lit(1)))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).select(
        "scanned",
        (F.col("scanned") - F.col("exact_left")).alias("exact_removed"),
        (F.col("exact_left") - F.col("near_left")).alias("near_removed"),
        "files_selected",
        "tokens_used",
        F.lit(budget).cast("long").alias("tokens_budget"),
        F.round(ratio, 6).alias("compression_ratio"),
    )
