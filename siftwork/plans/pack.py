"""From a corpus to the documents chosen under a budget, and their rendering."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.config import Config
from siftwork.functions import text
from siftwork.functions.scores import Budget, Weights
from siftwork.operators import dedup, graph, render, score, select
from siftwork.operators import feedback as fb
from siftwork.session import stored
from siftwork.sources import files
from siftwork.sources.feedback_store import Store

_ITEM = {"key": "path", "tokens": "token_count", "score": "composite_score", "path": "path"}


@dataclass
class PackResult:
    """``l1``, ``l2`` and ``l3`` hold one text per row in order, so that a large result need never be collected."""

    session_id: str
    selected: DataFrame
    l1: DataFrame
    l2: DataFrame
    l3: DataFrame
    stats: render.PackStats
    l1_total: int
    l1_budget: int

    def text(self, level: str = "l3") -> str:
        """One level as one string, collected; ``stats`` gives the statistics."""
        if level == "stats":
            return render.format_stats(self.stats)
        df = {"l1": self.l1, "l2": self.l2, "l3": self.l3}[level]
        lines = [r["text"] for r in df.orderBy(df.columns[0]).collect()]
        if level == "l1":
            head = f"{len(lines)}/{self.l1_total} files, truncated to {self.l1_budget} tokens" if len(lines) < self.l1_total else f"{self.l1_total} files"
            return "\n".join([f"<!-- L1: File Skeleton Map ({head}) -->", *lines, ""])
        if level == "l2":
            return "\n".join([f"<!-- L2: Dependency Cluster Expansion ({len(lines)} files) -->", *lines, ""])
        return "\n".join(["<context>", f"<!-- L3: Full Content Fragments ({len(lines)} files) -->", *lines, "</context>", ""])


def deduplicated(entries: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The entries after exact and after near duplicates are gone, the first by path of each group staying."""
    exact = stored(dedup.exact_dedup(entries, F.col("digest"), "path"), "exact") if config.dedup.exact else entries
    if not config.dedup.near:
        return exact, exact
    prints = exact.select(F.col("path").alias("key"), "simhash")
    return exact, stored(dedup.near_dedup(exact, prints, "path", config.dedup.hamming_threshold), "near")


def reached(spark: SparkSession, entries: DataFrame, focus: Sequence[str]) -> DataFrame:
    """Distances from the files that focus paths name or hold, through imports."""
    im = entries.filter("ast is not null").select(F.col("path").alias("src"), "language", F.explode("ast.imports.raw_path").alias("raw_path"))
    edges = graph.build_edges(stored(im, "imports"), entries.select("path"))
    named = reduce(Column.__or__, [(F.col("path") == f) | F.col("path").startswith(f.rstrip("/") + "/") for f in focus])
    return graph.distances(edges, entries.filter(named).select(F.col("path").alias("node")))


def pack(
    spark: SparkSession,
    root: str,
    budget: Budget = Budget(),
    focus: Sequence[str] = (),
    config: Config | None = None,
    signatures: bool = False,
    as_of: Column | None = None,
    state: str | None = None,
    store: Store | None = None,
    respect_focus: bool = False,
) -> PackResult:
    """Scan, deduplicate, score and select the files below ``root``.

    ``focus`` paths are relative to the root. Learned weights replace all others, unless ``respect_focus`` keeps those
    for focus paths. Contents are read again for selected files only; ``state`` is a folder for scan snapshots, ``store`` takes the session.
    """
    config = config or Config.find(root) if "://" not in str(root) else config or Config()
    as_of = F.current_timestamp() if as_of is None else as_of
    opts = config.scan_options()
    focus = [f.removeprefix("./").strip("/") for f in focus]
    entries = stored(files.discover(spark, root, opts, as_of, bool(focus) or signatures, state), "scanned")
    exact, near = deduplicated(entries, config)
    weights = Weights.focused() if focus else config.weights
    multipliers = None
    if store is not None:
        if (learned := store.latest_weights()) and not (focus and respect_focus):
            weights = Weights(learned["recency"], learned["size"], learned["proximity"], learned["dependency"])
        multipliers = fb.multipliers(store.records())
    far = reached(spark, near, focus) if focus else None
    scored = stored(score.score_entries(near, as_of, weights, focus, far, multipliers), "scored")
    chosen = stored(select.select(scored, budget.l3, config.selection.solver, config.selection.diversity, **_ITEM), "chosen")
    selected = stored(scored.join(chosen.withColumnRenamed("key", "_k"), F.col("path") == F.col("_k")).drop("_k"), "selected")
    with_sigs = scored.withColumn("signatures", F.col("ast.signatures"))
    l1 = render.l1_lines(render.l1_prefix(with_sigs, budget.l1, signatures="signatures" if signatures else None), signatures="signatures" if signatures else None)
    counts = render.pack_stats(entries, exact, near, selected, budget.total).first()
    stats = render.PackStats(counts["scanned"], counts["exact_removed"], counts["near_removed"], counts["files_selected"], counts["tokens_used"], budget.total, counts["compression_ratio"], config.selection.solver)
    now = time.time_ns()
    session = spark.range(1).select(text.session_id(F.lit(str(root)), F.lit(now))).first()[0]
    if store is not None:
        store.create_session(session, str(root), budget.total, now // 10**9)
        store.record(selected.select(F.lit(session).alias("session_id"), F.col("path").alias("file_path"), "token_count", F.col("composite_score").cast("double").alias("composite_score"), F.lit(True).alias("was_selected"), F.lit(None).cast("double").alias("utilization")))
    full = files.contents(root, selected)
    return PackResult(session, selected, l1, render.l2_blocks(selected), render.l3_files(full), stats, counts["scanned"] - counts["exact_removed"] - counts["near_removed"], budget.l1)
