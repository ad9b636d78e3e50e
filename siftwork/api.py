"""What an agent or a command line asks for: pack, statistics, feedback, weights. All give text."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siftwork.config import Config
from siftwork.functions.scores import Budget, Weights
from siftwork.operators import feedback as fb
from siftwork.operators import scan
from siftwork.plans.pack import pack
from siftwork.sources import files
from siftwork.sources.feedback_store import Store

LEVELS = ("l1", "l2", "l3", "stats")
_NAMES = {"typescript": "TypeScript", "javascript": "JavaScript"}


def store_of(spark: SparkSession, root: str, config: Config) -> Store:
    """The feedback tables of a corpus."""
    f = config.feedback.folder
    return Store(spark, f if f.startswith("/") or "://" in f else f"{root.rstrip('/')}/{f}")


def pack_context(spark: SparkSession, root: str, budget: int = 128_000, output: str = "l3", focus: Sequence[str] = (), include_signatures: bool = False, config: Config | None = None, feedback: bool = True) -> str:
    """The packed context at one level (an unknown one means l3), after the session's id where feedback is on."""
    config = config or Config.find(root)
    result = pack(spark, root, Budget(budget), focus, config, include_signatures, store=store_of(spark, root, config) if feedback else None)
    body = result.text(output if output in LEVELS else "l3")
    return f"<!-- session_id: {result.session_id} -->\n{body}" if feedback else body


def index_stats(spark: SparkSession, root: str, config: Config | None = None) -> str:
    """Files, tokens and files by language."""
    config = config or Config.find(root)
    entries = files.discover(spark, root, config.scan_options(), with_ast=False)
    total = scan.index_stats(entries).first()
    by = [(r["language"], r["files"]) for r in scan.histogram(entries).collect()]
    names = [f"  {_NAMES.get(k, k.capitalize())}: {n}" for k, n in by]
    return "\n".join([f"Repository: {root}", f"Files: {total['files']}", f"Total tokens: {total['tokens']}", "", "By language:", *names]) + "\n"


def submit_feedback(spark: SparkSession, root: str, session_id: str, response: str, config: Config | None = None) -> str:
    """Score a session's files by the identifiers that a response names; raises FeedbackError for an unknown session."""
    config = config or Config.find(root)
    store = store_of(spark, root, config)
    session = store.get_session(session_id)
    records = store.records(session_id)
    full = files.contents(session["repo"], records.withColumnRenamed("file_path", "path")).withColumnRenamed("path", "file_path")
    said = spark.createDataFrame([(session_id, response)], "session_id string, text string")
    used = fb.session_utilization(full.select("session_id", "file_path", F.coalesce("content", F.lit("")).alias("content")), said)
    new = records.drop("utilization").join(used.select("file_path", F.col("utilization").cast("double").alias("utilization")), "file_path")
    store.record(new)
    row = store.records(session_id).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("utilization"), F.lit(0.0)).alias("u")).first()
    return f"Feedback recorded for session {session_id}: {row['n']} files, avg utilization {row['u']:.3f}\n"


def _lines(w: Weights) -> list[str]:
    return [f"  {k + ':':<12}{v:.4f}" for k, v in zip(("recency", "size", "proximity", "dependency"), w.as_tuple(), strict=True)]


def learned_weights(spark: SparkSession, root: str, run_learning: bool = False, config: Config | None = None) -> str:
    """The newest learned weights, after a learning cycle if asked for."""
    config = config or Config.find(root)
    store = store_of(spark, root, config)
    if run_learning:
        few = config.feedback.strict and store.stats()["sessions"] < config.feedback.min_sessions
        w = None if few else store.learn(config.weights, config.feedback.learning_rate, int(time.time()))
        if w is None:
            return "Nothing to learn from yet; the default weights stay.\n"
        return "\n".join(["Learning cycle complete. Updated weights:", *_lines(w), ""])
    row = store.latest_weights()
    if row is None:
        return "\n".join(["No learned weights yet. Using defaults:", *_lines(config.weights), ""])
    w = Weights(row["recency"], row["size"], row["proximity"], row["dependency"])
    return "\n".join([f"Learned weights (from {row['created_at']}):", *_lines(w), f"  {'avg_util:':<12}{row['avg_utilization']:.4f}", ""])


def feedback_stats(spark: SparkSession, root: str, config: Config | None = None) -> str:
    config = config or Config.find(root)
    s = store_of(spark, root, config).stats()
    avg = "(no data)" if s["avg_utilization"] is None else f"{s['avg_utilization']:.4f}"
    return f"Feedback statistics:\n  Sessions:         {s['sessions']}\n  Feedback records: {s['records']}\n  Avg utilization:  {avg}\n"
