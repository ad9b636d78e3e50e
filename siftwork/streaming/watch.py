"""Changed files as a stream, and an index that follows them.

The file source tells new and rewritten files by path and time; files that are gone are found by
comparing a listing with the index. The source passes over names that begin with a dot or an underscore; ``missing`` finds
those, and whatever else an index lacks.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftwork.errors import WatchError
from siftwork.functions import paths
from siftwork.operators.scan import ScanOptions
from siftwork.session import shared_dir
from siftwork.sources import files, snapshot

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def changes(spark: SparkSession, root: str, most_files: int = 100_000) -> DataFrame:
    """A stream of ``path`` (relative), ``mtime``, ``size``, ``content`` of watched files outside of ignored folders."""
    base = files.uri(root)
    if base.startswith("file://") and not Path(base.removeprefix("file://")).is_dir():
        raise WatchError(f"no such folder: {root}")
    raw = spark.readStream.format("binaryFile").schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(base)
    rel = F.substring(F.regexp_replace(F.col("path"), r"^file:/+", "/"), len(base.removeprefix("file://")) + 2, 1 << 30)
    out = raw.select(rel.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
    return out.filter(paths.is_watched(F.col("path")) & ~paths.has_component(F.col("path"), [*paths.SKIPPED_WHEN_WATCHING, paths.OWN_STATE]))


def watch(spark: SparkSession, root: str, on_batch: Callable[[DataFrame, int], object], checkpoint: str | None = None, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
    """Call ``on_batch`` with each batch of changes; with ``available_now`` the query ends when all present files were seen."""
    at = checkpoint or f"{shared_dir(spark)}/watch"
    writer = changes(spark, root).writeStream.foreachBatch(on_batch).option("checkpointLocation", at)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def index_into(table: str, opts: ScanOptions = ScanOptions()) -> Callable[[DataFrame, int], None]:
    """A batch function that appends the changed files' entries, with the batch's number, to ``table``. A batch that is tried again takes the place of its first try."""

    def run(batch: DataFrame, number: int) -> None:
        kept = files.derive(batch.filter((F.col("size") <= opts.max_bytes) & F.col("content").isNotNull()), opts)
        kept.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return run


def latest(spark: SparkSession, table: str, listing: DataFrame | None = None) -> DataFrame:
    """The newest entry of each path of an index; with a listing (``path``), without files that are gone."""
    rows = spark.read.option("basePath", table).parquet(f"{table}/batch=*")
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("batch"), F.desc("mtime")))
    out = rows.withColumn("_n", n).filter("_n = 1").drop("_n", "batch")
    return out if listing is None else out.join(listing.select("path"), "path", "left_semi")


def missing(spark: SparkSession, root: str, table: str, opts: ScanOptions = ScanOptions()) -> DataFrame:
    """Entries of watched files that the index lacks or has with another time or size."""
    listed = files.listing(spark, root, opts, ignore_files=False).filter(paths.is_watched(F.col("path")))
    return files.derive(files.read(snapshot.fresh(listed, latest(spark, table)), root), opts)
