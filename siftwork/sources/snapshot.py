"""Persistent scan snapshots: what of a listing is known, what is new, what is gone; a versioned table with a manifest."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.scan import ScanOptions

SCHEMA_VERSION = 1


def _known(listing: DataFrame, snapshot: DataFrame, how: str) -> DataFrame:
    s = snapshot.select(F.col("path").alias("_p"), F.col("mtime").alias("_m"), F.col("size").alias("_s"), *([F.struct(*[c for c in snapshot.columns]).alias("_row")] if how == "inner" else []))
    return listing.join(s, (F.col("path") == F.col("_p")) & (F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), how)


def hits(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot's rows whose path, time and size the listing still has."""
    return _known(listing, snapshot, "inner").select("_row.*")


def fresh(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The listing's rows that the snapshot lacks or has with another time or size."""
    return _known(listing, snapshot, "left_anti")


def deleted(listing: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot's rows whose path the listing lacks."""
    return snapshot.join(listing.select("path"), "path", "left_anti")


def merged(known: DataFrame, derived: DataFrame) -> DataFrame:
    return known.unionByName(derived, allowMissingColumns=True)


def options_hash(opts: ScanOptions) -> str:
    """A digest of what a scan keeps; a snapshot made under another is not used."""
    return hashlib.sha256(json.dumps(asdict(opts), sort_keys=True).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def save(entries: DataFrame, folder: str, root: str, opts: ScanOptions) -> str:
    """Write the rows to a new version below ``folder``, then a manifest that names it, and only then delete the older manifests: a reader always finds one. Gives the version's path."""
    spark = entries.sparkSession
    version = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    entries.write.parquet(version)
    fs, path = _fs(spark, folder)
    manifest = json.dumps({"version": SCHEMA_VERSION, "options": options_hash(opts), "root": root, "table": version})
    old = _manifests(spark, folder)
    name = f"{folder.rstrip('/')}/manifest-{time.time_ns():020d}-{uuid.uuid4().hex}"
    out = fs.create(path(f"{name}.new"), True)
    try:
        out.write(bytearray(manifest.encode()))
    finally:
        out.close()
    if not fs.rename(path(f"{name}.new"), path(f"{name}.json")):
        raise OSError(f"the manifest in {folder} could not be written")
    for p in old:
        fs.delete(path(p), False)
    return version


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    """The manifests below ``folder``, the newest last."""
    fs, path = _fs(spark, folder)
    found = fs.globStatus(path(f"{folder.rstrip('/')}/manifest-*.json"))
    return sorted(f.getPath().toString() for f in found or [])


def load(spark: SparkSession, folder: str, root: str, opts: ScanOptions) -> DataFrame | None:
    """The snapshot's rows; None where there is none, or one of another version, root or options."""
    found = _manifests(spark, folder)
    if not found:
        return None
    raw = "\n".join(r[0] for r in spark.read.text(found[-1]).collect())
    try:
        m = json.loads(raw)
    except ValueError:
        return None
    if (m.get("version"), m.get("options"), m.get("root")) != (SCHEMA_VERSION, options_hash(opts), root):
        return None
    return spark.read.parquet(m["table"])
