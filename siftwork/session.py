"""Session construction and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Where this process has stored tables.
_made: list[str] = []


def local_session(cores: int | None = None, memory: str = "12g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("siftwork")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="siftwork-")
    spark.conf.set(CHECKPOINT_KEY, made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: whatever reads the result survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def forget(df: DataFrame) -> None:
    """Delete the table behind what ``stored`` gave, once nothing reads it any more."""
    _delete(df.sparkSession, df._stored_at)


def release(spark: SparkSession) -> int:
    """Delete all tables that this process has stored and not forgotten; how many. Results that still read them must have been written."""
    paths = list(_made)
    for p in paths:
        _delete(spark, p)
    return len(paths)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` redistributed by ``key`` where its scan has fewer splits than the session has cores, so that all of them work.

    What is shuffled is at most one split for each core; a table of as many splits or more is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
