"""Sessions, feedback records and learned weights as tables in one folder.

Each call appends a version of the rows it writes; readers take the newest of each key, so that a
write never changes files that another job reads. ``compact`` appends the newest rows once more and only
then deletes the files that it read, so a crash in between leaves rows twice, of which readers take one.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.errors import FeedbackError
from siftwork.functions.scores import Weights
from siftwork.operators import feedback as fb
from siftwork.sources.files import uri

SESSIONS = "id string, repo string, budget bigint, created_at bigint, _v bigint"
RECORDS = "session_id string, file_path string, token_count bigint, composite_score double, was_selected boolean, utilization double, _v bigint"
WEIGHTS = "recency double, size double, proximity double, dependency double, avg_utilization double, created_at bigint, _v bigint"
_TABLES = {"sessions": (SESSIONS, ["id"]), "feedback": (RECORDS, ["session_id", "file_path"]), "weights": (WEIGHTS, ["created_at", "_v"])}


@dataclass
class Store:
    """The tables below ``folder``; those that don't exist are empty."""

    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{uri(self.folder)}/{name}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str) -> DataFrame:
        schema, keys = _TABLES[name]
        if not self._exists(self._path(name)):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(self._path(name))
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_v")))
        return rows.withColumn("_n", n).filter("_n = 1").drop("_n")

    def _append(self, name: str, rows: DataFrame) -> None:
        schema = self.spark.createDataFrame([], _TABLES[name][0]).schema
        v = F.lit(time.time_ns())
        rows = rows.withColumn("_v", v)
        rows.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("append").parquet(self._path(name))

    def compact(self, name: str) -> None:
        """Write the newest rows anew, then delete the files that held them and their older versions. Rows appended meanwhile are in files of their own and stay."""
        if not self._exists(self._path(name)):
            return
        old = self.spark.read.schema(_TABLES[name][0]).parquet(self._path(name)).inputFiles()
        self._read(name).write.mode("append").parquet(self._path(name))
        jvm = self.spark.sparkContext._jvm
        for file in old:
            p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)

    def create_session(self, id_: str, repo: str, budget: int, created_at: int) -> None:
        self._append("sessions", self.spark.createDataFrame([(id_, repo, budget, created_at)], "id string, repo string, budget bigint, created_at bigint"))

    def sessions(self) -> DataFrame:
        return self._read("sessions").drop("_v")

    def get_session(self, id_: str) -> dict:
        row = self.sessions().filter(F.col("id") == id_).first()
        if row is None:
            raise FeedbackError(f"session not found: {id_}")
        return row.asDict()

    def record(self, records: DataFrame) -> None:
        """Insert or replace by session and file."""
        self._append("feedback", records)

    def records(self, session_id: str | None = None) -> DataFrame:
        out = self._read("feedback").drop("_v")
        return out if session_id is None else out.filter(F.col("session_id") == session_id).orderBy(F.desc("composite_score"), "file_path")

    def with_utilization(self) -> DataFrame:
        return fb.with_utilization(self.records())

    def stats(self) -> dict:
        return fb.feedback_stats(self.sessions(), self.records()).first().asDict()

    def save_weights(self, w: Weights, avg_utilization: float, created_at: int) -> None:
        row = [(*map(float, w.as_tuple()), float(avg_utilization), created_at)]
        self._append("weights", self.spark.createDataFrame(row, "recency double, size double, proximity double, dependency double, avg_utilization double, created_at bigint"))

    def latest_weights(self) -> dict | None:
        row = fb.latest(self._read("weights")).drop("_v").first()
        return None if row is None else row.asDict()

    def learn(self, current: Weights, rate: float, now: int) -> Weights | None:
        """One learning cycle: the new weights, kept as a snapshot; None without any feedback."""
        row = fb.updated_weights(self.with_utilization(), current, rate).first()
        if not row["records"]:
            return None
        w = Weights(row["recency"], row["size"], row["proximity"], row["dependency"])
        self.save_weights(w, row["avg_utilization"], now)
        return w
