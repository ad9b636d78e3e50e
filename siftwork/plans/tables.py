"""The driver's tables as the engine's logical tables: entries, commits, feedback, edges, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.operators import history, score
from siftwork.session import spread, stored

#: Ages are counted from here; the events end two days before.
AS_OF = "2024-02-01 00:00:00"
_TEXTS = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # Tables of texts, whose rows are worth the shuffle.
    return spread(df, _TEXTS[name]) if name in _TEXTS else df


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def doc_path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))


def entries(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """``doc_id``, ``path``, ``token_count``, ``size_bytes``, ``language``, ``last_modified``, ``digest`` of every document.

    A document was last modified as many hours before AS_OF as it has hundreds of characters.
    """
    d = table(spark, sf_dir, "documents")
    modified = F.timestamp_seconds(F.unix_seconds(as_of()) - F.floor(F.col("n_chars") / 100).cast("long") * 3600)
    cols = [
        "doc_id",
        doc_path().alias("path"),
        text.token_estimate(F.col("text")).alias("token_count"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("lang").alias("language"),
        modified.alias("last_modified"),
        F.md5("text").alias("digest"),
    ]
    return d.select(*cols, *([F.col("text").alias("content")] if content else []))


def commits(spark: SparkSession, sf_dir: str, path: str = "user_id") -> DataFrame:
    """Events as commits of one hour each; what an event is about is the path, purchases delete it and signups add it."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "purchase", "D").when(F.col("event_type") == "signup", "A").otherwise("M")
    return e.select(F.floor(F.unix_seconds(ts) / 3600).cast("long").alias("commit_id"), ts.alias("ts"), F.col(path).cast("string").alias("path"), status.alias("status"))


def with_history(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Entries with ``age_days`` and ``commit_count``, null where no event is about the document's number."""
    h = history.commit_stats(commits(spark, sf_dir), as_of()).select(F.col("path").cast("long").alias("_u"), "age_days", "commit_count")
    return docs.join(h, F.col("doc_id") == F.col("_u"), "left").drop("_u")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored entries, one of each digest."""
    e = with_history(spark, sf_dir, entries(spark, sf_dir))
    first = e.groupBy("digest").agg(F.min_by(F.struct(*[c for c in e.columns if c != "digest"]), "doc_id").alias("s")).select("digest", "s.*")
    return score.score_entries(first, as_of())


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scored``, computed once for solvers that read it several times."""
    return stored(scored(spark, sf_dir).select("doc_id", "path", "token_count", "composite_score"), "scored")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback: a source is a session, quality is how much of the document was used."""
    d, y = entries(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_l"), "quality", "toxic")
    f = d.join(y, F.col("doc_id") == F.col("_l"))
    return f.select(
        F.substring_index("path", "/", 1).alias("session_id"),
        F.col("path").alias("file_path"),
        "token_count",
        (F.lit(1.0) / (F.col("token_count") + 1)).alias("composite_score"),
        (F.col("toxic") == 0).alias("was_selected"),
        F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("utilization"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts that they sell."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as source files of five languages, one for each region; each imports the nation of the same region with the next key."""
    n = table(spark, sf_dir, "nation")
    name = F.lower(F.regexp_replace("n_name", r"[^A-Za-z0-9]", "_"))
    nxt = F.coalesce(F.lead("_m").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")), F.lit("nowhere"))
    n = n.select("n_nationkey", "n_regionkey", name.alias("_m")).withColumn("_next", nxt)
    m, x = F.col("_m"), F.col("_next")
    lang = F.element_at(F.array(*[F.lit(v) for v in ("rust", "typescript", "javascript", "python", "go")]), F.col("n_regionkey").cast("int") + 1)
    ext = F.element_at(F.array(*[F.lit(v) for v in ("rs", "ts", "js", "py", "go")]), F.col("n_regionkey").cast("int") + 1)
    body = {
        "rust": F.format_string("use crate::%s;\npub fn run_%s(x: u8) -> u8 {\n    x\n}\n", x, m),
        "typescript": F.format_string('import a from "./%s";\ninterface Kind_%s {\n}\n', x, m),
        "javascript": F.format_string('import a from "./%s";\nfunction run_%s(x) {\n  return x;\n}\n', x, m),
        "python": F.format_string("from .%s import a\n\n\ndef run_%s(x):\n    return x\n", x, m),
        "go": F.format_string('package %s\n\nimport "src/%s"\n\nfunc Run_%s(x int) int {\n\treturn x\n}\n', m, x, m),
    }
    content = F.coalesce(*[F.when(lang == k, v) for k, v in body.items()])
    where = F.when(lang == "go", F.concat(F.lit("src/"), m, F.lit("/"), m)).otherwise(F.concat(F.lit("src/"), m))
    return n.select(F.concat(where, F.lit("."), ext).alias("path"), lang.alias("language"), content.alias("content"))
