"""The corpus pipeline: quality, near-duplicates, personal data, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwork.llm import bpe, mixing, near_dedup, pii, quality
from siftwork.session import spread, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, rejects go; so do those without text (null, empty or blank). No other column matters; repeated rows are judged alike."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of least id (nulls last), on a tie the one least by its other columns. All columns stay as they are."""
    return near_dedup.keep_one(docs.select(*COLUMNS))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and ``n_chars`` follows. Null texts stay null; the field is trained for each run."""
    return pii.redacted(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as the root of their size. No source is thinned: the output is as large as that takes, and small sources repeat. Null sources are one source, null sizes count as 0."""
    return mixing.mix(docs.select(*COLUMNS), alpha=0.5, keep_all=True, seed=7, keep_cols=COLUMNS).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, in place of its text; null for a null text."""
    return bpe.tokenized(docs, keep_cols=["doc_id", "lang", "source"])


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read by the next. An empty table passes through all of them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
