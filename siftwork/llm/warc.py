"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; the exact header bytes and
whatever follows the payload are kept per record, and records come back
byte for byte through a join on the digest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "\r\n\r\n"
SUITE = "WARC/1.1"


@dataclass(frozen=True)
class Archive:
    """``headers``: id, header, tail, digest, declared, verified, record_digest. ``payloads``: digest, payload, n_refs, one_content."""

    headers: DataFrame
    payloads: DataFrame


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """One ``resource`` record per row: ``id``, ``record`` (BINARY).

    Null urls and ids become empty header values; a null payload is written as
    an empty one. Rows are never merged, so repeated rows give repeated records.
    Other columns are ignored.
    """
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), _text(F.col(payload_col)).cast("binary").alias("body"))
    head = F.concat(
        F.lit(f"{SUITE}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), _text(F.col("id")),
        F.lit(">\r\nWARC-Target-URI: "), _text(F.col("url")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"), F.sha2("body", 256),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("body").cast("string"),
        F.lit(BREAK),
    )
    return src.select("id", F.concat(head.cast("binary"), F.col("body"), F.lit(BREAK).cast("binary")).alias("record"))


def _parsed(recs: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """Split each record at its first blank line by the declared length.

    A record without a blank line is all header and has no payload. Where the
    declared length is missing or larger than what follows, the payload is
    everything after the header.
    """
    r = recs.select(F.col(id_col).alias("id"), F.col(record_col).cast("binary").alias("record"))
    top = F.substring_index(F.col("record").cast("string"), BREAK, 1)
    r = r.withColumn("top_len", F.octet_length(top.cast("binary")))
    split = F.col("top_len") < F.octet_length("record")
    r = r.withColumns(
        {
            "has_body": F.coalesce(split, F.lit(False)),
            "head_len": F.when(split, F.col("top_len") + len(BREAK)).otherwise(F.octet_length("record")),
            "claim": F.when(split, F.regexp_extract(top, r"(?i)\nContent-Length:[ \t]*([0-9]{1,9})", 1)),
            "declared": F.when(split, F.lower(F.regexp_extract(top, r"(?i)\nWARC-Payload-Digest:[ \t]*sha256:([0-9a-fA-F]{64})", 1))),
        }
    )
    rest = F.octet_length("record") - F.col("head_len")
    claim = F.when(F.col("claim") == "", None).otherwise(F.col("claim")).cast("int")
    r = r.withColumn("body_len", F.when(claim.isNotNull() & (claim <= rest), claim).otherwise(rest))
    return r.select(
        "id",
        "has_body",
        F.expr("substring(record, 1, head_len)").alias("header"),
        F.when(F.col("has_body"), F.expr("substring(record, head_len + 1, body_len)")).alias("payload"),
        F.expr("substring(record, head_len + body_len + 1)").alias("tail"),
        F.when(F.col("declared") != "", F.col("declared")).alias("declared"),
        F.sha2("record", 256).alias("record_digest"),
    ).withColumn("digest", F.sha2("payload", 256))


def archive(recs: DataFrame, id_col: str = "id", record_col: str = "record") -> Archive:
    """Split records into headers and payloads stored once.

    ``verified`` is true where the declared digest equals the computed one, false
    where it differs and null where none is declared; storage always uses the
    computed digest. ``one_content`` holds where all payloads under a digest were
    equal byte for byte. A null record keeps its row with nulls. Other columns
    are ignored.
    """
    p = _parsed(recs, id_col, record_col)
    headers = p.select("id", "header", "tail", "digest", "declared", (F.col("declared") == F.col("digest")).alias("verified"), "record_digest")
    payloads = (
        p.filter("digest is not null")
        .groupBy("digest")
        .agg(F.min("payload").alias("payload"), F.max("payload").alias("last"), F.count(F.lit(1)).alias("n_refs"))
        .select("digest", "payload", "n_refs", (F.col("payload") == F.col("last")).alias("one_content"))
    )
    return Archive(headers, payloads)


def restore(arc: Archive) -> DataFrame:
    """``id``, ``record`` and the archive's columns, one row per header row.

    Rows without a payload come back from their header alone; a digest that the
    payload table lacks gives a null record.
    """
    h, p = arc.headers, arc.payloads.withColumnRenamed("digest", "stored_digest")
    j = h.join(p, h.digest == p.stored_digest, "left")
    body = F.when(F.col("digest").isNull(), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return j.withColumn("record", F.concat("header", body, "tail")).drop("stored_digest")
