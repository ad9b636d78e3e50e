"""Queries over the operators of this subpackage, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import additive, bpe, chat, iblt, mixing, near_dedup, pii, quality, secrets, warc
from siftwork.session import spread


#: Tables of texts, whose rows are worth being spread.
_TEXTS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _TEXTS[name]) if name in _TEXTS else df


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all vectors, of every vector whose id is divisible by 20."""
    v = _table(spark, sf_dir, "embeddings")
    n = additive.neighbours(v, k=10, queries=v.filter("vec_id % 20 = 0"))
    return n.select(F.col("id").alias("vec_id"), "rank", F.col("neighbour").alias("neighbour_id"), "distance")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources weighted by the root of their size, at the input's size."""
    return mixing.mix(_table(spark, sf_dir, "documents"), alpha=0.5, seed=7)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate group, the number of its links and whether it stays."""
    return near_dedup.near_groups(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "group_id", "n_links", "keep")


def op4_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's paragraphs that its previous version lacks, and the other way round."""
    return _versions(iblt.version_diffs(_table(spark, sf_dir, "documents")))


def op4_closest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against the earlier document that shares the most paragraphs."""
    return _versions(iblt.version_diffs(_table(spark, sf_dir, "documents"), closest=True))


def _versions(d: DataFrame) -> DataFrame:
    return d.select(
        F.col("id").alias("doc_id"),
        F.col("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.col("prev").alias("prev_id"),
        F.array_join("added", ",").alias("added"),
        F.array_join("removed", ",").alias("removed"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, and whether it passes."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).withColumn("keep", F.coalesce(F.col("quality_score") >= 0.5, F.lit(False)))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages and restore their records; digests of both prove the round trip."""
    arc = warc.archive(warc.records(_table(spark, sf_dir, "pages")))
    return warc.restore(arc).select(
        F.col("id").alias("page_id"),
        F.col("digest").alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.octet_length("header").cast("long").alias("header_bytes"),
        "n_refs",
        "verified",
        "one_content",
        "record_digest",
        F.sha2("record", 256).alias("restored_digest"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, and whether they decode to its text."""
    return bpe.tokenized(_table(spark, sf_dir, "documents"))


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trees of all conversations."""
    return chat.trees(_table(spark, sf_dir, "conversations"))


def op8_chat_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node in which each conversation ends."""
    return chat.members(_table(spark, sf_dir, "conversations")).withColumnRenamed("conv", "conv_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of personal data in the documents."""
    return pii.find(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every secret in the documents."""
    return secrets.find(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_mixing": op2_mixing,
    "op3_near_dedup": op3_near_dedup,
    "op4_versions": op4_versions,
    "op4_closest_versions": op4_closest_versions,
    "op5_quality": op5_quality,
    "op6_warc_archive": op6_warc_archive,
    "op7_bpe": op7_bpe,
    "op8_chat_trees": op8_chat_trees,
    "op8_chat_members": op8_chat_members,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": """
        with s as (select source, sum(n_chars)::bigint as size from documents group by source),
        w as (select source, size, sqrt(size::double) as weight from s),
        r as (select source, round(weight / size::double * ((sum(size) over ())::double / sum(weight) over ()) * 1000000)::bigint as rate from w),
        p as (
            select d.doc_id, d.source, r.rate,
                   ('0x' || substr(md5('7:' || d.source), 1, 8))::bigint % 1000000
                   + sum(r.rate) over (partition by d.source order by md5(d.doc_id::varchar), d.n_chars rows unbounded preceding) as hi
            from documents d join r on d.source = r.source
        ),
        c as (select doc_id, source, (hi // 1000000 - (hi - rate) // 1000000)::int as n from p)
        select doc_id, source, unnest(range(1, n + 1))::int as copy_no from c where n > 0
    """,
    "op4_versions": """
        with lines as (select doc_id, unnest(string_split(text, chr(10))) as p from documents),
        d as (select distinct doc_id, ('0x' || substr(md5(p), 1, 15))::bigint as digest from lines where length(trim(p, ' ')) > 0),
        s as (select i.doc_id, list_sort(coalesce(list(d.digest) filter (d.digest is not null), [])) as ds from (select distinct doc_id from documents) i left join d on i.doc_id = d.doc_id group by i.doc_id),
        l as (select doc_id, lag(doc_id) over (partition by digest order by doc_id) as prev from d),
        c as (select doc_id, prev, count(*) as n from l where prev is not null group by all),
        v as (select doc_id, prev from c qualify row_number() over (partition by doc_id order by n desc, prev desc) = 1)
        select s.doc_id, len(s.ds)::bigint as n_paragraphs, v.prev as prev_id,
               case when v.prev is not null then array_to_string(list_filter(s.ds, lambda x: not list_contains(o.ds, x)), ',') end as added,
               case when v.prev is not null then array_to_string(list_filter(o.ds, lambda x: not list_contains(s.ds, x)), ',') end as removed
        from s left join v on s.doc_id = v.doc_id left join s o on v.prev = o.doc_id
    """,
    "op4_closest_versions": """
        with lines as (select doc_id, unnest(string_split(text, chr(10))) as p from documents),
        d as (select distinct doc_id, ('0x' || substr(md5(p), 1, 15))::bigint as digest from lines where length(trim(p, ' ')) > 0),
        s as (select i.doc_id, list_sort(coalesce(list(d.digest) filter (d.digest is not null), [])) as ds from (select distinct doc_id from documents) i left join d on i.doc_id = d.doc_id group by i.doc_id),
        l as (select doc_id, lag(doc_id) over (partition by digest order by doc_id) as prev from d),
        c as (select doc_id, prev, count(*) as n from l where prev is not null group by all),
        f as (select doc_id, prev from c qualify row_number() over (partition by doc_id order by n desc, prev desc) = 1),
        b as (select a.doc_id, e.doc_id as prev, count(*) as n from d a join d e on a.digest = e.digest and e.doc_id < a.doc_id group by all),
        v as (select b.doc_id, b.prev from b join f on b.doc_id = f.doc_id qualify row_number() over (partition by b.doc_id order by b.n desc, b.prev = f.prev desc, b.prev desc) = 1)
        select s.doc_id, len(s.ds)::bigint as n_paragraphs, v.prev as prev_id,
               case when v.prev is not null then array_to_string(list_filter(s.ds, lambda x: not list_contains(o.ds, x)), ',') end as added,
               case when v.prev is not null then array_to_string(list_filter(o.ds, lambda x: not list_contains(s.ds, x)), ',') end as removed
        from s left join v on s.doc_id = v.doc_id left join s o on v.prev = o.doc_id
    """,
    "op6_warc_archive": r"""
        with b as (select page_id, coalesce(url, '') as url, coalesce(html, '') as body from pages),
        h as (
            select page_id, body, sha256(body) as digest,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>'
                   || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Date: 2024-01-01T00:00:00Z'
                   || chr(13) || chr(10) || 'WARC-Payload-Digest: sha256:' || sha256(body) || chr(13) || chr(10)
                   || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
                   || chr(13) || chr(10) || chr(13) || chr(10) as header
            from b
        ),
        x as (select *, sha256(header || body || chr(13) || chr(10) || chr(13) || chr(10)) as rd from h)
        select page_id, digest as payload_digest, strlen(body)::bigint as payload_bytes, strlen(header)::bigint as header_bytes,
               count(*) over (partition by digest) as n_refs, true as verified, true as one_content,
               rd as record_digest, rd as restored_digest
        from x
    """,
    "op8_chat_members": """
        with t as (select distinct conv_id, turn, coalesce(role, '') as role, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as h from conversations where conv_id is not null),
        c as (select conv_id, list(h order by turn nulls first, role, h) as hs from t group by conv_id)
        select conv_id, hs[1] as tree_id, list_reduce(list_prepend('', hs), lambda a, h: md5(a || h)) as node, len(hs)::int as n_turns from c
    """,
}
