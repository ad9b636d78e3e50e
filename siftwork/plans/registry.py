"""All queries over the engine's own operators, each over its whole tables. Their SQL twins are in ``oracles``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.functions import bpe_count, paths, scores, text
from siftwork.operators import dedup, graph, history, ranking, render, scan, score, select, structure
from siftwork.operators import feedback as fb
from siftwork.plans import tables as T
from siftwork.plans.oracles import BUDGET, FOCUS_PAGES, FOCUS_SUPPLIER, IGNORE_LINES, L1_TOKENS, ORACLE_SQL, SKIPPED, SMALL_LIMITS
from siftwork.session import stored
from siftwork.sources import snapshot

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "documents")


# Functions over text, hashes and paths


@query
def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def exact_bpe_count(spark, d):
    """Exact token counts; SQL has no such function."""
    return _docs(spark, d).select("doc_id", bpe_count.exact_tokens(F.col("text")).alias("tokens"))


@query
def content_md5(spark, d):
    return _docs(spark, d).select("doc_id", F.md5("text").alias("digest"))


@query
def identifiers(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.array_sort(text.identifiers(F.col("text"))), ",").alias("names"))


@query
def session_ids(spark, d):
    e = T.table(spark, d, "events")
    return e.select("event_id", text.session_id(F.col("user_id").cast("string"), F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("session_id"))


@query
def language_map(spark, d):
    p = T.sources(spark, d)
    return p.select("path", paths.extension(F.col("path")).alias("extension"), paths.language(F.col("path")).alias("language"), paths.is_watched(F.col("path")).alias("watched"))


@query
def group_keys(spark, d):
    p = F.regexp_replace("url", r"^https?://", "")
    return T.table(spark, d, "pages").select("page_id", paths.group_key(p).alias("directory"), paths.group_key(p, "parent").alias("parent"))


@query
def path_proximity(spark, d):
    """Every page against the page that follows it by id."""
    p = T.table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("p"))
    q = p.select((F.col("page_id") - 1).alias("before"), F.col("p").alias("q"))
    return p.join(q, F.col("page_id") == F.col("before")).select("page_id", paths.path_proximity(F.col("p"), F.col("q")).cast("double").alias("proximity"))


@query
def proximity(spark, d):
    p = F.regexp_replace("url", r"^https?://", "")
    return T.table(spark, d, "pages").select("page_id", paths.proximity(p, FOCUS_PAGES).cast("double").alias("proximity"))


@query
def extension_filter(spark, d):
    """Source files of two languages, but for those below one folder."""
    opts = scan.ScanOptions(extra_ignore=SKIPPED, include_extensions=("rs", "go"))
    return T.sources(spark, d).filter(scan.kept_path(F.col("path"), opts)).select("path", "language")


@query
def ignored_paths(spark, d):
    """Which pages the lines of an ignore file leave out; the last that matches decides."""
    p = F.regexp_replace("url", r"^https?://", "")
    return T.table(spark, d, "pages").select("page_id", scan.ignored(p, scan.gitignore_rules(IGNORE_LINES)).alias("ignored"))


# Signals


@query
def recency(spark, d):
    """The age of every event in days, and its signal."""
    age = (F.unix_seconds(T.as_of()) - F.unix_seconds(F.col("ts").cast("timestamp"))) / F.lit(86400.0)
    return T.table(spark, d, "events").select("event_id", F.round(scores.recency(age).cast("double"), 5).alias("recency"))


@query
def size_signal(spark, d):
    e = T.entries(spark, d)
    return e.select("doc_id", F.round(scores.size_signal(F.col("token_count")).cast("double"), 6).alias("size_score"))


@query
def efficiency(spark, d):
    s = T.scored(spark, d)
    return s.select("doc_id", F.round(scores.efficiency(F.col("composite_score"), F.col("token_count")).cast("double"), 8).alias("efficiency"))


@query
def budget_split(spark, d):
    """Each order's price as a token budget and its layers."""
    o = T.table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("total"))
    return o.select("o_orderkey", *[scores.budget_part(F.col("total"), share).alias(k) for k, share in (("l1", 0.05), ("l2", 0.25), ("l3", 0.70))])


@query
def composite_score(spark, d):
    s = T.scored(spark, d)
    return s.select("doc_id", "token_count", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("recency", "size_score", "composite_score")])


@query
def focus_score(spark, d):
    """Pages scored under focus weights: by the age of their number, proximity and distance to the focus pages through shared hosts."""
    p = T.table(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^https?://", "").alias("path"), F.octet_length("html").cast("long").alias("token_count"))
    p = p.withColumn("last_modified", F.timestamp_seconds(F.unix_seconds(T.as_of()) - F.col("token_count") * 60))
    host = F.substring_index("path", "/", 1)
    links = p.select(F.col("path").alias("src"), F.concat(F.lit("//"), host).alias("dst"))
    focus = spark.createDataFrame([(x,) for x in FOCUS_PAGES], "node string")
    dist = graph.distances(links, focus)
    out = score.score_entries(p, T.as_of(), scores.Weights.focused(), FOCUS_PAGES, dist)
    return out.select("page_id", F.round(F.col("dependency").cast("double"), 6).alias("dependency"), F.round(F.col("composite_score").cast("double"), 5).alias("composite_score"))


# Scans and statistics


@query
def scan_filter(spark, d):
    size, tokens = SMALL_LIMITS
    src = _docs(spark, d).select("doc_id", T.doc_path().alias("path"), F.col("text").alias("content"))
    out = scan.scan_filter(src, scan.ScanOptions(max_bytes=size, max_tokens=tokens))
    return out.select("doc_id", "size_bytes", "token_count")


@query
def skip_counts(spark, d):
    src = _docs(spark, d).select(T.doc_path().alias("path"), F.col("text").alias("content"))
    return scan.skip_counts(src, scan.ScanOptions(max_bytes=SMALL_LIMITS[0]))


@query
def index_stats(spark, d):
    return scan.index_stats(T.entries(spark, d))


@query
def language_histogram(spark, d):
    return scan.histogram(T.entries(spark, d))


# History


@query
def commit_stats(spark, d):
    h = history.commit_stats(T.commits(spark, d), T.as_of())
    return h.select(F.col("path").cast("long").alias("user_id"), "commit_count", F.round("age_days", 6).alias("age_days"))


@query
def commit_stats_by_type(spark, d):
    h = history.commit_stats(T.commits(spark, d, "event_type"), T.as_of())
    return h.select(F.col("path").alias("event_type"), "commit_count", F.round("age_days", 6).alias("age_days"))


@query
def recency_from_history(spark, d):
    e = T.with_history(spark, d, T.entries(spark, d))
    age = scores.entry_age_days(F.col("age_days"), F.col("last_modified"), T.as_of())
    return e.select("doc_id", F.round(scores.recency(age).cast("double"), 5).alias("recency"))


# Duplicates


@query
def exact_dedup(spark, d):
    return dedup.exact_dedup(_docs(spark, d).select("doc_id", F.md5("text").alias("digest")), F.col("digest"), "doc_id")


@query
def exact_dedup_stats(spark, d):
    return dedup.exact_dedup_stats(_docs(spark, d), F.md5("text"))


def _prints(spark, d):
    return dedup.simhash(_docs(spark, d), "doc_id", "text")


@query
def simhash(spark, d):
    return _prints(spark, d).select(F.col("key").alias("doc_id"), "simhash")


@query
def lsh_bands(spark, d):
    return _prints(spark, d).select(F.col("key").alias("doc_id"), F.posexplode(dedup.lsh_bands(F.col("simhash"))).alias("band", "value"))


@query
def hamming_pairs(spark, d):
    """Pairs of distinct fingerprints within eight bits, each told by the least document that has it."""
    lead = stored(_prints(spark, d), "prints").groupBy("simhash").agg(F.min("key").alias("key"))
    return dedup.near_pairs(lead, threshold=8)


@query
def hamming_members(spark, d):
    """Every document with the least one of its fingerprint, which stands for it in ``hamming_pairs``, and the number of documents within eight bits of it, copies too."""
    return dedup.members(stored(_prints(spark, d), "prints"), threshold=8).withColumnRenamed("key", "doc_id")


@query
def near_dup_groups(spark, d):
    return dedup.near_groups(stored(_prints(spark, d), "prints")).select(F.col("key").alias("doc_id"), "label")


@query
def near_dup_groups_wide(spark, d):
    return dedup.near_groups(stored(_prints(spark, d), "prints"), threshold=8).select(F.col("key").alias("doc_id"), "label")


@query
def near_dedup(spark, d):
    docs = _docs(spark, d)
    return dedup.near_dedup(docs.select("doc_id", "source"), stored(_prints(spark, d), "prints"), "doc_id", threshold=8)


# Graph


@query
def dependency_edges(spark, d):
    """Imports between source files, resolved."""
    src = stored(T.sources(spark, d), "sources")
    return graph.build_edges(structure.imports(src), src)


@query
def bfs_distance(spark, d):
    focus = spark.createDataFrame([(FOCUS_SUPPLIER,)], "node string")
    return graph.distances(T.edges(spark, d), focus)


@query
def dependency_signal(spark, d):
    focus = spark.createDataFrame([(FOCUS_SUPPLIER,)], "node string")
    far = graph.distances(T.edges(spark, d), focus)
    s = T.table(spark, d, "part").select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("k"))
    out = s.join(far, F.col("k") == F.col("node"), "left")
    return out.select("p_partkey", F.round(scores.dependency(F.col("distance")).cast("double"), 6).alias("dependency"))


# Structure


@query
def signatures(spark, d):
    return structure.signatures(T.sources(spark, d))


@query
def imports(spark, d):
    return structure.imports(T.sources(spark, d)).withColumnRenamed("src", "path")


@query
def resolve_imports(spark, d):
    src = stored(T.sources(spark, d), "sources")
    return graph.resolve_imports(structure.imports(src), src)


# Selection

_ITEM = {"key": "doc_id", "tokens": "token_count", "score": "composite_score"}


def _picked(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("doc_id"), "pick_order")


@query
def greedy_knapsack(spark, d):
    return _picked(select.greedy(T.kept(spark, d), BUDGET, **_ITEM))


@query
def greedy_oversized(spark, d):
    """How many items were over a budget of 1000 when greedy selection met them."""
    items = T.kept(spark, d)
    return select.oversized(items, 1000, stored(select.greedy(items, 1000, **_ITEM), "picked"), **_ITEM)


@query
def greedy_diverse_directory(spark, d):
    return _picked(select.greedy_diverse(T.kept(spark, d), BUDGET, select.Diversity(), **_ITEM, path="path"))


@query
def greedy_diverse_parent(spark, d):
    return _picked(select.greedy_diverse(T.kept(spark, d), BUDGET, select.Diversity(grouping="parent"), **_ITEM, path="path"))


@query
def kkt_knapsack(spark, d):
    return _picked(select.kkt(T.kept(spark, d), BUDGET, **_ITEM))


@query
def kkt_knapsack_diverse(spark, d):
    return _picked(select.kkt(T.kept(spark, d), BUDGET, select.Diversity(), **_ITEM, path="path"))


@query
def select_auto(spark, d):
    return _picked(select.select(T.kept(spark, d), BUDGET, "auto", **_ITEM))


@query
def ranked_documents(spark, d):
    """All documents by score, ties by path."""
    s = T.scored(spark, d)
    return ranking.ranked(s.select("doc_id", "path", "composite_score"), F.col("composite_score").cast("double"), ["path"]).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query
def l1_prefix(spark, d):
    p = render.l1_prefix(T.scored(spark, d), L1_TOKENS)
    return p.select("doc_id", F.col("rank").cast("long").alias("rank"), F.col("l1_tokens").cast("long").alias("l1_tokens"))


@query
def pack_stats(spark, d):
    items = T.kept(spark, d)
    picked = select.greedy(items, BUDGET, **_ITEM).select(F.col("key").alias("k"))
    chosen = items.join(picked, F.col("doc_id") == F.col("k"), "left_semi")
    return render.pack_stats(T.entries(spark, d), items, items, chosen, BUDGET)


# Rendering


@query
def render_l1_lines(spark, d):
    """The skeleton's lines, whole."""
    p = render.l1_prefix(T.scored(spark, d), L1_TOKENS)
    return render.l1_lines(p).select(F.col("rank").cast("long").alias("rank"), F.col("text").alias("line"))


def _chosen(spark, d):
    s = stored(T.scored(spark, d), "scored")
    picked = select.greedy(s, BUDGET, **_ITEM).withColumnRenamed("key", "k")
    return s.join(picked, F.col("doc_id") == F.col("k")).drop("k")


@query
def render_l2_blocks(spark, d):
    return render.l2_blocks(_chosen(spark, d)).select("pick_order", F.col("text").alias("block"))


@query
def render_l3_files(spark, d):
    c = _chosen(spark, d).select(F.col("doc_id").alias("i"), "path", "token_count", "composite_score", "pick_order")
    full = c.join(_docs(spark, d).select("doc_id", F.col("text").alias("content")), F.col("i") == F.col("doc_id"))
    return render.l3_files(full).select("pick_order", F.col("text").alias("file"))


# Feedback


@query
def utilization(spark, d):
    """Each user turn of a conversation under what the assistant says in all of it."""
    c = T.table(spark, d, "conversations")
    said = c.filter("role = 'assistant'").groupBy(F.col("conv_id").alias("session_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    files = c.filter("role = 'user'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("file_path"), F.col("text").alias("content"))
    u = fb.session_utilization(files, said)
    return u.select(F.col("session_id").alias("conv_id"), F.col("file_path").alias("turn"), F.round(F.col("utilization").cast("double"), 6).alias("utilization"))


@query
def session_utilization(spark, d):
    """The average of each conversation's utilizations, in millionths."""
    return utilization(spark, d).groupBy("conv_id").agg((F.sum(F.round(F.col("utilization") * 1_000_000).cast("long")) / F.count(F.lit(1))).alias("avg_utilization"))


@query
def feedback_multipliers(spark, d):
    return fb.multipliers(T.feedback(spark, d)).withColumn("multiplier", F.round("multiplier", 6))


@query
def score_with_feedback(spark, d):
    s = score.apply_feedback(T.scored(spark, d), fb.multipliers(T.feedback(spark, d)))
    return s.select("doc_id", F.round(F.col("composite_score").cast("double"), 5).alias("composite_score"))


@query
def session_feedback(spark, d):
    """Each session's records by descending score."""
    f = T.feedback(spark, d)
    n = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("composite_score"), "file_path"))
    return f.select("session_id", "file_path", "was_selected", n.cast("long").alias("place"))


@query
def feedback_stats(spark, d):
    f = T.feedback(spark, d)
    return fb.feedback_stats(f.select("session_id").distinct(), f).withColumn("avg_utilization", F.round("avg_utilization", 6))


@query
def updated_weights(spark, d):
    w = fb.updated_weights(T.feedback(spark, d))
    return w.select(*[F.round(c, 6).alias(c) for c in ("recency", "size", "proximity", "dependency", "avg_utilization")], "records")


@query
def latest_weights(spark, d):
    """The newest of the weights that each source learns from its own feedback; a source's name dates it."""
    w = fb.updated_weights(T.feedback(spark, d), by=["session_id"])
    numbers = [F.round(c, 6).alias(c) for c in ("recency", "size", "proximity", "dependency", "avg_utilization")]
    return fb.latest(w.select(F.regexp_extract("session_id", r"\d+", 0).cast("long").alias("created_at"), "session_id", *numbers, "records"))


@query
def feedback_upsert(spark, d):
    """Records with those of toxic documents replaced by unused ones."""
    f = T.feedback(spark, d).select("session_id", "file_path", "token_count", "utilization")
    new = f.filter("utilization is null").withColumn("utilization", F.lit(0.0))
    return fb.upsert(f, new)


# Incremental snapshots


def _listings(spark, d):
    """Yesterday's listing has all but the documents that share their text with an earlier one; today's all but those in French; a text of more than 1000 characters has changed."""
    e = T.entries(spark, d).select("path", F.unix_seconds("last_modified").alias("mtime"), F.col("size_bytes").alias("size"), "language", "digest", "doc_id")
    old = dedup.exact_dedup(e, F.col("digest"), "doc_id").select("path", "mtime", "size", F.col("digest").alias("hash"))
    new = e.filter("language <> 'fr'").select("path", F.when(F.col("size") > 1000, F.col("mtime") + 60).otherwise(F.col("mtime")).alias("mtime"), "size", F.col("digest").alias("hash"))
    return old, new


@query
def cache_hits(spark, d):
    old, new = _listings(spark, d)
    return snapshot.hits(new, old).select("path", "hash")


@query
def cache_fresh(spark, d):
    old, new = _listings(spark, d)
    return snapshot.fresh(new, old).select("path", "mtime")


@query
def cache_deleted(spark, d):
    old, new = _listings(spark, d)
    return snapshot.deleted(new, old).select("path")


@query
def incremental_union(spark, d):
    old, new = _listings(spark, d)
    return snapshot.merged(snapshot.hits(new, old), snapshot.fresh(new, old)).select("path", "mtime", "size", "hash")
