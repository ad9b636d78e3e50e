"""Chat formatting as prefix trees.

Conversations that share their first turns share those nodes. A tree is written depth
first, shared tokens once; each node has the position ids of its tokens, counted along its own path, and the
intervals of the written sequence that its ancestors take and it may attend to.

A conversation is the list of its turns' digests. Sorted by these lists, conversations come in depth-first order of their trees: what one
shares with the one before it is on a stack of open nodes already, the rest are new nodes. So no path is ever written out, and
the work is in proportion to the turns. A tree's children fall into buckets by the first letters of the second turn's digest, which are walked by
tasks of their own, each from place 0; the buckets' totals then shift them to where they belong.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm import bpe
from siftwork.session import stored

BUCKET_HEX = 3
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def formatted(role: str, text: str, template: tuple[str, str, str] = TEMPLATE) -> str:
    return f"{template[0]}{role}{template[1]}{text}{template[2]}"


_INTERVALS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_NODE = pa.schema(
    [("tree_id", pa.string()), ("bucket", pa.string()), ("node", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("h", pa.string()), ("begin", pa.int64()), ("n", pa.int64()), ("position", pa.int64()), ("n_conversations", pa.int64()), ("n_ending", pa.int64()), ("ancestors", _INTERVALS)]
)
_NODE_SQL = "tree_id string, bucket string, node string, parent string, depth int, h string, begin bigint, n bigint, position bigint, n_conversations bigint, n_ending bigint, ancestors array<struct<begin:bigint,end:bigint>>"


def node_id(parent: str, digest: str) -> str:
    """The digest of a path: of that of the path before it and the last turn's."""
    return hashlib.md5((parent + digest).encode()).hexdigest()


def _with(intervals: tuple, begin: int, end: int) -> tuple:
    """Ascending intervals and one more, which is joined to the last where it follows it without a gap. The first is the root's and stays."""
    if begin == end:
        return intervals
    if len(intervals) > 1 and intervals[-1][1] == begin:
        return (*intervals[:-1], (intervals[-1][0], end))
    return (*intervals, (begin, end))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct conversations sorted by tree, bucket and digests, to nodes below the root: a node's places count from the begin of its bucket."""
    key: tuple | None = None
    # Open nodes: digest, id, begin, tokens, position, conversations, ending ones, intervals that it attends to.
    stack: list[list] = []
    at, out = 0, []

    def close(depth: int) -> None:
        while len(stack) > depth:
            h, node, begin, n, position, total, ending, sees = stack.pop()
            if stack:
                stack[-1][5] += total
                out.append((*key, node, stack[-1][1], len(stack), h, begin, n, position, total, ending, [{"begin": b, "end": e} for b, e in sees]))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _NODE, strict=True)], schema=_NODE)
        out.clear()
        return batch

    for batch in batches:
        cols = (batch.column(i).to_pylist() for i in range(4))
        for bucket, hs, ns, count in zip(*cols, strict=True):
            if (hs[0], bucket) != key:
                close(0)
                key, at = (hs[0], bucket), 0
                # The root stands before everything; its own interval is never shifted.
                stack.append([hs[0], node_id("", hs[0]), 0, ns[0], 0, 0, 0, ()])
            same = 1
            while same < len(stack) and same < len(hs) and stack[same][0] == hs[same]:
                same += 1
            close(same)
            for h, n in zip(hs[same:], ns[same:], strict=True):
                up = stack[-1]
                sees = ((0, up[3]),) if len(stack) == 1 else _with(up[7], up[2], up[2] + up[3])
                stack.append([h, node_id(up[1], h), at, n, up[4] + up[3], 0, 0, sees])
                at += n
            stack[-1][5] += count
            stack[-1][6] += count
            if len(out) >= 10_000:
                yield flush()
    close(0)
    if out:
        yield flush()


def _turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    t = turns.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).filter("conv is not null")
    return t.withColumn("h", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.lit(":"), F.col("text"))))


def members(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``tree_id``, ``node``, ``n_turns``: where each conversation ends. Cases as in ``trees``."""
    t = _turns(turns, id_col, turn_col, role_col, text_col)
    c = t.groupBy("conv").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "h"))).alias("s"))
    node = F.aggregate("s", F.lit(""), lambda a, x: F.md5(F.concat(a, x["h"])))
    return c.select("conv", F.col("s")[0]["h"].alias("tree_id"), node.alias("node"), F.size("s").alias("n_turns"))


def trees(
    turns: DataFrame,
    vocabulary: str = bpe.DEFAULT_VOCABULARY,
    template: tuple[str, str, str] = TEMPLATE,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per node: ``tree_id``, ``node``, ``parent`` (null for a root), ``depth`` (from 0), ``begin``, ``end`` (tokens of the tree's sequence), ``role``, ``n_conversations`` through it,
    ``n_ending`` of them that end in it (``members`` tells which), ``tokens``, ``position_ids``, ``ancestors`` (ascending intervals; what follows without a gap is one).

    A conversation's turns are ordered by turn (nulls first), then role, then the digest of both; equal rows count once. Null roles and texts
    count as empty. Rows with a null id are left out. Conversations and texts may have any length; a conversation's digests are held at once. Other columns are ignored, and an empty table gives an empty result.
    """
    t = _turns(turns, id_col, turn_col, role_col, text_col)
    content = t.groupBy("h").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    text = F.concat(F.lit(template[0]), F.col("role"), F.lit(template[1]), F.col("text"), F.lit(template[2]))
    content = stored(bpe.tokenized(content.select("h", "role", text.alias("text")), vocabulary, "h", "text", ["h", "role"]), "turns")
    sized = content.select(F.col("h").alias("h1"), F.col("n_tokens").cast("long").alias("n"))
    steps = t.select("conv", "turn", "role", "h").join(sized, F.col("h") == F.col("h1"))
    convs = steps.groupBy("conv").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "h", "n"))).alias("s"))
    convs = convs.select(F.transform("s", lambda x: x["h"]).alias("hs"), F.transform("s", lambda x: x["n"]).alias("ns"))
    convs = convs.groupBy("hs").agg(F.first("ns").alias("ns"), F.count(F.lit(1)).alias("count"))
    bucket = F.when(F.size("hs") > 1, F.substring(F.col("hs")[F.when(F.size("hs") > 1, 1).otherwise(0)], 1, BUCKET_HEX)).otherwise(F.lit(""))
    convs = stored(convs.select(F.col("hs")[0].alias("tree_id"), bucket.alias("bucket"), "hs", "ns", "count"), "conversations")
    roots = convs.groupBy("tree_id").agg(F.first(F.col("ns")[0]).alias("n"), F.sum("count").alias("n_conversations"), F.sum(F.when(F.col("bucket") == "", F.col("count")).otherwise(0)).alias("n_ending"))
    below = convs.filter("bucket <> ''").repartition("tree_id", "bucket").sortWithinPartitions("tree_id", "bucket", "hs").select("bucket", "hs", "ns", "count")
    walked = stored(below.mapInArrow(_walk, _NODE_SQL), "nodes")
    sums = walked.groupBy("tree_id", "bucket").agg(F.sum("n").alias("k"))
    ahead = Window.partitionBy("tree_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("tree_id", "bucket", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("before"))
    sums = sums.join(roots.select("tree_id", F.col("n").alias("root_n")), "tree_id").select(F.col("tree_id").alias("t1"), F.col("bucket").alias("b1"), (F.col("before") + F.col("root_n")).alias("shift"))
    nodes = walked.join(sums, (F.col("tree_id") == F.col("t1")) & (F.col("bucket") == F.col("b1")))
    moved = F.transform(F.expr("slice(ancestors, 2, size(ancestors))"), lambda x: F.struct((x["begin"] + F.col("shift")).alias("begin"), (x["end"] + F.col("shift")).alias("end")))
    nodes = nodes.withColumn("root", F.col("ancestors")[0]).withColumn("moved", moved)
    # The root's interval joins the next one where its bucket is the tree's first, and is left out where it is empty.
    joined = F.when(F.col("root.end") == 0, F.col("moved")).when((F.size("moved") > 0) & (F.try_element_at("moved", F.lit(1))["begin"] == F.col("root.end")), F.concat(F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.try_element_at("moved", F.lit(1))["end"].alias("end"))), F.expr("slice(moved, 2, size(moved))"))).otherwise(F.concat(F.array("root"), F.col("moved")))
    nodes = nodes.select("tree_id", "node", "parent", "depth", "h", (F.col("begin") + F.col("shift")).alias("begin"), "n", "position", "n_conversations", "n_ending", joined.alias("ancestors"))
    top = roots.select("tree_id", F.md5("tree_id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.col("tree_id").alias("h"), F.lit(0).cast("long").alias("begin"), "n", F.lit(0).cast("long").alias("position"), "n_conversations", "n_ending", F.array().cast("array<struct<begin:bigint,end:bigint>>").alias("ancestors"))
    full = top.unionByName(nodes).join(content.select(F.col("h").alias("h2"), "role", "tokens"), F.col("h") == F.col("h2"))
    return full.select(
        "tree_id",
        "node",
        "parent",
        "depth",
        "begin",
        (F.col("begin") + F.col("n")).alias("end"),
        "role",
        "n_conversations",
        "n_ending",
        "tokens",
        F.when(F.col("n") > 0, F.sequence(F.col("position"), F.col("position") + F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")).alias("position_ids"),
        "ancestors",
    )
