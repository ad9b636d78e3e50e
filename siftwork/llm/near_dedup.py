"""MinHash near-duplicates, verified with odd sketches.

Word shingles are MinHashed; the samples of a document are folded into a parity
bitmap, so that the XOR of two bitmaps counts the samples in which two documents differ and
estimates a high similarity from 64 bytes. Banded samples give the
candidates. Within a bucket, documents are joined by searching the bucket breadth first over the
verified pairs, which gives the bucket's exact connected components without listing
all pairs; the buckets' edges are then joined by alternating stars.

A bucket of more than ``PART`` documents is cut into parts, each searched by a task of its own. What the parts leave apart is compared across them
in blocks: the documents outside of the bucket's largest component against all of the bucket. So the components are those of the whole bucket,
and near copies of one text, however many, cost one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.hashing import chunks, mix, words
from siftwork.session import forget, stored

SHINGLE = 3
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 512
THRESHOLD = 0.5
#: The most documents of a bucket that one task compares with each other.
PART = 4096

_rng = np.random.RandomState(20140407)
_A = (_rng.randint(0, 1 << 32, SAMPLES, np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, SAMPLES, np.uint64) | np.uint64(1)
_B = (_rng.randint(0, 1 << 32, SAMPLES, np.uint64) << np.uint64(32)) | _rng.randint(0, 1 << 32, SAMPLES, np.uint64)


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of all texts, and where each text's begin. A text of 1 to k-1 words has one shingle."""
    w, at = words(texts)
    n = np.diff(at)
    if not len(w):
        return w, np.zeros(len(texts) + 1, np.int64)
    last = np.repeat(at[1:], n)
    i = np.arange(len(w))
    h = np.zeros(len(w), np.uint64)
    for j in range(k):
        there = i + j < last
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, w[np.minimum(i + j, len(w) - 1)], np.uint64(j)))
    keep = (i + k <= last) | (i == np.repeat(at[:-1], n))
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.where(n > 0, np.maximum(n - k + 1, 1), 0), out=ends[1:])
    return h[keep], ends


def minhashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The SAMPLES minima of each text that has words (rows in order), and which texts those are."""
    s, at = shingles(texts)
    full = np.flatnonzero(np.diff(at) > 0)
    out = np.empty((len(full), SAMPLES), np.uint64)
    if len(full):
        begin, t = at[full], np.empty_like(s)
        for j in range(SAMPLES):
            np.multiply(s, _A[j], out=t)
            np.add(t, _B[j], out=t)
            out[:, j] = np.minimum.reduceat(t, begin)
    return out, full


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Parity bitmaps (uint8, BITS / 8 columns) of the samples' hashes."""
    pos = (mix(mins + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) % np.uint64(BITS)).astype(np.int64)
    flat = (np.arange(len(mins))[:, None] * BITS + pos).ravel()
    odd = (np.bincount(flat, minlength=len(mins) * BITS) & 1).astype(np.uint8).reshape(len(mins), BITS)
    return np.packbits(odd, axis=1)


def most_differing_bits(threshold: float = THRESHOLD) -> int:
    """The largest XOR count at which the estimated similarity reaches ``threshold``."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - threshold) / BITS)))


def similarity(xor_bits: np.ndarray) -> np.ndarray:
    """The estimate from an XOR count: 1 + n / 4k ln(1 - 2z / n)."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(xor_bits) / BITS, 1e-12))


def band_keys(mins: np.ndarray) -> np.ndarray:
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), (len(mins), BANDS))
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + mins[:, r::ROWS])
    return h.view(np.int64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.int64)


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(map(len, (t or "" for t in texts))):
            part = texts[a:b]
            mins, full = minhashes([t or "" for t in part])
            place = {int(f): i for i, f in enumerate(full)}
            odd, keys = odd_sketches(mins), band_keys(mins)
            sig, sk, bands = [], [], []
            for i, t in enumerate(part):
                if (at := place.get(i)) is not None:
                    sig.append(hashlib.md5(mins[at].tobytes()).digest())
                    sk.append(odd[at].tobytes())
                    bands.append(keys[at])
                else:
                    sig.append(None if t is None else hashlib.md5(b"text" + t.encode("utf-8", "surrogatepass")).digest())
                    sk.append(None)
                    bands.append(None)
            digest = [None if t is None else hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest() for t in part]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(digest, pa.string()), pa.array(sig, pa.binary()), pa.array(sk, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "digest", "sig", "sketch", "bands"],
            )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest`` (of the text), ``sig`` (equal for equal samples), ``sketch``, ``bands``: one row per row, without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_sketch_batches, f"id {kind}, digest string, sig binary, sketch binary, bands array<bigint>")


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Cut a stream sorted by its first column into tables that hold whole keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and keys[0] != held[-1].column(0)[0].as_py():
            done, held = pa.Table.from_batches(held), []
            yield done.column(0).to_numpy(), done
        if cut:
            done, held = pa.Table.from_batches([*held, batch.slice(0, cut)]), []
            yield done.column(0).to_numpy(), done
        held.append(batch.slice(cut))
    if held:
        done = pa.Table.from_batches(held)
        yield done.column(0).to_numpy(), done


def _forest(ids: np.ndarray, bits: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of one bucket's verified pairs, by breadth-first search over what is still unvisited."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    left = np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]).sum(axis=1, dtype=np.int32) <= most
            found = left[near]
            if len(found):
                a.append(np.full(len(found), ids[at]))
                b.append(ids[found])
                queue.extend(found)
                left = left[~near]
    return a, b


def _edges_in(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, table in _by_key(batches):
            ids = table.column(1).to_numpy()
            bits = np.frombuffer(b"".join(table.column(2).to_pylist()), np.uint64).reshape(len(ids), BITS // 64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(cuts)
            at = cuts[:-1][sizes == 2]
            ok = np.bitwise_count(bits[at] ^ bits[at + 1]).sum(axis=1, dtype=np.int32) <= most if len(at) else np.zeros(0, bool)
            a, b = [ids[at[ok]]], [ids[at[ok] + 1]]
            for i in np.flatnonzero(sizes > 2):
                p, q = _forest(ids[cuts[i] : cuts[i + 1]], bits[cuts[i] : cuts[i + 1]], most)
                a += p
                b += q
            x, y = np.concatenate(a), np.concatenate(b)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["u", "v"])

    return run


def _across(most: int):
    """Links between roots: of each block, the asking rows (``ask``) against all rows of other roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, table in _by_key(batches):
            roots, ask = table.column("root").to_numpy(), table.column("ask").to_numpy(zero_copy_only=False)
            bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(roots), BITS // 64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            for i, j in zip(cuts, cuts[1:], strict=False):
                asks, rest = i + np.flatnonzero(ask[i:j]), i + np.flatnonzero(~ask[i:j])
                for at in range(0, len(asks), 64):
                    some = asks[at : at + 64]
                    near = np.bitwise_count(bits[some][:, None] ^ bits[rest][None]).sum(axis=2, dtype=np.int32) <= most
                    x, y = np.nonzero(near & (roots[some][:, None] != roots[rest][None]))
                    if len(x):
                        p = np.unique(np.stack([roots[some[x]], roots[rest[y]]], axis=1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(p.max(axis=1)), pa.array(p.min(axis=1))], names=["u", "v"])

    return run


def _joined_parts(hot: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """``u``, ``v``: links between the components (``roots``) of buckets that were cut into parts. ``hot`` has ``key``, ``row``, ``sketch``."""
    m = hot.join(roots, F.col("row") == F.col("node"), "left").select("key", "row", "sketch", F.coalesce("root", "row").alias("root"))
    per_root = m.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    per_key = per_root.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    # Where one root has all of a bucket, nothing is left to compare.
    per_key = per_key.filter("n > top.n").select(F.col("key").alias("k"), F.col("top.root").alias("top"), F.ceil(F.col("n") / PART).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("top.n")) / PART).cast("int").alias("ask_parts"))
    m = m.join(per_key, F.col("key") == F.col("k"))
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    asks = m.filter("root <> top").select("key", part("ask_parts").alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"), F.lit(True).alias("ask"), "root", "sketch")
    rest = m.select("key", F.explode(F.sequence(F.lit(0), F.col("ask_parts") - 1)).alias("i"), part("parts").alias("j"), F.lit(False).alias("ask"), "root", "sketch")
    blocks = asks.unionByName(rest).select(F.xxhash64("key", "i", "j").alias("block"), "ask", "root", "sketch")
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_across(most), "u bigint, v bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node of each connected component, for nodes other than the root.

    ``edges`` has u > v. Alternating large and small stars; every round is written to the shared folder.
    """
    now = stored(edges.distinct(), "edges")
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = least.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        before, now = now, stored(small.filter("u > v").distinct(), "edges")
        forget(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        # Settled when nothing changed, and then each node has one edge, to its root.
        if (found[0], found[1]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (found[0], found[1])


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest``, ``group_id``, ``n_links`` (to how many other rows it is linked, directly or through others), ``keep``: one row per row of ``docs``.

    Rows whose estimated Jaccard similarity over 3-word shingles reaches ``threshold`` are linked, and linked rows
    form a group, named by its least non-null id. ``keep`` is true for one row of each group, the one of least
    id (nulls last). A null text is in a group of its own; texts without words are grouped where
    they are equal. Texts of one or two words have a single shingle. Repeated rows and ids are rows of their own. Other
    columns are ignored, and an empty table gives an empty result.
    """
    all_rows = stored(sketches(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    sig = F.coalesce("sig", F.col("row").cast("string").cast("binary"))
    nodes = all_rows.groupBy(sig.alias("sig")).agg(F.min("row").alias("node"))
    rows = stored(all_rows.select("row", "id", "digest", sig.alias("s")).join(nodes, F.col("s") == F.col("sig")).select("row", "id", "digest", "node"), "rows")
    # Rows of equal samples share one node, so buckets hold it once.
    firsts = rows.filter("row = node").select("node")
    once = all_rows.filter("sketch is not null").join(firsts, F.col("row") == F.col("node"), "left_semi")
    banded = once.select(F.explode("bands").alias("key"), "row")
    many = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumnRenamed("key", "k")
    shared = banded.join(many, F.col("key") == F.col("k")).select("key", "row", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    with_bits = stored(shared.join(all_rows.select(F.col("row").alias("r"), "sketch"), F.col("row") == F.col("r")).select("key", "row", "sketch", "parts"), "buckets")
    most = most_differing_bits(threshold)
    bucket = F.xxhash64("key", F.pmod(F.xxhash64("row"), F.col("parts")))
    edges = with_bits.select(bucket.alias("bucket"), "row", "sketch").repartition("bucket").sortWithinPartitions("bucket", "row").mapInArrow(_edges_in(most), "u bigint, v bigint")
    roots = components(edges)
    across = stored(_joined_parts(with_bits.filter("parts > 1"), roots, most), "across")
    if not across.isEmpty():
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(across))
    placed = rows.join(roots.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select("row", "id", "digest", F.coalesce("root", "node").alias("g"))
    best = placed.groupBy("g").agg(F.min("id").alias("group_id"), F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("best"), (F.count(F.lit(1)) - 1).alias("n_links")).withColumnRenamed("g", "g2")
    return placed.join(best, F.col("g") == F.col("g2")).select("id", "digest", "group_id", "n_links", (F.col("row") == F.col("best")).alias("keep"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns as they are. Cases as in ``near_groups``."""
    kept = near_groups(docs, threshold, id_col, text_col).filter("keep").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    kept = kept.groupBy("_id", "_digest").agg(F.count(F.lit(1)).alias("_kept"))
    digest = F.md5(F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), digest.alias("_d"))
    # Rows of one id and text all match; as many of them stay as were kept, those that come first by their other columns.
    rows = rows.join(kept, F.col("_i").eqNullSafe(F.col("_id")) & F.col("_d").eqNullSafe(F.col("_digest")))
    others = [F.col("_row")[f.name] for f in docs.schema if f.name not in (id_col, text_col) and not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    nth = F.row_number().over(Window.partitionBy("_i", "_d").orderBy(*(others or [F.lit(1)])))
    return rows.withColumn("_n", nth).filter("_n <= _kept").select("_row.*")
