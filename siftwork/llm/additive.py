"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each codebook. Codebooks are
trained on residuals and refined jointly by least squares; encoding is a beam search over the codebooks.
The approximation's norm and its squared error are stored beside its codes, so a query's distances to all codes come from one lookup table;
those close enough by these are ranked again by their exact distances.

Rows are listed by the nearest word of the first codebook as it was before the refinement. A query scores the lists whose words are at most ``reach`` farther from it than the
nearest one, and ranks exactly the rows whose estimated squared distance is at most ``slack`` times the k-th least. Both are
measured against brute force on sampled vectors that the codebooks were not fitted to, so that each keeps nearly all true neighbours.

Lists that lie near each other form blocks of rows, queries near each other blocks of queries, and only blocks of which one
asks the other meet. A row is sent to the query blocks that ask its list, a query to the row blocks that hold a list it scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.session import stored

BOOKS, WORDS, BEAM = 8, 256, 8
#: The most vectors that the codebooks are trained on and the search is tuned with, those of the least hash.
TRAIN_ROWS = 8192
#: The share of them that the codebooks don't see, for tuning.
HELD_OUT = 0.25
#: The share of the true neighbours that each of both approximations has to keep on the held-out vectors.
KEEP = 0.97
QUERY_BLOCK, ROW_BLOCK = 4096, 16384


@dataclass
class Quantiser:
    """``books``: (books, words, dimensions). ``centres`` of the lists: the first codebook before it was refined with the others. ``reach``: how much farther than the nearest list (as a difference of squares) a scored one may be. ``slack``: how much farther than the k-th (as a ratio of squares) a row may seem that is ranked exactly."""

    books: np.ndarray
    centres: np.ndarray
    reach: float
    slack: float

    def table(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries with all codewords: (queries, books * words)."""
        return q @ self.books.reshape(-1, self.books.shape[2]).T

    def to_lists(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of vectors from the centres of all lists."""
        c = self.centres
        return np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ c.T + (c * c).sum(axis=1)[None], 0)

    def probed(self, q: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Which lists each query scores: those within reach, and as many more as hold ``least`` rows."""
        d = self.to_lists(q)
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        need = np.empty(d.shape, bool)
        np.put_along_axis(need, order, (held - sizes[order]) < least, axis=1)
        return (need | (d <= self.reach + d.min(axis=1)[:, None])) & (sizes > 0)[None]


def encode(books: np.ndarray, x: np.ndarray, beam: int = BEAM, block: int = 2048) -> np.ndarray:
    """Codes by beam search: at each codebook the ``beam`` sums closest to the vector go on."""
    out = np.empty((len(x), len(books)), np.int64)
    for at in range(0, len(x), block):
        part = x[at : at + block].astype(np.float32)
        n, d = part.shape
        left, codes = part[:, None, :], np.zeros((n, 1, 0), np.int64)
        for m, book in enumerate(books):
            cost = (left * left).sum(axis=2)[:, :, None] - 2 * (left.reshape(-1, d) @ book.T).reshape(n, left.shape[1], -1) + (book * book).sum(axis=1)
            flat = cost.reshape(n, -1)
            width = min(1 if m == len(books) - 1 else beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.arange(width)[None].repeat(n, 0)
            from_, word = best // len(book), best % len(book)
            row = np.arange(n)[:, None]
            left = left[row, from_] - book[word]
            codes = np.concatenate([codes[row, from_], word[:, :, None]], axis=2)
        out[at : at + block] = codes[:, 0]
    return out


def decode(books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return sum(books[m][codes[:, m]] for m in range(len(books)))


def _kmeans(x: np.ndarray, k: int, r: np.random.RandomState, rounds: int = 8) -> np.ndarray:
    """``k`` centres; where there are fewer vectors than that, some are equal."""
    c = x[np.resize(r.permutation(len(x)), k)].copy()
    for _ in range(rounds):
        a = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c).astype(np.float32)
    return c


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, refine: int = 2, k: int = 10, keep: float = KEEP, seed: int = 11) -> Quantiser:
    """Codebooks from a sample of vectors, and the reach and slack that keep ``keep`` of the true ``k`` neighbours each of the part of it that is held out."""
    if not 1 <= words <= 256:
        raise ValueError("a code is one byte, so there are 1 to 256 words")
    r = np.random.RandomState(seed)
    x = x[r.permutation(len(x))].astype(np.float32)
    held = x[: int(HELD_OUT * len(x))]
    fit = x[len(held) :]
    d = x.shape[1]
    left, made = fit.copy(), []
    for _ in range(books):
        made.append(_kmeans(left, words, r))
        c = made[-1]
        left = left - c[((c * c).sum(axis=1) - 2 * left @ c.T).argmin(axis=1)]
    book = np.stack(made)
    for _ in range(refine):
        at = encode(book, fit) + np.arange(books) * words
        gram = np.zeros((books * words, books * words), np.float64)
        right = np.zeros((books * words, d), np.float64)
        for i in range(books):
            np.add.at(right, at[:, i], fit)
            for j in range(books):
                np.add.at(gram, (at[:, i], at[:, j]), 1)
        # Drawn to the codebooks as they are, so that unused codewords stay.
        weight = 0.1
        gram[np.diag_indices_from(gram)] += weight
        book = np.linalg.solve(gram, right + weight * book.reshape(-1, d)).reshape(books, words, d).astype(np.float32)
    # Among vectors of which most were fitted, as in a small table, and among such that none was.
    both = [_tuned(book, made[0], s, r.permutation(len(s))[:512], k, keep) for s in (x, held)]
    return Quantiser(book, made[0], max(t[0] for t in both), max(t[1] for t in both))


def _tuned(book: np.ndarray, centres: np.ndarray, x: np.ndarray, ask: np.ndarray, k: int, keep: float) -> tuple[float, float]:
    """Reach and slack for the vectors of ``x`` at the places ``ask`` against all others of it; without any, nothing is left out."""
    k = min(k, len(x) - 1)
    if k < 1:
        return 1e30, 1e30
    q = Quantiser(book, centres, 0, 0)
    own = np.arange(len(ask))[:, None]
    dist = (x * x).sum(axis=1)[None] - 2 * x[ask] @ x.T
    dist[np.arange(len(ask)), ask] = np.inf
    true = np.argsort(dist, axis=1)[:, :k]
    lists = q.to_lists(x)
    home = lists.argmin(axis=1)
    to = lists[ask]
    reach = np.quantile(to[own, home[true]] - to.min(axis=1)[:, None], keep, method="higher")
    hat = decode(book, encode(book, x))
    seems = estimate((hat * hat).sum(axis=1)[None] - 2 * x[ask] @ hat.T, (x[ask] ** 2).sum(axis=1)[:, None], ((x - hat) ** 2).sum(axis=1)[None])
    seems[np.arange(len(ask)), ask] = np.inf
    kth = np.partition(seems, k - 1, axis=1)[:, k - 1]
    slack = np.quantile(seems[own, true] / np.maximum(kth, 1e-30)[:, None], keep, method="higher")
    return float(reach), float(max(1.0, slack))


def estimate(score: np.ndarray, square: np.ndarray, error: np.ndarray) -> np.ndarray:
    """Squared distances from the table's scores, the queries' squares and the rows' squared errors, which are about orthogonal to what the codes hold."""
    return np.maximum(score + square + error, 0)


def _closest(dist: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least distances, ties by id; of rows that share an id the closest stands for all."""
    some = min(len(dist), 4 * k)
    while True:
        few = np.flatnonzero(dist <= np.partition(dist, some - 1)[some - 1]) if some < len(dist) else np.arange(len(dist))
        order = few[np.lexsort((ids[few], dist[few]))]
        top = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
        if len(top) == k or len(few) == len(dist):
            return top
        some = min(len(dist), 4 * some)


def search_block(q: Quantiser, queries: np.ndarray, ids: np.ndarray, probed: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, codes: np.ndarray, lists: np.ndarray, norms: np.ndarray, errors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of rows: for each query (its place), row ids and squared distances of the best ``k``. Equal ids are never neighbours."""
    at = np.ascontiguousarray((codes + np.arange(codes.shape[1]) * q.books.shape[1]).T)
    tables = q.table(queries)
    squares = (queries.astype(np.float64) ** 2).sum(axis=1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Queries that score the same lists do so together.
    several = np.unique(row_ids, return_inverse=True)[1].ravel() if len(set(row_ids.tolist())) < len(row_ids) else None
    sets, which = np.unique(np.packbits(probed[:, np.unique(lists)], axis=1), axis=0, return_inverse=True)
    for n in range(len(sets)):
        asks = np.flatnonzero(which.ravel() == n)
        on = np.flatnonzero(probed[asks[0]][lists])
        if not len(on):
            continue
        own, norm, error = np.ascontiguousarray(at[:, on]), norms[on], errors[on]
        top_norm = float(norm.max())
        for i in asks:
            seems = estimate(norm - 2 * tables[i].take(own).sum(axis=0), squares[i], error)
            seems[row_ids[on] == ids[i]] = np.inf
            nearest = seems
            if several is not None:
                nearest = np.full(several.max() + 1, np.inf)
                np.minimum.at(nearest, several[on], seems)
            # The k-th of the block is no nearer than the k-th of all, so what matters passes; the rest is for rounding.
            most = np.partition(nearest, k - 1)[k - 1] * q.slack if len(nearest) > k else np.inf
            best = on[(seems <= most + 1e-6 * (squares[i] + top_norm)) & (seems < np.inf)]
            diff = rows[best].astype(np.float64) - queries[i]
            exact = np.einsum("ij,ij->i", diff, diff)
            top = _closest(exact, row_ids[best], k)
            out.append((np.full(len(top), i), row_ids[best[top]], exact[top]))
    if not out:
        return np.zeros(0, np.int64), row_ids[:0], np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _matrix(c) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(c), -1) if len(c) else flat.reshape(0, 0)


def _blocks(centres: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By list: its group of lists that lie near each other and hold ``most`` rows together, and in how many parts the group is cut."""
    first = centres - centres.mean(axis=0)
    order = np.argsort(first @ np.linalg.svd(first, full_matrices=False)[2][0])
    group, held, g = np.zeros(len(order), np.int64), 0, 0
    for i in order:
        if held and held + sizes[i] > most:
            g, held = g + 1, 0
        group[i], held = g, held + sizes[i]
    parts = np.maximum(1, -(-np.bincount(group, sizes).astype(np.int64) // most))
    return group, parts[group]


def _sizes(coded: DataFrame, words: int) -> np.ndarray:
    """Rows by list; as many numbers as the first codebook has words."""
    out = np.zeros(words, np.int64)
    for r in coded.groupBy("list").count().collect():
        out[r["list"]] = r["count"]
    return out


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return v.filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(1e30))))


def neighbours(
    vectors: DataFrame,
    k: int = 10,
    queries: DataFrame | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    train_rows: int = TRAIN_ROWS,
    books: int = BOOKS,
    words: int = WORDS,
    keep: float = KEEP,
) -> DataFrame:
    """``id``, ``rank`` (from 1), ``neighbour``, ``distance`` (Euclidean): the ``k`` nearest others of ``vectors`` to each row of ``queries``, by default to each of ``vectors``.

    Rows with a null id, and vectors that are null, empty, of another length than most, or hold a null or
    non-finite number neither ask nor answer. Rows of one id are never each other's neighbours;
    an id that repeats asks once for all its rows, and is named once. Equal distances rank by id. Other columns are ignored;
    an empty table of either gives an empty result.
    """
    spark = vectors.sparkSession
    v = _valid(vectors, id_col, vector_col)
    kind = v.schema["id"].dataType.simpleString()
    shape = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], f"id {kind}, rank int, neighbour {kind}, distance double")
    v = v.filter(F.size("v") == shape["d"]).select("id", F.col("v").cast("array<float>").alias("v"))
    sample = v.orderBy(F.xxhash64("id", "v"), "id").limit(train_rows).toArrow()
    q = train(_matrix(sample.column("v")), books, words, k=k, keep=keep)
    shared = spark.sparkContext.broadcast(q)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qq = shared.value
        for b in batches:
            x = _matrix(b.column(1))
            codes = encode(qq.books, x)
            hat = decode(qq.books, codes)
            lists = qq.to_lists(x).argmin(axis=1) if len(x) else np.zeros(0, int)
            numbers = ((hat * hat).sum(axis=1), ((x - hat) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), *(pa.array(n.astype(np.float32)) for n in numbers), pa.array(lists.astype(np.int32))],
                names=["id", "v", "codes", "norm", "error", "list"],
            )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.to_lists(x).argmin(axis=1).astype(np.int32) if len(x) else [], pa.int32())], names=["id", "v", "list"])

    rows = stored(v.mapInArrow(coded, f"id {kind}, v array<float>, codes binary, norm float, error float, list int"), "codes")
    if queries is None:
        asks = rows.select("id", "v", "list")
    else:
        asked = _valid(queries, id_col, vector_col).filter(F.size("v") == shape["d"]).select(F.col("id").cast(kind).alias("id"), F.col("v").cast("array<float>").alias("v"))
        asks = stored(asked.mapInArrow(listed, f"id {kind}, v array<float>, list int"), "asks")
    sizes, asking = _sizes(rows, words), _sizes(asks, words)
    least = 5 * k + 1
    row_group, row_parts = _blocks(q.centres, sizes, ROW_BLOCK)
    ask_group, ask_parts = _blocks(q.centres, asking, QUERY_BLOCK)

    def place(df: DataFrame, group: np.ndarray, parts: np.ndarray) -> DataFrame:
        # One row for each list, of which there are as many as words.
        plan = spark.createDataFrame([(i, int(g), int(p)) for i, (g, p) in enumerate(zip(group, parts, strict=True))], "l int, g int, n int")
        return df.join(F.broadcast(plan), F.col("list") == F.col("l")).withColumn("s", F.pmod(F.xxhash64("id", "v"), F.col("n")).cast("int")).drop("l", "n")

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            hit = shared.value.probed(x, sizes, least) if len(x) else np.zeros((0, words), bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([np.flatnonzero(h).astype(np.int32) for h in hit], pa.list_(pa.int32()))], names=[*b.schema.names, "lists"])

    asks = stored(place(asks, ask_group, ask_parts).select("id", "v", "g", "s").mapInArrow(probing, f"id {kind}, v array<float>, g int, s int, lists array<int>"), "probes")
    # Pairs of a block of queries and a list, then of a block of queries and a block of rows.
    met = asks.select(F.col("g").alias("ag"), F.col("s").alias("as"), F.explode("lists").alias("list")).distinct()
    at = spark.createDataFrame([(i, int(g), int(p)) for i, (g, p) in enumerate(zip(row_group, row_parts, strict=True)) if sizes[i]], "l int, rg int, n int")
    groups = F.array_distinct(F.transform("lists", lambda i: F.element_at(F.array(*[F.struct(F.lit(int(g)).alias("rg"), F.lit(int(p)).alias("n")) for g, p in zip(row_group, row_parts, strict=True)]), i + 1)))
    left = asks.select("id", "v", "lists", F.col("g").alias("ag"), F.col("s").alias("as"), F.explode(groups).alias("t"))
    left = left.select("id", "v", "lists", "ag", "as", "t.rg", F.explode(F.sequence(F.lit(0), F.col("t.n") - 1)).alias("rs"))
    wanted = met.join(F.broadcast(at), F.col("list") == F.col("l")).select("ag", "as", F.col("rg").alias("g1")).distinct()
    right = place(rows, row_group, row_parts).join(wanted, F.col("g") == F.col("g1")).select(F.col("id").alias("row"), F.col("v").alias("x"), "codes", "norm", "error", "list", "ag", "as", F.col("g").alias("rg"), F.col("s").alias("rs"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, row_ids = a.column("id").to_pandas().to_numpy(), b.column("row").to_pandas().to_numpy()
        if not a.num_rows or not b.num_rows:
            i, nb, dist = np.zeros(0, np.int64), row_ids[:0], np.zeros(0)
        else:
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, -1).astype(np.int64)
            probed = np.zeros((a.num_rows, words), bool)
            for j, ls in enumerate(a.column("lists").to_pylist()):
                probed[j, ls] = True
            numbers = (b.column(c).to_numpy() for c in ("list", "norm", "error"))
            i, nb, dist = search_block(shared.value, _matrix(a.column("v")), ids, probed, row_ids, _matrix(b.column("x")), codes, *numbers, k)
        kind_ = a.schema.field("id").type
        return pa.table({"id": pa.array(ids[i], kind_), "neighbour": pa.array(nb, kind_), "d2": pa.array(dist)})

    keys = ["ag", "as", "rg", "rs"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"id {kind}, neighbour {kind}, d2 double")
    found = found.groupBy("id", "neighbour").agg(F.min("d2").alias("d2"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "neighbour", F.sqrt("d2").alias("distance"))
