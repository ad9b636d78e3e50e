"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded from what its characters and words look
like, gated attention (tanh times sigmoid) weighs the passages, and the weighted
representation is scored. Encoder, attention and scorer are learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.hashing import chunks, span_hashes

PASSAGE = 1000
#: The most labelled documents that a model is trained on, those of the least hash.
TRAIN_DOCS = 4000
#: The most passages of a document that a model is trained on; all are scored.
PASSAGES = 256
ENCODED, GATES = 32, 16

_CLASSES = 12
_CLASS = np.full(256, 11, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?", b"|", b"#*$&%@~^", b"\"'()[]{}<>", bytes(range(128, 256)))):
    _CLASS[list(_chars)] = _k
FEATURES = _CLASSES * _CLASSES + 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of the passages of all texts (float32), the text each is from, and where it begins and ends.

    Passages are lines, cut every PASSAGE bytes; blank ones are left out.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    ends_of = np.cumsum(lengths)
    stops = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], stops[:-1] + 1])
    n_cuts = np.maximum((stops - starts + PASSAGE - 1) // PASSAGE, 1)
    first = np.repeat(np.cumsum(n_cuts) - n_cuts, n_cuts)
    begin = np.repeat(starts, n_cuts) + (np.arange(len(first)) - first) * PASSAGE
    end = np.minimum(begin + PASSAGE, np.repeat(stops, n_cuts))
    cls = _CLASS[buf]
    solid = np.concatenate([[0], np.cumsum((cls != 3) & (cls != 4))])
    real = solid[end] > solid[begin]
    begin, end = begin[real], end[real]
    n = len(begin)
    if not n:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), begin, end
    owner = np.searchsorted(ends_of, begin, side="right")
    # A passage's pairs of neighbouring character classes; what lies outside of passages falls into one bin too many.
    of = np.full(len(buf), n, np.int64)
    size = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    of[at] = np.repeat(np.arange(n), size)
    pairs = cls[:-1] * _CLASSES + cls[1:]
    grid = np.bincount(of[:-1] * (_CLASSES * _CLASSES) + pairs, minlength=(n + 1) * _CLASSES * _CLASSES)[: n * _CLASSES * _CLASSES].reshape(n, -1)
    # Words are what lies between white space.
    word = (cls != 3) & (cls != 4)
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    ws, we = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    wh = span_hashes(buf, ws, we)
    wp = of[ws]
    again = np.zeros(len(ws), bool)
    again[1:] = (wh[1:] == wh[:-1]) & (wp[1:] == wp[:-1])
    n_words = np.bincount(wp, minlength=n + 1)[:n]
    n_again = np.bincount(wp, again, minlength=n + 1)[:n]
    letters = np.bincount(wp, we - ws, minlength=n + 1)[:n]
    same = span_hashes(buf, begin, end) ^ owner.astype(np.uint64)
    _, back, counts = np.unique(same, return_inverse=True, return_counts=True)
    extra = np.stack(
        [
            n_again / np.maximum(n_words, 1),
            letters / np.maximum(n_words, 1) / 10,
            np.log1p(n_words) / 5,
            np.log1p(size) / 7,
            (counts[back] > 1).astype(float),
            np.log1p(np.bincount(owner, minlength=len(texts))[owner]) / 5,
        ],
        axis=1,
    )
    x = np.concatenate([np.sqrt(grid / np.maximum(size, 1)[:, None]), extra], axis=1)
    return x.astype(np.float32), owner, begin, end


@dataclass
class Model:
    """Parameters; ``params`` is empty where the labels gave nothing to learn, and every score is then ``prior``."""

    mean: np.ndarray
    scale: np.ndarray
    params: list[np.ndarray]
    prior: float

    def forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Logits of ``n`` bags and the attention of their passages; ``bag`` ascends and has every bag."""
        w, b, v, u, g, o, c = self.params
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w + b)
        t, s = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (t * s) @ g
        first = np.searchsorted(bag, np.arange(n))
        top = np.maximum.reduceat(e, first)
        a = np.exp(e - top[bag])
        a = a / np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return z @ o + c[0], a, (x, h, t, s, first, z)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, bag: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 3) -> Model:
    """Learn from bags (``bag`` ascends from 0 without gaps) and their labels by Adam; both classes weigh the same."""
    n = len(y)
    mean, scale = x.mean(axis=0) if len(x) else np.zeros(FEATURES), (x.std(axis=0) if len(x) else np.ones(FEATURES)) + 0.05
    if n == 0 or y.min() == y.max():
        return Model(mean, scale, [], float(y.mean()) if n else 1.0)
    r = np.random.RandomState(seed)
    d = x.shape[1]
    p = [r.randn(d, ENCODED) / np.sqrt(d), np.zeros(ENCODED), r.randn(ENCODED, GATES) / np.sqrt(ENCODED), r.randn(ENCODED, GATES) / np.sqrt(ENCODED), r.randn(GATES) / np.sqrt(GATES), r.randn(ENCODED) / np.sqrt(ENCODED), np.zeros(1)]
    model = Model(mean, scale, p, float(y.mean()))
    m, vv = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    first = np.searchsorted(bag, np.arange(n + 1))
    share = y.mean()
    cost = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    step = 0
    for epoch in range(epochs):
        for some in np.array_split(r.permutation(n), max(1, n // batch)):
            take = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
            own = np.repeat(np.arange(len(some)), first[some + 1] - first[some])
            logit, a, (xs, h, t, s, f, z) = model.forward(x[take], own, len(some))
            w, b, v, u, g, o, c = model.params
            dl = (_sigmoid(logit) - y[some]) * cost[some] / len(some)
            dz = dl[:, None] * o
            da = (dz[own] * h).sum(axis=1)
            de = a * (da - np.add.reduceat(a * da, f)[own])
            dh = a[:, None] * dz[own]
            dts = de[:, None] * g
            dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh += dt @ v.T + ds @ u.T
            dx = dh * (1 - h * h)
            grads = [xs.T @ dx, dx.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ dl, np.array([dl.sum()])]
            step += 1
            lr = rate * (0.1 if epoch >= epochs * 2 // 3 else 1)
            for i, q in enumerate(grads):
                q = q + decay * model.params[i]
                m[i], vv[i] = 0.9 * m[i] + 0.1 * q, 0.999 * vv[i] + 0.001 * q * q
                model.params[i] = model.params[i] - lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(vv[i] / (1 - 0.999**step)) + 1e-8)
    return model


def score(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good quality (NaN without passages), number of passages, and the number of the one that weighs most."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    x, owner, _, _ = passages(data)
    n = len(texts)
    out, top, count = np.full(n, np.nan), np.full(n, -1, np.int64), np.bincount(owner, minlength=n)
    if len(owner):
        bags, own = np.unique(owner, return_inverse=True)
        if model.params:
            logit, a, _ = model.forward(x.astype(np.float64), own, len(bags))
            out[bags] = _sigmoid(logit)
        else:
            a = np.ones(len(own))
            out[bags] = model.prior
        order = np.lexsort((np.arange(len(own)), -a, own))
        first = np.searchsorted(own[order], np.arange(len(bags)))
        begin = np.searchsorted(own, np.arange(len(bags)))
        top[bags] = order[first] - begin
    return out, count, top


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", seed: int = 3) -> Model:
    """Fit on at most ``most`` labelled documents, those whose ids have the least hashes.

    Null ids and labels are left out; a document with several labels takes their majority, the higher one
    on a tie. Documents repeated under one id are all used. Labels of one kind, or none, give a constant model, as do empty tables.
    Of a document with very many passages ``PASSAGES`` are learned from, spread evenly over all of it, so that what reaches the driver is bounded in bytes, too.
    """
    y = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
        .filter("id is not null and y is not null")
        .groupBy("id")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    )
    # Bounded by ``most``, so the side that is broadcast is, too.
    some = y.join(docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(most)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Features take about a hundred times the room of the texts.
            for i, j in chunks(pc.binary_length(batch.column(1)).to_pylist(), 1 << 18):
                part = batch.slice(i, j - i)
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                x, owner, _, _ = passages(texts)
                cut = np.searchsorted(owner, np.arange(len(texts) + 1))
                rows = [x[a + np.arange(min(b - a, PASSAGES)) * (b - a) // max(1, min(b - a, PASSAGES))].astype(np.float16).tobytes() for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = src.select("id", "text", "y").mapInArrow(run, f"id {kind}, y double, x binary").toArrow().to_pylist()
    rows = sorted((r for r in rows if r["x"]), key=lambda r: (r["id"], r["x"]))
    if not rows:
        return fit(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0), seed=seed)
    xs = [np.frombuffer(r["x"], np.float16).reshape(-1, FEATURES).astype(np.float64) for r in rows]
    bag = np.repeat(np.arange(len(xs)), [len(q) for q in xs])
    return fit(np.concatenate(xs), bag, np.array([r["y"] for r in rows]), seed=seed)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """``keep_cols`` (by default the id), ``quality_score``, ``n_passages``, ``top_passage``.

    Null, empty and blank texts have a null score and no top passage. Every row is scored by itself, repeated ones alike; all passages of a text of any length count;
    of passages that weigh the same the first is the top one. An empty table gives an empty result.
    """
    keep = keep_cols or [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            got = [score(model, texts[a:b]) for a, b in chunks(map(len, (t or "" for t in texts)), 1 << 18)]
            q, n, top = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(q, mask=np.isnan(q)), pa.array(n.astype(np.int32)), pa.array(top.astype(np.int32), mask=top < 0)],
                names=[*batch.schema.names[:-1], "quality_score", "n_passages", "top_passage"],
            )

    if clash := {"quality_score", "n_passages", "top_passage"} & set(keep):
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(run, f"{kept}, quality_score double, n_passages int, top_passage int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs``, all columns as they are, without the rows scored under ``threshold``, null and blank texts."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else str(t) for t in batch.column(at).to_pylist()]
            for a, b in chunks(map(len, (t or "" for t in texts)), 1 << 18):
                q, _, _ = score(model, texts[a:b])
                yield batch.slice(a, b - a).filter(pa.array(np.nan_to_num(q, nan=-1.0) >= threshold))

    return docs.mapInArrow(run, docs.schema)
