"""Each stage of the pipeline against the same decisions made by plain loops."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline as cp
from siftwork.llm import bpe, mixing, near_dedup, pii, quality
from tests.llm.helpers import SCHEMA


def test_stages_are_what_they_say(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    frames = {"documents": docs}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, small)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        frames[name] = docs
    at = {k: v.collect() for k, v in frames.items()}
    model = quality.train(frames["documents"], spark.read.parquet(f"{small}/labels.parquet"))
    score = quality.score(model, [r["text"] for r in at["documents"]])[0]
    assert {r["doc_id"] for r in at["quality"]} == {r["doc_id"] for r, s in zip(at["documents"], score, strict=True) if s >= 0.5}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in at["quality"]}
    assert np.mean([(i in kept) == bool(y) for i, y in labels.items() if i in {r["doc_id"] for r in at["documents"]}]) > 0.97

    ids, texts = [r["doc_id"] for r in at["quality"]], [r["text"] for r in at["quality"]]
    s, cut = near_dedup.shingles(texts)
    sets = [set(s[cut[i] : cut[i + 1]].tolist()) for i in range(len(texts))]
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(ids)):
        groups[find(i)].append(ids[i])
    assert {r["doc_id"] for r in at["near_duplicates"]} == {min(g) for g in groups.values()}

    field = pii.default_field()
    before = {r["doc_id"]: r["text"] for r in at["near_duplicates"]}
    after = {r["doc_id"]: r["text"] for r in at["personal_data"]}
    assert after == {i: pii.redact(t, pii.spans(field, [t])[0]) for i, t in before.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in at["personal_data"])

    size = collections.Counter()
    for r in at["personal_data"]:
        size[r["source"]] += r["n_chars"]
    least = min(v**0.5 / v for v in size.values())
    rate = {k: round(v**0.5 / v / least * mixing.UNIT) for k, v in size.items()}
    want = collections.Counter()
    for src in size:
        place = int(hashlib.md5(f"7:{src}".encode()).hexdigest()[:8], 16) % mixing.UNIT
        for r in sorted((r for r in at["personal_data"] if r["source"] == src), key=lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()):
            want[r["doc_id"]] += (place + rate[src]) // mixing.UNIT - place // mixing.UNIT
            place += rate[src]
    assert collections.Counter(r["doc_id"] for r in at["mixing"]) == +want

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    text = {r["doc_id"]: r["text"] for r in at["mixing"]}
    assert all(r["tokens"] == t.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in at["tokens"])
    ran = cp.run(spark, small)
    assert ran.count() == len(at["tokens"]) and set(ran.columns) == set(at["tokens"][0].asDict())


def test_documents_columns_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_odd_documents(spark, small):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "some text that is long enough to be kept, maybe", None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)], SCHEMA)
    for _, stage in cp.STAGES[1:]:
        out = stage(spark, docs, small)
        assert out.count() >= 1
    for _, stage in cp.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), small).count() == 0


def taken_by_workers(monkeypatch, df, make):
    """The functions that ``make`` gives to ``mapInArrow``."""
    taken, real = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, *a, **k: taken.append(f) or real(self, f, *a, **k))
    make()
    return taken


def traced(run, batch):
    """What ``run`` gives for the batch, one at a time, and the most bytes that Python and numpy held of it."""
    tracemalloc.start()
    rows = [out.to_pylist() for out in run(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most


def test_training_reads_a_batch_in_parts(spark, monkeypatch):
    texts = [f"A line of document {i}, one of many.\n" * 50 if i % 9 else None for i in range(2000)]
    docs, labels = spark.createDataFrame([(1, "Some text.", "en", "a", 10)], SCHEMA), spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    (run,) = taken_by_workers(monkeypatch, docs, lambda: quality.train(docs, labels))
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts), pa.array([1.0] * 2000)], names=["id", "text", "y"])
    parts, most = traced(run, batch)
    got = [r for p in parts for r in p]
    assert [r["id"] for r in got] == list(range(2000))
    for i in (0, 1, 700, 1999):
        x = quality.passages([(texts[i] or "").encode()])[0]
        assert got[i]["x"] == x.astype(np.float16).tobytes()
    assert most < 120 << 20


def test_personal_data_is_read_in_parts(spark, monkeypatch):
    texts = [None if i % 50 == 0 else f"Number {i} writes to user{i}@host-{i % 9}.net. " + "Nothing else here. " * 60 for i in range(4000)]
    docs = spark.createDataFrame([], SCHEMA)
    field = pii.default_field()
    (run,) = taken_by_workers(monkeypatch, docs, lambda: pii.redacted(docs, field))
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts), pa.array(["en"] * n), pa.array(["a"] * n), pa.array([0] * n)], names=docs.columns)
    parts, _ = traced(run, batch)
    got = [r for p in parts for r in p]
    assert [r["doc_id"] for r in got] == list(range(n))
    assert all(r["text"] == (t and t.replace(f"user{i}@host-{i % 9}.net", "<EMAIL>")) for i, (r, t) in enumerate(zip(got, texts, strict=True)))
    assert max(sum(len(r["text"] or "") for r in p) for p in parts) <= 1 << 20
