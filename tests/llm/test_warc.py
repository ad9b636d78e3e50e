import hashlib

import pytest

from siftwork.llm import warc

PAGES = "page_id bigint, url string, html string, id string, payload string, digest string"


def test_round_trip_and_single_storage(spark):
    pages = spark.createDataFrame([(1, "u", "same", "x", "y", "z"), (2, "v", "same", "x", "y", "z"), (3, None, "", "x", "y", "z"), (None, "w", None, "x", "y", "z"), (4, "é", "é\r\n\r\nbody" * 50_000, "x", "y", "z"), (1, "u", "same", "x", "y", "z")], PAGES)
    recs = warc.records(pages)
    arc = warc.archive(recs)
    assert arc.payloads.count() == 3 and arc.headers.count() == 6
    want = sorted(bytes(r["record"]) for r in recs.collect())
    got = warc.restore(arc).collect()
    assert sorted(bytes(r["record"]) for r in got) == want
    assert all(r["verified"] and r["one_content"] for r in got)
    assert sorted(r["n_refs"] for r in got) == [1, 2, 2, 3, 3, 3]


@pytest.mark.parametrize(
    "raw",
    [
        b"",
        b"no blank line",
        b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabcdeTAIL",
        b"WARC/1.1\r\nContent-Length: 500\r\n\r\nshort",
        b"WARC/1.1\r\n\r\nno length",
        b"WARC/1.1\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha256:" + b"0" * 64 + b"\r\n\r\nabc\r\n\r\n",
        b"WARC/1.1\r\ncontent-length: 4\r\n\r\n\xff\x00\xfe\x80\r\n\r\n",
        b"\xff\xfe broken head\r\nContent-Length: 2\r\n\r\nab",
    ],
)
def test_any_record_comes_back(spark, raw):
    recs = spark.createDataFrame([(1, bytearray(raw))], "id int, record binary")
    got = warc.restore(warc.archive(recs)).first()
    assert bytes(got["record"]) == raw
    assert hashlib.sha256(raw).hexdigest() == got["record_digest"]
    if b"0" * 64 in raw:
        assert got["verified"] is False
    elif b"Payload-Digest" not in raw:
        assert got["verified"] is None


def test_nothing(spark):
    assert warc.restore(warc.archive(warc.records(spark.createDataFrame([], PAGES)))).count() == 0
    got = warc.restore(warc.archive(spark.createDataFrame([(1, None)], "id int, record binary"))).first()
    assert got["record"] is None and got["id"] == 1
