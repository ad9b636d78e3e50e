import base64
import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siftwork.llm import bpe
from tests.llm.helpers import crowded, empty, odd, rows

V = bpe.Vocabulary.load()
T = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
T.encode_special_tokens = True


def want(text):
    return T.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello world", "  two  spaces\n\n\n end ", "naïve café 日本語 \U0001f600‍", "<|endoftext|>", "I'll we've 's 'S x'd", "a" * 5000, " " * 5000, "=" * 9000, "\n" * 4999 + "x", "ab" * 4000, "12345 " * 1000, "\0\x01", "é" * 6000, " 　  x"]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_same_as_library(i):
    t = TEXTS[i]
    assert bpe.encode(V, t) == want(t)
    assert bpe.decode(V, want(t)) == t


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=300), st.integers(1, 40))
def test_any_text_in_any_chunks(text, n):
    enc = bpe.TextEncoder(V)
    out = []
    for at in range(0, len(text), n):
        out += enc.feed(text[at : at + n])
    out += enc.finish()
    assert out == want(text)
    dec = bpe.TextDecoder()
    data = b"".join(V.tokens[t] for t in out)
    assert "".join([dec.feed(data[i : i + n]) for i in range(0, len(data), n)]) + dec.finish() == text


ODD = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\u200b", "\u00a0", "\u2028", "\u3000", " ", "\n", "\t", "\0", "'", "s", "é", "1", "\U0001f600"]


@pytest.mark.parametrize("length", [bpe.LONG_PIECE - 2, bpe.LONG_PIECE, bpe.LONG_PIECE + 3, bpe.WINDOW - 1, bpe.WINDOW, bpe.WINDOW + 2])
@pytest.mark.parametrize("seed", range(2))
def test_runs_of_odd_characters(length, seed):
    """Runs that begin, end or are broken by spaces of all kinds; a text without progress would never end."""
    r = random.Random(f"{length} {seed}")
    for _ in range(4):
        a, b, c = r.choice(ODD), r.choice(ODD), r.choice(ODD)
        for t in (a + b * length, a * length + b + c * length, (a + b) * (length // 2) + c, a + b * length + c):
            assert bpe.encode(V, t) == want(t), (a, b, c)


def test_space_and_control_character():
    t = " " + "\x1c" * 70_000
    assert bpe.encode(V, t) == want(t)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(ODD), max_size=60), st.integers(1, 30))
def test_any_window(text, n):
    assert bpe.encode(V, text, window=n) == want(text)


def test_stream_of_long_pieces_is_bounded():
    r = random.Random(3)
    text = "".join(r.choice("abcdeghilnoprst") for _ in range(200_000))
    enc, out = bpe.TextEncoder(V), []
    most = 0
    for at in range(0, len(text), 1000):
        out += enc.feed(text[at : at + 1000])
        most = max(most, len(enc.tail) + (len(enc.long[1].held) if enc.long else 0))
    out += enc.finish()
    assert out == V.encode(text.encode())
    assert most < bpe.LONG_PIECE + 8 * V.lookahead + 4096


def test_lookahead_holds_on_random_pieces():
    """A token that ends further than the lookahead from what is read is the same whatever follows."""
    r = random.Random(7)
    words = [t for t in V.tokens.values() if 2 < len(t) < 12]
    for _ in range(60):
        data = b"".join(r.choice(words) for _ in range(300))
        whole = V.encode(data)
        for _ in range(5):
            cut = r.randrange(len(data) // 2, len(data))
            part, used = V.encode(data[:cut]), 0
            for a, b in zip(part, whole, strict=False):
                used += len(V.tokens[a])
                if used > cut - V.lookahead:
                    break
                assert a == b


def test_rank_file_gives_the_same():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        v = bpe.Vocabulary.parse(f.read())
    for t in TEXTS:
        assert bpe.encode(v, t) == want(t)


def test_other_rank_file():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    v = bpe.Vocabulary.load(path)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in TEXTS:
        assert bpe.encode(v, t) == enc.encode_ordinary(t)


def test_decoding_of_broken_bytes():
    dec = bpe.TextDecoder()
    data = b"\xff\xe6\x97a\xf0\x9f\x98"
    assert "".join(dec.feed(data[i : i + 1]) for i in range(len(data))) + dec.finish() == data.decode("utf-8", "replace")
    assert bpe.decode(V, [10**9]) == "�"
    for text in ("", "a", "naïve 日本", "x" * 9000):
        assert bpe.returns(V, bpe.encode(V, text), text)
        assert not bpe.returns(V, bpe.encode(V, text), text + "b") and not bpe.returns(V, [*bpe.encode(V, text), 5], text)


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in bpe.tokenized(df).collect():
        assert r["tokens"] == want(text[r["doc_id"]]) and r["n_tokens"] == len(r["tokens"]) and r["round_trip"]


def test_odd_rows(spark):
    got = bpe.tokenized(odd(spark))
    assert got.count() == 13
    for r in got.collect():
        assert (r["tokens"] is None) == (r["n_tokens"] is None) == (r["round_trip"] is None)
        assert r["round_trip"] in (True, None)
    assert rows(bpe.tokenized(crowded(spark))) == rows(got)
    assert bpe.tokenized(empty(spark)).count() == 0
    with pytest.raises(ValueError, match="tokens"):
        bpe.tokenized(crowded(spark), keep_cols=["doc_id", "tokens"])
