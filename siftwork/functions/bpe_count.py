"""Exact token counts by a byte-pair vocabulary in a rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _file(name: str) -> bytes:
    with open(name, "rb") as f:
        return f.read()


def counter(ranks: bytes | None = None, pattern: str = PATTERN):
    """A function from text to its number of tokens, of the content of a rank file, by default that of DEFAULT_RANKS."""
    import tiktoken

    lines = (_file(DEFAULT_RANKS) if ranks is None else ranks).splitlines()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def exact_tokens(text: Column, ranks_file: str = DEFAULT_RANKS, pattern: str = PATTERN) -> Column:
    """The number of tokens; bytes that are no text count as replacement characters. Null stays null.

    The rank file (a few MB, whatever the data) is read on the driver and broadcast; any vocabulary of that format can be named.
    """
    shared = SparkSession.active().sparkContext.broadcast(_file(ranks_file))

    @F.pandas_udf("bigint")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(shared.value, pattern)
        for texts in parts:
            yield pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    return run(text.cast("string"))
