"""Vectorised text hashing shared by the batch operators: words of many texts at once, as 64-bit numbers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INV)):
            p = np.full(max(n, 1 << 20), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span of ``buf``, equal for equal bytes wherever they lie."""
    up, down = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def chunks(lengths: Iterable[int | None], size: int = 512 * 1024) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of texts of about ``size`` together; a longer text has a range of its own."""
    at, total, i = 0, 0, -1
    for i, n in enumerate(lengths):
        if total and total + (n or 0) > size:
            yield at, i
            at, total = i, 0
        total += n or 0
    if at <= i:
        yield at, i + 1


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's words begin (one more entry than texts).

    Words are runs of ASCII letters, digits, underscores and non-ASCII characters, in lower case.
    """
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    on = _WORD[buf]
    edge = np.flatnonzero(on[1:] != on[:-1]) + 1
    if len(on) and on[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return span_hashes(buf, starts, ends), np.searchsorted(starts, offsets)
