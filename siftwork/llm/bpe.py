"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

Merging a pair can change what lies to its left only through rules of lower priority,
so a change at the end of the read text reaches back over chains of rules of falling priority whose
operands meet. The longest such chain of the merge list bounds the lookahead: a
token that ends farther than that from the end of what has been read is final,
whatever follows. The encoder emits such tokens and keeps the rest, so its memory does
not grow with the text. The splitting pattern runs over windows in the same way.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.hashing import chunks

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
WINDOW = 1 << 16
#: Texts whose tokens are held at once, in bytes; a longer one is held by itself.
BATCH_BYTES = 8 << 20
LONG_PIECE = 4096
#: A match that ends this far before the end of a window can't change with what follows.
PATTERN_LOOKAHEAD = 3


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes by id, and merges: (id, id) to (rank, id). Holds bytes and results of earlier merges only."""

    def __init__(self, tokens: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.tokens = tokens
        self.merges = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
        self.ranks = {(a, b): r for r, (a, b, _) in enumerate(merges)}
        self.results = [c for _, _, c in merges]
        ids = {t: i for i, t in tokens.items()}
        self.single = [ids[bytes([b])] for b in range(256)]
        self.lookahead = self._lookahead(merges, ids)

    @classmethod
    def parse(cls, data: bytes) -> Vocabulary:
        """Of a tokenizers JSON file, or of a rank file, whose merges are recovered from its ranks."""
        if data[:1] == b"{":
            model = json.loads(data)["model"]
            letters = _byte_letters()
            ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            raw = [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in pairs]
            whole = {a + b for a, b in raw} | {bytes([b]) for b in range(256)}
            return cls({i: t for t, i in ids.items() if t in whole}, [(ids[a], ids[b], ids[a + b]) for a, b in raw])
        ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}
        merges = []
        for t, r in sorted(ids.items(), key=lambda x: x[1]):
            if len(t) > 1:
                parts = [t[i : i + 1] for i in range(len(t))]
                while len(parts) > 2:
                    best = min((ids.get(a + b, r), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                    if best[0] >= r:
                        break
                    parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
                if len(parts) == 2:
                    merges.append((ids[parts[0]], ids[parts[1]], r))
        return cls({i: t for t, i in ids.items()}, merges)

    @classmethod
    def load(cls, path: str = DEFAULT_VOCABULARY) -> Vocabulary:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    def _lookahead(self, merges: list[tuple[int, int, int]], ids: dict[bytes, int]) -> int:
        """Bytes that must follow a token's end before it is final.

        ``reach[w]``: how far to the left of a token ``w`` a change of what ``w``
        became can be felt, through rules later than those looked at so far
        whose right operand begins with ``w``.
        """
        reach: dict[int, int] = {}
        most = 1
        for a, b, c in reversed(merges):
            left, right = self.tokens[a], self.tokens[b]
            far = reach.get(a, 0)
            most = max(most, len(self.tokens[c]) - 1 + far)
            for n in range(1, len(right) + 1):
                if (w := ids.get(right[:n])) is not None:
                    reach[w] = max(reach.get(w, 0), len(left) + far)
        return most

    def encode(self, data: bytes) -> list[int]:
        """The merges applied to all of ``data``: always the pair of least rank, the leftmost first."""
        ids = [self.single[b] for b in data]
        merges = self.merges
        if len(ids) < 64:
            none, get = len(self.results), self.ranks.get
            ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while ranks and (r := min(ranks)) < none:
                i = ranks.index(r)
                c = self.results[r]
                ids[i : i + 2] = (c,)
                del ranks[i]
                if i:
                    ranks[i - 1] = get((ids[i - 1], c), none)
                if i < len(ranks):
                    ranks[i] = get((c, ids[i + 1]), none)
            return ids
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], k = c, False, nxt[j]
            nxt[i] = k
            if k < n:
                prv[k] = i
                if (m := merges.get((c, ids[k]))) is not None:
                    heapq.heappush(heap, (m[0], i, c, ids[k], m[1]))
            if (p := prv[i]) >= 0 and (m := merges.get((ids[p], c))) is not None:
                heapq.heappush(heap, (m[0], p, ids[p], c, m[1]))
        return [x for x, on in zip(ids, alive, strict=True) if on]


class PieceStream:
    """Encodes one piece of any length from parts of it, holding at most a few lookaheads of bytes."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.held = vocab, b""
        self.block = max(1024, 4 * vocab.lookahead)

    def feed(self, data: bytes) -> Iterator[int]:
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            if len(self.held) >= self.block:
                final, used = len(self.held) - self.vocab.lookahead, 0
                for t in self.vocab.encode(self.held):
                    end = used + len(self.vocab.tokens[t])
                    if end > final:
                        break
                    used = end
                    yield t
                self.held = self.held[used:]

    def finish(self) -> Iterator[int]:
        yield from self.vocab.encode(self.held)
        self.held = b""


class _Pieces(dict):
    """Tokens by piece. When it has grown, its content becomes ``old``, from which only what is met again returns."""

    def __init__(self, vocab: Vocabulary, most: int = 200_000):
        super().__init__()
        self.vocab, self.most = vocab, most
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if (out := self.old.get(piece)) is None:
            data = piece.encode("utf-8", "replace")
            if len(data) > LONG_PIECE:
                stream = PieceStream(self.vocab)
                return tuple(chain(stream.feed(data), stream.finish()))
            out = tuple(self.vocab.encode(data))
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out


_SPLIT = regex.compile(PATTERN).findall
_RUNS = {name: regex.compile(p) for name, p in {"letters": r"\p{L}+", "numbers": r"\p{N}+", "spaces": r"\s+", "others": r"[^\s\p{L}\p{N}]+"}.items()}


class TextEncoder:
    """Encodes a text from chunks of it; tokens come out as soon as they are final."""

    def __init__(self, vocab: Vocabulary, pieces: _Pieces | None = None):
        self.vocab = vocab
        self.pieces = _Pieces(vocab) if pieces is None else pieces
        self.tail = ""
        self.long: tuple[str, PieceStream] | None = None

    def parts(self, chunk: str) -> Iterator[Iterable[int]]:
        """The tokens that are final once ``chunk`` is read, in parts that have to be used up one by one."""
        self.tail += chunk
        while self.tail:
            before = len(self.tail)
            if self.long:
                name, stream = self.long
                m = _RUNS[name].match(self.tail)
                end = m.end() if m else 0
                ended = end < before
                # The last white space before other text belongs to what follows.
                take = max(end - 1, 0) if name == "spaces" else end
                yield stream.feed(self.tail[:take].encode("utf-8", "replace"))
                self.tail = self.tail[take:]
                if not ended:
                    return
                yield stream.finish()
                self.long = None
                continue
            # The pieces cover the text; those that could still change are the last ones.
            found = _SPLIT(self.tail)
            open_ = 0
            while found and open_ < PATTERN_LOOKAHEAD:
                open_ += len(found.pop())
            yield chain.from_iterable(map(self.pieces.__getitem__, found))
            self.tail = self.tail[before - open_ :]
            if len(self.tail) < LONG_PIECE:
                return
            # A piece is at most one space and a run of one kind, or white space.
            head = 1 if self.tail[0] == " " and not _RUNS["spaces"].match(self.tail[1]) else 0
            name = next(k for k, r in _RUNS.items() if r.match(self.tail[head]))
            self.long = (name, PieceStream(self.vocab))
            yield self.long[1].feed(self.tail[:head].encode())
            self.tail = self.tail[head:]

    def rest(self) -> Iterator[Iterable[int]]:
        """The tokens of what is left at the end of the text."""
        if self.long:
            yield self.long[1].feed(self.tail.encode("utf-8", "replace"))
            yield self.long[1].finish()
        else:
            yield chain.from_iterable(map(self.pieces.__getitem__, _SPLIT(self.tail)))
        self.tail, self.long = "", None

    def feed(self, chunk: str) -> Iterator[int]:
        return chain.from_iterable(self.parts(chunk))

    def finish(self) -> Iterator[int]:
        return chain.from_iterable(self.rest())


class TextDecoder:
    """Bytes to text, incrementally: the state is the bytes of a character that is not whole yet (three at most)."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _whole(data: bytes) -> int:
        """The length without an unfinished character at the end."""
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return len(data) - back if need > back else len(data)
            if b < 0x80:
                break
        return len(data)

    def feed(self, data: bytes) -> str:
        data = self.held + data
        n = self._whole(data)
        self.held = data[n:]
        return data[:n].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def encoded(vocab: Vocabulary, text: str, pieces: _Pieces | None = None, window: int = WINDOW) -> Iterator[int]:
    """The tokens of ``text``, which is read window by window, whatever its length."""
    enc = TextEncoder(vocab, pieces)
    return chain(chain.from_iterable(enc.feed(text[at : at + window]) for at in range(0, len(text), window)), enc.finish())


def encode(vocab: Vocabulary, text: str, pieces: _Pieces | None = None, window: int = WINDOW) -> list[int]:
    return list(encoded(vocab, text, pieces, window))


def decoded(vocab: Vocabulary, tokens: Iterable[int], block: int = 4096) -> Iterator[str]:
    """The text of ``tokens`` in parts, one for each block of them. Ids that the vocabulary lacks become U+FFFD."""
    dec, unknown = TextDecoder(), "\ufffd".encode()
    get = vocab.tokens.get
    for ids in batched(tokens, block):
        yield dec.feed(b"".join([get(t, unknown) for t in ids]))
    yield dec.finish()


def decode(vocab: Vocabulary, tokens: Iterable[int], block: int = 4096) -> str:
    return "".join(decoded(vocab, tokens, block))


def returns(vocab: Vocabulary, tokens: Iterable[int], text: str) -> bool:
    """Whether ``tokens`` decode to ``text``; holds one block of either."""
    at = 0
    for part in decoded(vocab, tokens):
        if not text.startswith(part, at):
            return False
        at += len(part)
    return at == len(text)


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_loaded: dict[int, tuple[Vocabulary, _Pieces]] = {}


def _on_worker(data: bytes) -> tuple[Vocabulary, _Pieces]:
    """The vocabulary of this Python worker, parsed once."""
    key = hash(data)
    if key not in _loaded:
        v = Vocabulary.parse(data)
        _loaded[key] = (v, _Pieces(v))
    return _loaded[key]


def tokenized(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", keep_cols: list[str] | None = None) -> DataFrame:
    """``keep_cols`` (by default the id), ``tokens``, ``n_tokens``, ``round_trip`` (whether decoding gives the text back).

    A null text has null tokens and counts; an empty one has none. Texts of any length are read in windows, and an empty table gives an empty result. Lone surrogates are encoded as ``?`` and fail the round
    trip. Rows keep their number and need no shuffle. Columns of the input named like the results must not be kept.
    """
    keep = keep_cols or [id_col]
    if clash := {"tokens", "n_tokens", "round_trip"} & set(keep):
        raise ValueError(f"columns are named like results: {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(_file(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, pieces = _on_worker(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in chunks(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                ids, ends, ok = array("i"), [0], []
                for t in texts.slice(a, b - a).to_pylist():
                    begin = len(ids)
                    if t is not None:
                        ids.extend(encoded(vocab, t, pieces))
                    ok.append(None if t is None else returns(vocab, memoryview(ids)[begin:], t))
                    ends.append(len(ids))
                sizes, nulls = np.diff(ends).astype(np.int32), np.array([o is None for o in ok])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)), mask=pa.array(nulls))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:-1]), lists, pa.array(sizes, mask=nulls), pa.array(ok, pa.bool_())],
                    names=[*batch.schema.names[:-1], "tokens", "n_tokens", "round_trip"],
                )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    return src.mapInArrow(run, f"{kept}, tokens array<int>, n_tokens int, round_trip boolean")
