"""Secrets by sliding-window Shannon entropy.

Candidate strings are cut into runs of each character class. A window slides over a run; the counts of its characters,
and with them the entropy, are updated by the one character that enters and the one that leaves.
Runs whose best window reaches the class's threshold are found unless an allow-list names them.
Runs with few digits must look unlike words as well, unless they begin as the keys of a known issuer do.
What is found is reported whole: runs that overlap are one secret, and it reaches as far as letters and digits follow
without a break, and over breaks as long as what follows is no word.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATE = re.compile(r"(?<!\w)[A-Za-z0-9+/_-]{16,}+={0,2}(?!\w)")


@dataclass(frozen=True)
class CharClass:
    """A window must hold ``digits`` digits, ``lower`` lower-case and ``upper`` upper-case letters, and ``letters`` of either.

    With ``unlike_words`` the run's letters must not follow each other as in words; such a class needs no digits.
    """

    name: str
    run: str
    window: int
    threshold: float
    digits: int = 2
    letters: int = 2
    lower: int = 0
    upper: int = 0
    unlike_words: bool = False


#: How keys of known issuers begin.
ISSUED = r"(?:AKIA|ASIA|AROA|AIza|gh[pousr]_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|npm_|pypi-|hf_|dop_v1_|SG\.)"

CLASSES = (
    CharClass("issued", rf"(?<![A-Za-z0-9]){ISSUED}[A-Za-z0-9_-]{{16,}}", 16, 2.8, digits=0, letters=0),
    CharClass("hex", r"[0-9a-f]{16,}|[0-9A-F]{16,}", 16, 2.6),
    CharClass("upper", r"[A-Z0-9]{16,}", 16, 2.9),
    CharClass("lower", r"[a-z0-9]{16,}", 16, 3.1, digits=3),
    CharClass("mixed", r"[A-Za-z0-9+/_-]{20,}", 20, 3.6, lower=2, upper=2),
    CharClass("upper", r"[A-Z0-9]{16,}", 16, 2.9, digits=0, unlike_words=True),
    CharClass("lower", r"[a-z0-9]{16,}", 16, 2.8, digits=0, unlike_words=True),
    CharClass("mixed", r"[A-Za-z0-9+/_-]{16,}", 16, 3.2, digits=0, lower=1, upper=1, unlike_words=True),
    CharClass("mixed", r"[A-Za-z0-9]{16,}", 16, 3.2, digits=0, lower=1, upper=1, unlike_words=True),
)

#: Pairs of letters that are common in words of European languages.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ro ri io ic ne me li ll ch ma co om la el be no ce ca ec us ho ot ol di ta na ns tr so ss lo ee oo wh we wi sh pe pr em il ge gh ai im ie ei un ul ut um up ac ad ag am ap av ab ay ow od op os ov po pl pa pi da do ds du ef ep ev ey ex fi fo fa fe fr ga gr go gl gi ig id ia if ir iv iz ke ki ck lu ly lt mo mi mp mb mm mu nc ni nk nn nu ny ob oc og ok rd rm rn rs rt ru ry rk rc rg rr sc sp su sk sl tt tu ts ty tl ub uc ud ue ug ui va vi vo wa wo ye ba bi bl bo br bu by cl cr ct cu cy dr qu au eu eg eb ew ff ft ph pp ps pt sm aw ak pf tz zu zt ht ua ix uo hu gs".split()
)
WORDLIKE = 0.65
#: How often a random pair of letters is a common one.
BY_CHANCE = len(PAIRS) / 26**2

#: Placeholders, identifiers that are public by nature, and runs in alphabetical order.
ALLOWED = (r"^[A-Za-z0-9+/]{30}EXAMPLEKEY$", r"(?i)example", r"(?i)x{6,}", r"(?i)(?:0123456789|abcdefghij|deadbeef)", r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")

BESIDE = 16


@dataclass(frozen=True)
class Rules:
    """Character classes in order of precedence, and the allow-list: whole strings and patterns."""

    classes: tuple[CharClass, ...] = CLASSES
    allowed: frozenset[str] = frozenset()
    patterns: tuple[str, ...] = ALLOWED
    _compiled: list = field(default_factory=list, compare=False)

    def compiled(self) -> list:
        if not self._compiled:
            self._compiled.extend([[(c, re.compile(c.run)) for c in self.classes], [re.compile(p) for p in self.patterns]])
        return self._compiled


@cache
def _clogc(most: int) -> list[float]:
    return [0.0] + [c * math.log2(c) for c in range(1, most + 1)]


def best_window(run: str, c: CharClass) -> float:
    """The highest entropy (bits a character) of the windows that hold what the class asks for; -1 where none does."""
    w = c.window
    if len(run) < w:
        return -1.0
    counts: dict[str, int] = {}
    clogc = _clogc(w + 1)
    total, best = 0.0, -1.0
    digits = lower = upper = 0
    for i, ch in enumerate(run):
        n = counts.get(ch, 0)
        counts[ch] = n + 1
        total += clogc[n + 1] - clogc[n]
        digits += "0" <= ch <= "9"
        lower += "a" <= ch <= "z"
        upper += "A" <= ch <= "Z"
        if i >= w:
            old = run[i - w]
            n = counts[old]
            counts[old] = n - 1
            total += clogc[n - 1] - clogc[n]
            digits -= "0" <= old <= "9"
            lower -= "a" <= old <= "z"
            upper -= "A" <= old <= "Z"
        if i >= w - 1 and digits >= c.digits and lower >= c.lower and upper >= c.upper and lower + upper >= c.letters:
            h = math.log2(w) - total / w
            if h > best:
                best = h
    return best


def like_words(run: str) -> bool:
    """Whether most pairs of neighbouring letters are common ones, and more than chance gives; a step from lower to upper case begins a new word."""
    pairs = [p for p in map("".join, zip(run, run[1:], strict=False)) if p.isalpha() and not (p[0].islower() and p[1].isupper())]
    n, common = len(pairs), sum(p.lower() in PAIRS for p in pairs)
    return common >= WORDLIKE * max(1, n) and common - BY_CHANCE * n >= 2.2 * math.sqrt(BY_CHANCE * (1 - BY_CHANCE) * n)


def _pieces(whole: str, allowed: list[re.Pattern]) -> Iterator[tuple[int, str]]:
    """Offset and text of what is left of a candidate without its allowed stretches.

    A stretch takes with it the rest of its word, at most ``BESIDE`` characters on either side.
    """
    at = 0
    for a, b in sorted(m.span() for p in allowed for m in p.finditer(whole)):
        first, last = max(0, a - BESIDE), min(len(whole), b + BESIDE)
        while a > first and whole[a - 1].isalnum():
            a -= 1
        while b < last and whole[b].isalnum():
            b += 1
        if a > at:
            yield at, whole[at:a]
        at = max(at, b)
    yield at, whole[at:]


def _reaches(piece: str, a: int, b: int) -> tuple[int, int]:
    """The stretch from ``a`` to ``b`` with all letters and digits that follow on either side, and the segments beyond one break that are no words."""
    while True:
        before = a, b
        while a and piece[a - 1].isalnum():
            a -= 1
        while b < len(piece) and piece[b].isalnum():
            b += 1
        for m in (_BEFORE.search(piece, 0, a), _AFTER.match(piece, b)):
            if m and not _word(m.group(1)):
                a, b = min(a, m.start()), max(b, m.end())
        if (a, b) == before:
            return a, b


_BEFORE = re.compile(r"([A-Za-z0-9]{4,})[+/_-]\Z")
_AFTER = re.compile(r"[+/_-]([A-Za-z0-9]{4,})")


def _word(segment: str) -> bool:
    """Letters of one case, a capitalised word, or a number."""
    return segment.isdigit() or (segment.isalpha() and segment[1:].islower()) or (segment.isalpha() and segment.isupper()) or like_words(segment)


def scan(text: str, rules: Rules = Rules()) -> list[tuple[int, int, str, float]]:
    """Begin, end, class and entropy of each secret in ``text``, none of which overlap.

    Runs found by several classes are one secret, as far as ``_reaches`` goes within its candidate; class and entropy are those of its longest run, of equal ones by
    the order of the classes.
    """
    classes, allowed = rules.compiled()
    out: list[tuple[int, int, str, float]] = []
    for m in CANDIDATE.finditer(text):
        whole = m.group()
        if whole in rules.allowed:
            continue
        for at, piece in _pieces(whole, allowed):
            found: list[tuple[int, int, int, float]] = []
            for n, (c, run) in enumerate(classes):
                for r in run.finditer(piece):
                    if r.group() in rules.allowed:
                        continue
                    h = best_window(r.group(), c)
                    if h >= c.threshold and not (c.unlike_words and like_words(r.group())):
                        found.append((*r.span(), n, h))
            merged: list[tuple[int, int, tuple[int, int, float]]] = []
            for x, y, n, h in sorted(found):
                a, b = _reaches(piece, x, y)
                best = (x - y, n, h)
                while merged and a < merged[-1][1]:
                    a, b, best = min(a, merged[-1][0]), max(b, merged[-1][1]), min(best, merged[-1][2])
                    merged.pop()
                merged.append((a, b, best))
            begin = m.start() + at
            out += [(begin + a, begin + b, classes[n][0].name, h) for a, b, (_, n, h) in merged if piece[a:b] not in rules.allowed]
    return out


_KIND = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("entropy", pa.float64()), ("value_sha256", pa.string())]))


def find(docs: DataFrame, rules: Rules | None = None, allowed: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``begin``, ``end`` (characters from 0), ``kind``, ``entropy``, ``value_sha256``: one row per secret.

    The secret itself is not copied to the result. Null and empty texts have none; texts of any length are scanned whole;
    repeated rows give theirs each time; other columns are ignored, and an empty table gives an empty result. Which class wins where several find one secret is told by ``scan``.
    """
    rules = rules or Rules(allowed=frozenset(allowed))
    kind = docs.schema[id_col].dataType.simpleString()
    plain = Rules(rules.classes, rules.allowed, rules.patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = scan(t, plain) if t else []
                rows.append([{"begin": a, "end": b, "kind": k, "entropy": h, "value_sha256": hashlib.sha256(t[a:b].encode()).hexdigest()} for a, b, k, h in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _KIND)], names=["id", "found"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    got = src.mapInArrow(run, f"id {kind}, found array<struct<begin:int,end:int,kind:string,entropy:double,value_sha256:string>>")
    return got.select("id", F.explode("found").alias("s")).select("id", "s.*")


def redact(text: str, rules: Rules = Rules()) -> str:
    """``text`` with each secret replaced by ``<SECRET>``."""
    parts, at = [], 0
    for a, b, _, _ in scan(text, rules):
        parts += [text[at:a], "<SECRET>"]
        at = b
    return "".join([*parts, text[at:]]) if parts else text


def redacted(docs: DataFrame, rules: Rules | None = None, allowed: Iterable[str] = (), text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with each secret replaced by ``<SECRET>``; cases as in ``find``.

    A size column, where there is one, is set to the new length. All other columns, of any name and type, stay. Null texts stay null.
    """
    rules = rules or Rules(allowed=frozenset(allowed))
    plain = Rules(rules.classes, rules.allowed, rules.patterns)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            cols[at] = pa.array([None if t is None else redact(t, plain) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    if size_col and size_col in docs.columns:
        out = out.withColumn(size_col, F.when(F.col(text_col).isNull(), F.col(size_col)).otherwise(F.length(text_col)).cast(docs.schema[size_col].dataType))
    return out
