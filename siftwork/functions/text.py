"""Column expressions over text and bytes: token estimate, identifiers, digests, clean-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEYWORDS = {
    "rust": "fn let mut pub use mod struct enum impl trait where for loop while if else match return break continue self super crate true false const static type async await move ref dyn unsafe",
    "script": "function var const class interface export import from extends implements new this typeof instanceof null undefined void never",
    "python": "def class import from None True False lambda with as try except finally raise yield pass",
    "go": "func package import type struct interface map chan go defer select case default range nil",
}
#: Words of four languages that never count as identifiers.
KEYWORDS: tuple[str, ...] = tuple(sorted({w for words in _KEYWORDS.values() for w in words.split()}))


#: For each byte whether it is part of a word, a mark, or a line break.
_BYTES = np.arange(256)
_IN_WORD = np.isin(_BYTES, list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")) | (_BYTES >= 128)
_MARK = ~_IN_WORD & ~np.isin(_BYTES, list(b" \t\r\n"))
#: How many bytes of texts are worked on at a time; a longer text is worked on alone.
_STRETCH = 1 << 22


def _estimates(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The estimate of each text of ``raw``, which are one after another and end at ``ends``."""
    starts = np.concatenate(([0], ends[:-1]))
    word = np.zeros(len(raw) + 1, bool)
    word[:-1] = _IN_WORD[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[starts < ends]
    first[edges] = word[edges]
    at = np.flatnonzero(first)
    # A word ends before a byte of another class or at the end of its text.
    last = np.flatnonzero(word[:-1] & (~word[1:] | first[1:])) + 1
    row = np.searchsorted(ends, at, side="right")
    # One weight after another, in order: the sum is the same as that of a fold from left to right.
    cost = np.bincount(row, 1.0 + np.maximum(last - at - 4, 0) * 0.04, len(ends))
    marks = np.bincount(np.searchsorted(ends, np.flatnonzero(_MARK[raw]), side="right"), minlength=len(ends))
    breaks = np.bincount(np.searchsorted(ends, np.flatnonzero(raw == 10), side="right"), minlength=len(ends))
    n = np.maximum(np.ceil(cost + marks * 0.65 + breaks * 0.5), 1)
    return np.where(starts == ends, 0, n).astype(np.int64)


def estimates(texts: pa.Array) -> pa.Array:
    """``token_estimate`` of an array of strings, a stretch of rows at a time."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    out, i = np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + _STRETCH, side="right")) - 1)
        out[i:j] = _estimates(raw[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i])
        i = j
    return pa.array(out, mask=np.asarray(texts.is_null()))


def token_estimate(text: Column) -> Column:
    """Estimated tokens from byte classes; at least 1, and 0 for an empty text. Null stays null.

    A word costs 1 and 0.04 for each byte after the fourth, a line break 0.5, other
    white space nothing and any other character 0.65.
    """

    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return estimates(texts)

    return run(text.cast("string"))


def words_of(text: Column) -> Column:
    """Runs of letters, numbers and underscores of three bytes or more."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: F.octet_length(w) >= 3)


def identifiers(text: Column) -> Column:
    """Distinct words that are neither keywords nor all digits, in order of first use."""
    return F.array_distinct(F.filter(words_of(text), lambda w: ~w.isin(*KEYWORDS) & ~w.rlike("^[0-9]+$")))


def utilization(text: Column, response: Column) -> Column:
    """The share of a text's identifiers that a response names; 0 where either has none or is null."""
    ids, said = identifiers(F.coalesce(text, F.lit(""))), F.array_distinct(words_of(F.coalesce(response, F.lit(""))))
    return F.when(F.size(ids) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(ids, said)) / F.size(ids)).cast("float")


def session_id(repo: Column, nanos: Column) -> Column:
    """The first 16 hex digits of the digest of repository and time."""
    return F.substring(F.md5(F.concat(repo, F.lit(":"), nanos.cast("string"))), 1, 16)


def clean_signature(text: Column) -> Column:
    """A declaration up to its body, white space collapsed."""
    return F.trim(F.regexp_replace(F.substring_index(text, "{", 1), r"\s+", " "))


def clean_import(text: Column) -> Column:
    """An import path without the quotes around it."""
    return F.regexp_replace(F.regexp_replace(text, r'^"+|"+$', ""), r"^'+|'+$", "")


SYMBOL_KINDS = {
    "function_item": "function", "function_declaration": "function", "function_definition": "function", "struct_item": "struct", "enum_item": "enum",
    "trait_item": "trait", "interface_declaration": "interface", "class_declaration": "class", "class_definition": "class", "type_item": "type_alias",
    "type_alias_declaration": "type_alias", "type_declaration": "type_alias", "impl_item": "impl", "method_declaration": "method", "method_definition": "method",
}


def symbol_kind(node: Column) -> Column:
    """The kind of a declaration by the kind of its syntax node."""
    known = F.create_map(*[F.lit(x) for pair in SYMBOL_KINDS.items() for x in pair])
    return F.coalesce(F.element_at(known, node), F.when(F.contains(node, F.lit("method")), F.lit("method")).otherwise(F.lit("function")))
