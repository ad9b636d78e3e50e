"""Scalar functions: fixed values and ranges."""

import math

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.functions import bpe_count, paths, scores, text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def by_bytes(t: str) -> int:
    """The token estimate by one loop over bytes."""
    cost, run = 0.0, 0
    data = t.encode()
    for b in [*data, 32]:
        if b >= 0x80 or chr(b).isalnum() or b == 95:
            run += 1
            continue
        if run:
            cost += 1.0 + 0.04 * max(run - 4, 0)
            run = 0
        cost += 0.5 if b == 10 else 0 if b in (32, 9, 13) else 0.65
    return max(1, math.ceil(cost - 1e-9)) if data else 0


def test_token_estimate(spark):
    rows = ["", " ", "a", "fn main() {}\n", "naïve café", "x" * 5000, "a_b\tc\r\n\n", None, "日本語 テキスト", "\0"]
    got = values(spark, text.token_estimate(F.col("x")), rows)
    assert got == [None if r is None else by_bytes(r) for r in rows]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), min_size=20, max_size=40))
def test_token_estimate_any_text(spark, rows):
    got = values(spark, text.token_estimate(F.col("x")), rows)
    assert all(abs(a - by_bytes(r)) <= (0 if r.isascii() else 1) for a, r in zip(got, rows, strict=True))


def test_token_estimate_in_stretches(monkeypatch):
    """Rows that are worked on together or apart, slices, nulls and empty arrays give the same."""
    rows = ["ab cdefgh", "", "x" * 40, None, "\n\n", "a.b", "c", "é ü"] * 5
    want = [None if r is None else by_bytes(r) for r in rows]
    for stretch in (1, 8, 64, 1 << 22):
        monkeypatch.setattr(text, "_STRETCH", stretch)
        assert text.estimates(pa.array(rows)).to_pylist() == want
        assert text.estimates(pa.array(rows).slice(3, 11)).to_pylist() == want[3:14]
        assert text.estimates(pa.array(rows, pa.large_string())).to_pylist() == want
    assert text.estimates(pa.array([], pa.string())).to_pylist() == [] and text.estimates(pa.array([None], pa.string())).to_pylist() == [None]


def test_identifiers(spark):
    got = values(spark, text.identifiers(F.col("x")), ["let foo_bar = baz1 + 123 + ab; fn éa foo_bar", "", "if else"])
    assert got == [["foo_bar", "baz1", "éa"], [], []]


def test_utilization(spark):
    rows = [("alpha beta", "alpha gamma"), ("", "x"), ("alpha", None), (None, "alpha"), ("alpha beta", "beta alpha")]
    assert values(spark, text.utilization(F.col("a"), F.col("b")), rows, "a string, b string") == [0.5, 0.0, 0.0, 0.0, 1.0]


def test_clean_up(spark):
    assert values(spark, text.clean_signature(F.col("x")), ["pub fn  a(\n x)  { body }"]) == ["pub fn a( x)"]
    assert values(spark, text.clean_import(F.col("x")), ['"a/b"', "'c'", "d"]) == ["a/b", "c", "d"]
    assert values(spark, text.symbol_kind(F.col("x")), ["struct_item", "method_definition", "odd_method", "odd"]) == ["struct", "method", "method", "function"]


def test_signals(spark):
    got = values(spark, scores.recency(F.col("x")), [0.0, 30.0, 60.0, -5.0, 1e9], "x double")
    assert got == pytest.approx([1, 0.5, 0.25, 1, 0])
    assert values(spark, scores.size_signal(F.col("x")), [0, 500, 1500], "x bigint") == pytest.approx([1, 0.5, 0.25])
    assert values(spark, scores.dependency(F.col("x")), [0, 1, None], "x int") == [1, 0.5, 0]
    assert values(spark, scores.with_feedback(F.col("a"), F.col("b")), [(0.5, 1.5), (0.9, 2.0), (0.4, None)], "a float, b double") == pytest.approx([0.75, 1, 0.4])
    assert values(spark, scores.efficiency(F.col("a"), F.col("b")), [(0.5, 0), (0.5, 5)], "a float, b bigint") == pytest.approx([0, 0.1])


def test_composite_of_no_weights(spark):
    c = scores.composite(*[F.col("x").cast("float")] * 4, scores.Weights(0, 0, 0, 0))
    assert values(spark, c, [0.7], "x double") == [0]


def test_budget():
    b = scores.Budget(128_000)
    assert (b.l1, b.l2, b.l3) == (6400, 32000, 89600)
    assert scores.Budget(0).l3 == 0


def test_paths(spark):
    p = F.col("x")
    assert values(spark, paths.extension(p), ["a/b.rs", "a.b/c", ".hidden", "x.tar.gz"]) == ["rs", "", "", "gz"]
    assert values(spark, paths.language(p), ["a.tsx", "b.pyi", "c.md", "d.RS"]) == ["typescript", "python", None, None]
    assert values(spark, paths.group_key(p), ["src/scoring/signals.rs", "main.rs"]) == ["src/scoring", ""]
    assert values(spark, paths.group_key(p, "parent"), ["src/scoring/signals.rs", "src/a.rs", "main.rs"]) == ["src", "", "main.rs"]
    assert values(spark, paths.has_component(p, ["target"]), ["a/target/b", "a/targets/b"]) == [True, False]
    assert values(spark, paths.proximity(p, ["src/a.rs"]), ["src/a.rs", "src/b.rs", "x/y.rs"]) == pytest.approx([1, 1 / 3, 0.2])
    assert values(spark, paths.proximity(p, []), ["a"]) == [0]


def test_exact_tokens(spark):
    rows = ["Hello world", "", None, "naïve   text\n\n", "<|endoftext|>"]
    count = bpe_count.counter()
    assert values(spark, bpe_count.exact_tokens(F.col("x")), rows) == [None if r is None else count(r) for r in rows]
    assert count("Hello world") == 2
