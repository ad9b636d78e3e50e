"""Duplicates, graph, structure, history, scans, rendering, feedback, snapshots."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from siftwork import session
from siftwork.functions.scores import Weights
from siftwork.operators import dedup, feedback, graph, history, ranking, render, scan, structure
from siftwork.sources import commits, files, snapshot


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_fifty_equal_rows(spark):
    df = spark.createDataFrame([(i, "same") for i in range(50)], "k int, t string")
    assert rows(dedup.exact_dedup(df, F.md5("t"), "k"), "k") == [(0,)]
    assert tuple(dedup.exact_dedup_stats(df, F.md5("t")).first()) == (50, 1, 49)


def test_near_groups_are_transitive(spark):
    p = spark.createDataFrame([(1, 0b0), (2, 0b11), (3, 0b1111), (4, None), (5, None), (6, -1)], "key int, simhash bigint")
    assert rows(dedup.near_groups(p)) == [(1, 1), (2, 1), (3, 1)]
    df = spark.createDataFrame([(i,) for i in range(1, 7)], "key int")
    assert rows(dedup.near_dedup(df, p, "key")) == [(1,), (4,), (5,), (6,)]
    assert rows(dedup.near_groups(p.filter("key > 3"))) == []


@pytest.mark.parametrize("threshold", [0, 3, 6])
def test_pairs_against_all(spark, threshold):
    r = random.Random(threshold)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 7))) for b in base for _ in range(8)]
    bands = lambda x: [x >> 16 * i & 0xFFFF for i in range(4)]
    want = {(i, j, (prints[i] ^ prints[j]).bit_count()) for j in range(len(prints)) for i in range(j) if (prints[i] ^ prints[j]).bit_count() <= threshold and any(x == y for x, y in zip(bands(prints[i]), bands(prints[j]), strict=True))}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "key int, simhash bigint")
    assert set(rows(dedup.near_pairs(df, threshold))) == want


def test_pairs_are_not_broadcast(spark):
    """Spark's estimate leaves out that each fingerprint is exploded by all masks."""
    p = session.stored(spark.range(1000).select(F.col("id").alias("key"), F.xxhash64(F.floor(F.col("id") / 2)).bitwiseXOR(F.col("id") % 2).alias("simhash")), "prints")
    pairs = dedup.near_pairs(p)
    assert rows(pairs) == [(i, i + 1, 1) for i in range(0, 1000, 2)]
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_fingerprints(spark):
    assert dedup.fingerprint("") == dedup.fingerprint(" \n") == 0
    assert dedup.fingerprint("a b c d") == dedup.fingerprint("a  b\nc d") != dedup.fingerprint("a b c e")
    df = spark.createDataFrame([(1, "a b c d"), (2, None)], "k int, t string")
    assert rows(df.select("k", dedup.simhash_column(F.col("t")))) == rows(dedup.simhash(df, "k", "t"))


def test_bands(spark):
    df = spark.createDataFrame([(0x1111222233334444,)], "fp bigint")
    assert df.select(dedup.lsh_bands(F.col("fp"))).first()[0] == [0x4444, 0x3333, 0x2222, 0x1111]
    assert df.select(dedup.lsh_bands(F.col("fp"), 0)).first()[0] == []
    assert df.select(dedup.lsh_bands(F.col("fp"), 2)).first()[0] == [0x4444, 0x2222]


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a int, b int")
    assert {x[1] for x in rows(dedup.components(links))} == {0}


def test_distances(spark):
    e = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y"), ("a", "a"), (None, "a")], "src string, dst string")
    f = spark.createDataFrame([("a",), ("lost",)], "n string")
    assert rows(graph.distances(e, f)) == [("a", 0), ("b", 1), ("c", 2), ("lost", 0)]
    assert rows(graph.distances(e, f, 1)) == [("a", 0), ("b", 1), ("lost", 0)]
    assert rows(graph.distances(e, f.limit(0))) == []


FILES = ["src/lib.rs", "src/a.rs", "src/a/b.rs", "src/c/mod.rs", "web/app.ts", "web/util.ts", "web/ui/index.ts", "py/pkg/__init__.py", "py/pkg/x.py", "py/pkg/sub/__init__.py", "py/pkg/sub/y.py", "src/go/z.go", "src/go/a.go"]


@pytest.mark.parametrize(
    ("src", "language", "raw", "dst"),
    [
        ("src/lib.rs", "rust", "crate::a::b", "src/a/b.rs"),
        ("src/lib.rs", "rust", "crate::c", "src/c/mod.rs"),
        ("src/lib.rs", "rust", "crate::a::Type", "src/a.rs"),
        ("src/lib.rs", "rust", "std::fmt", None),
        ("web/app.ts", "typescript", "./util", "web/util.ts"),
        ("web/app.ts", "typescript", "./ui", "web/ui/index.ts"),
        ("web/ui/index.ts", "typescript", "../util", "web/util.ts"),
        ("web/app.ts", "typescript", "react", None),
        ("py/pkg/sub/y.py", "python", "..x", "py/pkg/x.py"),
        ("py/pkg/x.py", "python", ".sub", "py/pkg/sub/__init__.py"),
        ("py/pkg/sub/y.py", "python", "pkg.x", "py/pkg/x.py"),
        ("src/main.go", "go", "src/go", "src/go/a.go"),
        ("src/main.go", "go", "example.com/go", None),
    ],
)
def test_resolution(spark, src, language, raw, dst):
    im = spark.createDataFrame([(src, language, raw)], "src string, language string, raw_path string")
    got = rows(graph.resolve_imports(im, spark.createDataFrame([(f,) for f in FILES], "path string")), "dst")
    assert got == ([(dst,)] if dst else [])


def test_structure_of_rust():
    src = '// fn hidden()\nuse crate::a::{b, c};\npub struct A<T> {\n x: T }\nimpl A {\n    pub async fn go(\n        &self,\n    ) -> u8 {\n 1 }\n}\nenum E { X }\ntrait T {}\ntype B = u8;\nconst S: &str = "https://x";\n'
    got = structure.analyze(src, "rust")
    assert [(s["kind"], s["text"], s["line"]) for s in got["signatures"]] == [("struct", "pub struct A<T>", 3), ("impl", "impl A", 5), ("function", "pub async fn go( &self, ) -> u8", 6), ("enum", "enum E", 11), ("trait", "trait T", 12), ("type_alias", "type B = u8", 13)]
    assert got["imports"] == [{"raw_path": "crate::a::{b, c}", "line": 2}]


def test_structure_of_others():
    py = structure.analyze('"""def no()"""\nimport os, a.b as c\nfrom ..m import z\n\nclass A(B):\n    def f(self, x=(1, 2)) -> int:\n        return 1\n', "python")
    assert [(s["kind"], s["text"]) for s in py["signatures"]] == [("class", "class A(B)"), ("function", "def f(self, x=(1, 2)) -> int")]
    assert [i["raw_path"] for i in py["imports"]] == ["os", "a.b", "..m"]
    ts = structure.analyze("import { a } from './a';\nimport 'b';\nexport class A extends B {\n}\nexport interface I {}\ntype T = string;\nexport async function f(x: number): void {\n}\n", "typescript")
    assert [s["kind"] for s in ts["signatures"]] == ["class", "interface", "type_alias", "function"]
    assert [i["raw_path"] for i in ts["imports"]] == ["./a", "b"]
    go = structure.analyze('package p\nimport (\n\t"fmt"\n\tx "a/b"\n)\nfunc (s *S) M(x int) error {\n}\nfunc F() {}\ntype S struct {\n}\n', "go")
    assert [(s["kind"], s["text"]) for s in go["signatures"]] == [("method", "func (s *S) M(x int) error"), ("function", "func F()"), ("type_alias", "type S struct")]
    assert [i["raw_path"] for i in go["imports"]] == ["fmt", "a/b"]


def test_structure_of_nothing(spark):
    assert structure.analyze(None, "rust") is None
    assert structure.analyze("x", "cobol") is None
    assert structure.analyze("x" * 10, "rust", 5) is None
    assert structure.analyze("", "go") == {"signatures": [], "imports": []}
    df = spark.createDataFrame([("a", None, "x"), ("b", "rust", None), ("c", "rust", "fn a() {}")], "path string, language string, content string")
    assert rows(structure.signatures(df)) == [("c", "function", "fn a()", 1)]


def test_commit_caps(spark):
    ts = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    log = [(f"c{i:04}", ts(i), "hot", "M") for i in range(600)] + [("c0000", ts(0), "old", "A"), ("c0599", ts(599), "gone", "D"), ("c0598", ts(598), "new", "A")]
    df = spark.createDataFrame(log, "commit_id string, ts timestamp, path string, status string")
    got = rows(history.commit_stats(df, F.lit(ts(599)).cast("timestamp")), "path", "commit_count", "age_days")
    assert got == [("hot", 100, 0.0), ("new", 1, pytest.approx(1 / 24))]


def test_log_parsing():
    raw = "\0abc\x01100\n\nM\ta b.rs\nA\tc.rs\n\0def\x0150\n"
    assert commits.parse(raw) == [("abc", 100, "a b.rs", "M"), ("abc", 100, "c.rs", "A")]


def test_ignore_files(spark):
    rules = scan.gitignore_rules(["# note", "*.log", "/top", "dir/", "!keep.log", "a/**/z", "q?.txt"])
    names = ["x.log", "s/x.log", "keep.log", "top", "s/top", "dir/f", "s/dir/f", "dirx", "a/z", "a/b/c/z", "q1.txt", "q12.txt"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in df.filter(scan.ignored(F.col("p"), rules)).collect()] == ["x.log", "s/x.log", "top", "dir/f", "s/dir/f", "a/z", "a/b/c/z", "q1.txt"]


def test_scan_filter_edges(spark):
    df = spark.createDataFrame([("a.rs", "x"), ("b.rs", "\0x"), ("c.rs", None), ("d/target/e.rs", "x"), ("f.rs", "y" * 50), ("g.rs", "")], "path string, content string")
    opts = scan.ScanOptions(max_bytes=20)
    assert rows(scan.scan_filter(df, opts), "path", "token_count") == [("a.rs", 1), ("g.rs", 0)]
    assert tuple(scan.skip_counts(df, opts).first()) == (1, 1)
    assert tuple(scan.index_stats(df.limit(0).withColumn("token_count", F.lit(1))).first()) == (0, 0)


def scored(spark, n):
    return spark.createDataFrame([(f"f{i:02}.rs", 10, 1.0 - i / 100) for i in range(n)], "path string, token_count int, composite_score float")


def test_l1_prefix(spark):
    assert render.l1_prefix(scored(spark, 20), 60).count() == 5
    assert render.l1_prefix(scored(spark, 20), 0).count() == 1
    assert render.l1_prefix(scored(spark, 0), 60).count() == 0
    line = render.l1_lines(render.l1_prefix(scored(spark, 1), 60)).first()["text"]
    assert line == "f00.rs  [10 tokens, score=1.000]"


def test_l3_ends_with_a_break(spark):
    df = scored(spark, 2).withColumn("pick_order", F.row_number().over(render_window())).withColumn("content", F.when(F.col("path") == "f00.rs", F.lit("a")))
    assert [r["text"] for r in render.l3_files(df).orderBy("pick_order").collect()] == ['<file path="f00.rs" tokens="10" score="1.000">\na\n</file>', '<file path="f01.rs" tokens="10" score="0.990">\n\n</file>']


def render_window():
    from pyspark.sql import Window

    return Window.orderBy("path")


RECORD = "session_id string, file_path string, token_count bigint, composite_score double, was_selected boolean, utilization double"


def seed(spark, n=3):
    return spark.createDataFrame([r for i in range(n) for r in ((f"s{i}", "recent.rs", 100, 0.9, True, 0.8), (f"s{i}", "old.rs", 2000, 0.3, True, 0.1))], RECORD)


def test_learning(spark):
    w = feedback.updated_weights(seed(spark)).first()
    assert w["recency"] + w["size"] + w["proximity"] + w["dependency"] == pytest.approx(1)
    assert w["size"] > 0.15
    same = feedback.updated_weights(seed(spark), Weights(0.8, 0.3, 0.4, 0.5), 0.0).first()
    assert same["recency"] == pytest.approx(0.4)
    none = feedback.updated_weights(seed(spark, 0)).first()
    assert (none["recency"], none["records"]) == (0.4, 0)
    low = feedback.updated_weights(seed(spark).filter("utilization < 0.5")).first()
    assert low["size"] == 0.15


def test_upsert_and_multipliers(spark):
    new = spark.createDataFrame([("s0", "old.rs", 1, 0.1, False, None), ("s9", "x", 1, 0.1, True, 1.0)], RECORD)
    both = feedback.upsert(seed(spark, 1), new)
    assert rows(both, "session_id", "file_path", "token_count") == [("s0", "old.rs", 1), ("s0", "recent.rs", 100), ("s9", "x", 1)]
    assert rows(feedback.multipliers(both)) == [("recent.rs", 1.3), ("x", 1.5)]


def test_snapshot(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 10, "x"), ("b", 1, 10, "y"), ("gone", 1, 1, "z")], "path string, mtime bigint, size bigint, digest string")
    now = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 5)], "path string, mtime bigint, size bigint")
    assert rows(snapshot.hits(now, old), "path", "digest") == [("a", "x")]
    assert rows(snapshot.fresh(now, old), "path") == [("b",), ("c",)]
    assert rows(snapshot.deleted(now, old), "path") == [("gone",)]
    at, opts = f"file://{tmp_path}/state", scan.ScanOptions()
    assert snapshot.load(spark, at, "r", opts) is None
    snapshot.save(old, at, "r", opts)
    snapshot.save(old.filter("path = 'a'"), at, "r", opts)
    assert rows(snapshot.load(spark, at, "r", opts), "path") == [("a",)]
    assert snapshot.load(spark, at, "other", opts) is None
    assert snapshot.load(spark, at, "r", scan.ScanOptions(max_bytes=1)) is None


def test_equal_scores_are_ranked_by_many_tasks(spark):
    df = spark.range(40_000).select(F.col("id"), F.lit(0.0).alias("score"), F.lit(2).alias("w"))
    # Ranges as small as these would be put together.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranking.ranked(df, F.col("score"), ["id"], F.col("w"), cum="c")
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) < 30_000
    assert got.filter("rank <> id + 1 or c <> 2 * (id + 1)").count() == 0


def test_members_count_links_of_copies(spark):
    rows = [(1, 0b0), (2, 0b0), (3, 0b111), (4, 0b111), (5, 0b1111), (6, -1), (7, None)]
    df = spark.createDataFrame(rows, "key bigint, simhash bigint")
    pairs = dedup.near_pairs(df)
    n = {r["key"]: r["n"] for r in pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {r["key"]: (r["lead"], r["n_links"]) for r in dedup.members(df).collect()}
    assert got == {1: (1, n[1]), 2: (1, n[2]), 3: (3, n[3]), 4: (3, n[4]), 5: (5, n[5]), 6: (6, 0)}


def test_ignore_files_in_every_folder(spark, tmp_path, monkeypatch):
    """Nested rules, re-inclusion, the repository's exclude file and the user's own; many folders, listed by tasks."""
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "home"))
    root = tmp_path / "repo"
    texts = {
        "home/git/ignore": "*.swp\n", "repo/.git/info/exclude": "secret.txt\n", "repo/.gitignore": "*.log\n/only_top\nout/\n", "repo/a/.gitignore": "!keep.log\nlocal.txt\n/b/deep.txt\n", "repo/a/b/.ignore": "*.tmp\n",
        "repo/x.log": "", "repo/x.swp": "", "repo/x.txt": "", "repo/secret.txt": "", "repo/only_top": "", "repo/a/only_top": "", "repo/out/f.txt": "", "repo/a/out/f.txt": "", "repo/a/keep.log": "", "repo/a/other.log": "", "repo/a/local.txt": "", "repo/local.txt": "",
        "repo/a/b/deep.txt": "", "repo/a/b/c/deep.txt": "", "repo/a/b/c/z.tmp": "", "repo/z.tmp": "", "repo/a/b/c/keep.log": "",
    }
    for i in range(90):
        texts[f"repo/many/d{i}/e/f{i}.txt"] = "x"
    for name, body in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r["path"] for r in files.listing(spark, root, scan.ScanOptions(extra_ignore=(".git",))).collect()}
    many = {f"many/d{i}/e/f{i}.txt" for i in range(90)}
    assert many <= got
    assert got - many == {".gitignore", "a/.gitignore", "a/b/.ignore", "x.txt", "a/only_top", "a/keep.log", "local.txt", "a/b/c/deep.txt", "a/b/c/keep.log", "z.tmp"}
    with_all = {r["path"] for r in files.listing(spark, root, scan.ScanOptions(extra_ignore=()), ignore_files=False).collect()}
    assert len(with_all) == len(texts) - 1
    with pytest.raises(FileNotFoundError):
        files.listing(spark, tmp_path / "nowhere", scan.ScanOptions())


def test_stored_tables_are_deleted(spark, tmp_path):
    def tables():
        return {p for p in session._made if os.path.exists(p.removeprefix("file://"))}

    df = session.stored(spark.range(5), "numbers")
    assert df.count() == 5 and df._stored_at in tables()
    session.forget(df)
    assert df._stored_at not in session._made and not os.path.exists(df._stored_at.removeprefix("file://"))
    before = tables()
    links = spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint")
    assert {r["label"] for r in dedup.components(links).collect()} == {0}
    # Of all rounds the last one is left.
    assert len(tables() - before) == 1
    assert session.release(spark) >= 1 and not session._made
