"""The pipeline over a small repository, its snapshots, feedback and command line; the stream of changes."""

import io
import json
import os
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from siftwork import api, cli
from siftwork.config import Config
from siftwork.errors import ConfigError, EmptyCorpusError, FeedbackError, WatchError
from siftwork.functions.scores import Budget
from siftwork.plans.pack import pack
from siftwork.sources import files
from siftwork.serve import serve
from siftwork.sources.feedback_store import Store
from siftwork.streaming import watch


@pytest.fixture
def repo(tmp_path):
    r = tmp_path / "repo"
    made = {
        "src/lib.rs": "use crate::util;\npub fn library_entry(x: u8) -> u8 { x }\n",
        "src/util.rs": "pub fn helper_function() {}\n",
        "src/copy.rs": "pub fn helper_function() {}\n",
        "web/app.ts": "import { a } from './dep';\nexport function application() {}\n",
        "py/__init__.py": "import os\n",
        "web/dep.ts": "export function dependency() {}\n",
        "README.md": "# Read me\n",
        "target/out.rs": "fn ignored() {}\n",
        "skip.log": "ignored\n",
        ".gitignore": "*.log\n",
        "blob.bin": "a\0b",
        "big.txt": "word " * 9000,
    }
    for name, text in made.items():
        (r / name).parent.mkdir(parents=True, exist_ok=True)
        (r / name).write_text(text)
    return r


KEPT = {"src/lib.rs", "src/util.rs", "src/copy.rs", "web/app.ts", "web/dep.ts", "README.md", ".gitignore", "py/__init__.py"}


def names(df):
    return {r["path"] for r in df.collect()}


def test_discover(spark, repo):
    got = files.discover(spark, repo, Config().scan_options())
    assert names(got) == KEPT
    by = {r["path"]: r for r in got.collect()}
    assert by["src/lib.rs"]["language"] == "rust" and by["README.md"]["language"] is None
    assert [s["kind"] for s in by["src/lib.rs"]["ast"]["signatures"]] == ["function"]
    with pytest.raises(EmptyCorpusError):
        files.discover(spark, repo, Config(include_extensions=("nope",)).scan_options())


def test_history_of_a_repository(spark, repo):
    for cmd in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "one"]):
        subprocess.run(["git", "-C", str(repo), *cmd], check=True)
    got = {r["path"]: r for r in files.discover(spark, repo, Config().scan_options(), with_ast=False).collect()}
    assert got["src/lib.rs"]["commit_count"] == 1 and got["src/lib.rs"]["age_days"] < 1


def test_snapshot_equals_a_scan_without(spark, repo, tmp_path):
    opts, state = Config().scan_options(), f"file://{tmp_path}/state"
    files.discover(spark, repo, opts, state=state)
    (repo / "src/util.rs").write_text("pub fn changed() { let x = 1; }\n")
    os.utime(repo / "src/util.rs", (time.time() + 5,) * 2)
    (repo / "web/dep.ts").unlink()
    warm, cold = files.discover(spark, repo, opts, state=state), files.discover(spark, repo, opts)
    assert sorted(warm.select("path", "digest", "token_count").collect()) == sorted(cold.select("path", "digest", "token_count").collect())
    assert names(warm) == KEPT - {"web/dep.ts"}


def test_pack(spark, repo):
    r = pack(spark, str(repo), Budget(1000))
    assert names(r.selected) == KEPT - {"src/util.rs"}
    assert r.stats.duplicates_removed == 1
    assert r.stats.tokens_used == r.selected.agg(F.sum("token_count")).first()[0] <= 700
    assert r.text("l1").startswith("<!-- L1: File Skeleton Map (") and "(4/7 files, truncated to 50 tokens)" in r.text("l1")
    assert "library_entry" in r.text("l3") and r.text("l3").endswith("</context>\n")
    assert "### src/lib.rs" in r.text("l2") and "Files selected:" in r.text("stats")


def test_focus_and_signatures(spark, repo):
    r = pack(spark, str(repo), Budget(1000), ["web/app.ts"], signatures=True)
    by = {x["path"]: x for x in r.selected.collect()}
    assert by["web/app.ts"]["dependency"] == 1 and by["web/dep.ts"]["dependency"] == 0.5 and by["src/lib.rs"]["dependency"] == 0
    assert "Function: export function application()" in r.text("l1")


def test_feedback_loop(spark, repo):
    text = api.pack_context(spark, str(repo), 1000)
    session = text.split("session_id: ")[1].split(" ")[0]
    said = api.submit_feedback(spark, str(repo), session, "call library_entry and application")
    assert session in said
    with pytest.raises(FeedbackError):
        api.submit_feedback(spark, str(repo), "unknown", "x")
    assert "No learned weights yet" in api.learned_weights(spark, str(repo))
    assert "Learning cycle complete" in api.learned_weights(spark, str(repo), True)
    assert "avg_util" in api.learned_weights(spark, str(repo))
    assert "Sessions:         1" in api.feedback_stats(spark, str(repo))
    store = api.store_of(spark, str(repo), Config())
    n = store.records().count()
    store.compact("feedback")
    assert store.records().count() == n
    again = pack(spark, str(repo), Budget(1000), store=store)
    assert names(again.selected)
    assert not [p for p in names(again.selected) if p.startswith(".siftwork")]


def test_empty_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "none"))
    assert s.latest_weights() is None and s.stats() == {"sessions": 0, "records": 0, "avg_utilization": None}
    assert s.learn(Config().weights, 0.1, 1) is None


def test_command_line(spark, repo, capsys):
    args = cli.parser().parse_args(["index", "--repo", str(repo)])
    out = cli.run(args, spark)
    assert "Files: 8" in out and "  Rust: 3" in out and "  TypeScript: 2" in out
    args = cli.parser().parse_args(["pack", "-r", str(repo), "-b", "1000", "-o", "stats"])
    assert "Tokens used:" in cli.run(args, spark)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["pack", "-o", "l9"])


def test_server(spark, repo):
    calls = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "index_stats", "arguments": {"repo": str(repo)}}},
        {"id": 4, "method": "tools/call", "params": {"name": "submit_feedback", "arguments": {"repo": str(repo), "session_id": "no", "llm_response": "x"}}},
        {"id": 5, "method": "tools/call", "params": {"name": "nope"}},
        {"id": 6, "method": "tools/call", "params": {"name": "index_stats"}},
        {"id": 7, "method": "nope"},
    ]
    out = io.StringIO()
    serve(spark, io.StringIO("\n".join([*map(json.dumps, calls), "", "{", "[]"])), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, 7, None, None]
    assert len(got[1]["result"]["tools"]) == 4
    assert "Files: 8" in got[2]["result"]["content"][0]["text"] and not got[2]["result"]["isError"]
    assert got[3]["result"]["isError"]
    assert [g["error"]["code"] for g in got[4:]] == [-32602, -32602, -32601, -32700, -32600]


def test_server_outlives_errors(spark, repo, tmp_path):
    def call(n, name, **arguments):
        return {"jsonrpc": "2.0", "id": n, "method": "tools/call", "params": {"name": name, "arguments": arguments}}

    calls = [call(1, "index_stats", repo=str(tmp_path / "nowhere")), call(2, "pack_context", repo=str(repo), budget="many"), {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": [1]}, call(4, "pack_context", repo=str(repo), budget=0, output="l3"), {"jsonrpc": "2.0", "id": 5, "method": "ping"}]
    out = io.StringIO()
    serve(spark, io.StringIO("\n".join(map(json.dumps, calls))), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert got[1]["result"]["isError"] and got[2]["result"]["isError"] and got[3]["error"]["code"] == -32602
    assert "<file" not in got[4]["result"]["content"][0]["text"] and got[5]["result"] == {}


def test_compaction_keeps_what_is_newest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.compact("feedback")
    row = lambda n: spark.createDataFrame([("s", f"f{i}", i, 0.5, True, n / 10) for i in range(3)], "session_id string, file_path string, token_count bigint, composite_score double, was_selected boolean, utilization double")
    for n in (1, 2, 3):
        store.record(row(n))
    want = sorted(map(tuple, store.records().collect()))
    before = len(list((tmp_path / "store" / "feedback").glob("*.parquet")))
    store.compact("feedback")
    assert sorted(map(tuple, store.records().collect())) == want and {r[-1] for r in want} == {0.3}
    assert len(list((tmp_path / "store" / "feedback").glob("*.parquet"))) < before


def test_config(tmp_path):
    assert Config.load(tmp_path / "none.toml") == Config()
    (tmp_path / "siftwork.toml").write_text('max_file_tokens = 5\n[selection]\nsolver = "kkt"\n[selection.diversity]\nenabled = false\n[weights]\nrecency = 1.0\n')
    c = Config.find(tmp_path)
    assert (c.max_file_tokens, c.selection.solver, c.selection.diversity, c.weights.recency, c.weights.size) == (5, "kkt", None, 1.0, 0.15)
    for bad in ("nope = 1", "x = ", "[weights]\nzzz = 1"):
        with pytest.raises(ConfigError):
            Config.parse(bad)


def test_watch(spark, repo, tmp_path):
    table, at = f"file://{tmp_path}/index", f"file://{tmp_path}/checkpoint"
    run = lambda: watch.watch(spark, str(repo), watch.index_into(table), at, available_now=True).awaitTermination(120)
    run()
    assert names(watch.latest(spark, table)) == {"src/lib.rs", "src/util.rs", "src/copy.rs", "web/app.ts", "web/dep.ts"}
    (repo / "src/new.rs").write_text("fn fresh_file() {}\n")
    run()
    assert "src/new.rs" in names(watch.latest(spark, table))
    assert names(watch.missing(spark, str(repo), table)) == {"py/__init__.py"}
    left = spark.createDataFrame([("src/new.rs",)], "path string")
    assert names(watch.latest(spark, table, left)) == {"src/new.rs"}
    with pytest.raises(WatchError):
        watch.changes(spark, str(tmp_path / "missing"))
