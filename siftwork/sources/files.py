"""A corpus of files as entries: listing, filters, derived columns, reuse of the last snapshot."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import batched
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.errors import EmptyCorpusError
from siftwork.functions import paths, text
from siftwork.operators import dedup, history, scan, structure
from siftwork.session import stored
from siftwork.sources import commits, snapshot

#: Bytes of file contents that a reading task holds at once, but for one larger file.
READ_BYTES = 16 << 20
DERIVED = ("path", "mtime", "size", "token_count", "digest", "language", "simhash", "ast")


def uri(root: str | Path) -> str:
    root = str(root)
    return root.rstrip("/") if urlparse(root).scheme else "file://" + str(Path(root).resolve())


IGNORE_FILES = (".gitignore", ".ignore")
#: As many folders as the driver looks for before tasks take over.
FAN = 64
_Rules = tuple[str, list[tuple[bool, re.Pattern]]]


def _rules(root: str, at: str, names: tuple[str, ...] = IGNORE_FILES) -> list[_Rules]:
    """The rules of the ignore files in the folder ``at``, which count for what is below it."""
    lines: list[str] = []
    for name in names:
        file = Path(root, at, name)
        if file.is_file():
            lines += file.read_text(errors="replace").splitlines()
    found = [(ignore, re.compile(rx)) for ignore, rx in scan.gitignore_rules(lines)]
    return [(at, found)] if found else []


def _general(root: str) -> list[_Rules]:
    """The user's own rules, then those of the repository's exclude file; read on the driver, as tasks may run elsewhere."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return [*_rules(home, "", ("git/ignore",)), *_rules(root, "", (".git/info/exclude",))]


def _above(root: str, at: str) -> list[_Rules]:
    """The rules of the ignore files from the root to above the folder ``at``, the nearest last."""
    parts = at.split("/") if at else []
    return [x for i in range(len(parts)) for x in _rules(root, "/".join(parts[:i]))]


def _is_ignored(path: str, folder: bool, rules: list[_Rules]) -> bool:
    """By the last rule that matches; what is below an ignored folder is never asked for."""
    out = False
    for base, found in rules:
        rel = (path[len(base) + 1 :] if base else path) + ("/" if folder else "")
        for ignore, rx in found:
            if rx.search(rel):
                out = ignore
    return out


def _walk(root: str, start: str, skip: frozenset[str], deep: bool = True, general: list[_Rules] | None = None) -> Iterator[tuple[str, int, int, bool]]:
    """Relative path, time, size and kind (whether a folder) of what is in the folder ``start``, and with ``deep`` of all regular files below it; skipped and ignored folders are not entered. Without ``general`` rules nothing is ignored."""
    ignore_files = general is not None
    todo = [(start, general + _above(root, start) if ignore_files else [])]
    while todo:
        at, rules = todo.pop()
        if ignore_files:
            rules = rules + _rules(root, at)
        try:
            found = os.scandir(f"{root}/{at}" if at else root)
        except (FileNotFoundError, PermissionError):
            if not at:
                raise
            continue
        with found:
            for e in found:
                rel = f"{at}/{e.name}" if at else e.name
                if e.name in skip:
                    continue
                if e.is_dir(follow_symlinks=False):
                    if _is_ignored(rel, True, rules):
                        continue
                    if deep:
                        todo.append((rel, rules))
                    else:
                        yield rel, 0, 0, True
                elif e.is_file() and not _is_ignored(rel, False, rules):
                    try:
                        st = e.stat()
                    except FileNotFoundError:
                        continue
                    yield rel, int(st.st_mtime), st.st_size, False


def _local(spark: SparkSession, root: str, skip: frozenset[str], most: int, ignore_files: bool) -> DataFrame:
    """The driver looks for folders until there are some; tasks list what is in those and below them."""
    flat, todo = [], [""]
    general = _general(root) if ignore_files else None
    while todo and len(todo) < FAN:
        flat.append(todo.pop(0))
        todo += [p for p, _, _, folder in _walk(root, flat[-1], skip, False, general) if folder]
        if len(flat) >= FAN:
            break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = ((p, m, s) for p, m, s, folder in _walk(root, start, skip, deep, general) if not folder and s <= most)
                for some in batched(found, 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "mtime", "size"])

    tasks = spark.createDataFrame([(d, False) for d in flat] + [(d, True) for d in todo], "folder string, deep boolean")
    return tasks.repartition(len(flat) + len(todo)).mapInArrow(run, "path string, mtime bigint, size bigint")


def _remote(spark: SparkSession, base: str) -> Iterator[tuple[str, int, int]]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    cut = None
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString()
        cut = name.index(root.toUri().getPath()) + len(root.toUri().getPath()) + 1 if cut is None else cut
        yield name[cut:], f.getModificationTime() // 1000, f.getLen()


def listing(spark: SparkSession, root: str | Path, opts: scan.ScanOptions, ignore_files: bool = True) -> DataFrame:
    """``path`` (relative to the root), ``mtime`` (seconds), ``size``: files whose path is kept and whose size may pass, with those whose names begin with a dot or an underscore.

    Folders are listed by tasks, which must see the root as the driver does. Ignore files count in every folder for what is below it, after the user's
    and the repository's own; not on other file systems, whose listing comes from the driver.
    """
    base = uri(root)
    skip = frozenset([*opts.extra_ignore, paths.OWN_STATE])
    if base.startswith("file://"):
        files = _local(spark, base.removeprefix("file://"), skip, opts.max_bytes, ignore_files)
    else:
        table = pa.Table.from_pylist([{"path": p, "mtime": m, "size": s} for p, m, s in _remote(spark, base) if s <= opts.max_bytes], pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64())]))
        files = spark.createDataFrame(table)
    return files.filter(scan.kept_path(F.col("path"), opts))


def read(listed: DataFrame, root: str | Path) -> DataFrame:
    """``listed`` with ``content``, read in parallel; null where a file is gone."""
    base = uri(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(base)
        for batch in batches:
            held, size, at = [], 0, 0
            for i, name in enumerate(batch.column("path").to_pylist()):
                try:
                    with fs.open_input_stream(f"{top}/{name}") as f:
                        held.append(f.read())
                except FileNotFoundError:
                    held.append(None)
                size += len(held[-1] or b"")
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])
                    held, size, at = [], 0, i + 1
            if held:
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(held)).columns, pa.array(held, pa.binary())], names=[*batch.schema.names, "content"])

    out = T.StructType([*listed.schema.fields, T.StructField("content", T.BinaryType())])
    return listed.mapInArrow(run, out)


def derive(files: DataFrame, opts: scan.ScanOptions, with_ast: bool = True) -> DataFrame:
    """The entries of ``files`` that are text and small enough: ``DERIVED``."""
    keep = files.filter(F.col("content").isNotNull() & ~scan.is_binary(F.col("content"))).withColumn("text", F.decode("content", "UTF-8"))
    keep = keep.withColumn("token_count", text.token_estimate(F.col("text"))).filter(F.col("token_count") <= opts.max_tokens)
    lang = paths.language(F.col("path"))
    ast = structure.ast_column(F.col("text"), lang, opts.max_ast_bytes) if with_ast else F.lit(None).cast(structure.AST)
    simhash = dedup.simhash_column(F.col("text"), opts.shingle) if opts.near else F.lit(None).cast("bigint")
    return keep.select("path", "mtime", "size", "token_count", F.md5("content").alias("digest"), lang.alias("language"), simhash.alias("simhash"), ast.alias("ast"))


def discover(spark: SparkSession, root: str | Path, opts: scan.ScanOptions, as_of: Column | None = None, with_ast: bool = True, state: str | None = None, history_table: DataFrame | None = None) -> DataFrame:
    """All entries below ``root``: ``DERIVED``, ``last_modified``, ``age_days`` and ``commit_count`` where there is a history.

    With ``state``, a folder, files that the last snapshot knows by path, time and size are taken
    from it, and a new snapshot is written where anything changed. Raises EmptyCorpusError where nothing is left.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    # Several steps read the listing, and it should be the same for all of them.
    files = stored(listing(spark, root, opts), "listing")
    old = snapshot.load(spark, state, uri(root), opts) if state else None
    if old is None:
        entries = stored(derive(read(files, root), opts, with_ast or state is not None), "entries")
        changed = True
    else:
        names = files
        known = snapshot.hits(names, old)
        new = derive(read(snapshot.fresh(files, old), root), opts)
        entries = stored(snapshot.merged(known, new), "entries")
        changed = not snapshot.deleted(names, old).isEmpty() or not entries.join(old.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti").isEmpty()
    if entries.isEmpty():
        raise EmptyCorpusError(f"nothing to keep below {root}")
    if state and changed:
        snapshot.save(entries, state, uri(root), opts)
    entries = entries.withColumn("last_modified", F.timestamp_seconds("mtime"))
    log = history_table if history_table is not None else commits.log(spark, root)
    if log is None:
        return entries.withColumns({"age_days": F.lit(None).cast("double"), "commit_count": F.lit(None).cast("int")})
    h = history.commit_stats(log, as_of).select(F.col("path").alias("_p"), "age_days", "commit_count")
    return entries.join(h, F.col("path") == F.col("_p"), "left").drop("_p")


def contents(root: str | Path, chosen: DataFrame) -> DataFrame:
    """``chosen`` with ``content`` as text, read again for those rows alone; null where a file is gone."""
    got = read(chosen.select("path"), root).select(F.col("path").alias("_path"), F.decode("content", "UTF-8").alias("content"))
    return chosen.join(got, F.col("path") == F.col("_path"), "left").drop("_path")
