"""Scan filters and corpus statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import paths, text


@dataclass(frozen=True)
class ScanOptions:
    """Which files a scan keeps. An empty ``include_extensions`` keeps all."""

    extra_ignore: tuple[str, ...] = paths.SKIPPED_WHEN_SCANNING
    include_extensions: tuple[str, ...] = ()
    max_bytes: int = 524_288
    max_tokens: int = 8000
    max_ast_bytes: int = 262_144
    shingle: int = 3
    near: bool = False


def kept_path(path: Column, opts: ScanOptions) -> Column:
    ok = ~paths.has_component(path, [*opts.extra_ignore, paths.OWN_STATE])
    return ok & paths.extension(path).isin(*opts.include_extensions) if opts.include_extensions else ok


def is_binary(content: Column) -> Column:
    """Whether bytes hold a NUL."""
    return F.instr(content.cast("string"), "\0") > 0


def scan_filter(df: DataFrame, opts: ScanOptions, path: str = "path", content: str = "content", size: Column | None = None) -> DataFrame:
    """Rows whose path, size, bytes and token estimate pass, with ``token_count`` and ``size_bytes``.

    Null contents are left out. The limits are inclusive.
    """
    n = F.octet_length(content) if size is None else size
    df = df.withColumn("size_bytes", n.cast("long")).filter(kept_path(F.col(path), opts) & (F.col("size_bytes") <= opts.max_bytes))
    df = df.filter(~is_binary(F.col(content)))
    return df.withColumn("token_count", text.token_estimate(F.col(content))).filter(F.col("token_count") <= opts.max_tokens)


def skip_counts(df: DataFrame, opts: ScanOptions, path: str = "path", content: str = "content") -> DataFrame:
    """``too_big``, ``binary``: how many files with a kept path each filter dropped."""
    kept = df.filter(kept_path(F.col(path), opts))
    big = F.octet_length(content) > opts.max_bytes
    return kept.agg(F.count_if(big).alias("too_big"), F.count_if(~big & is_binary(F.col(content))).alias("binary"))


def index_stats(df: DataFrame, tokens: str = "token_count") -> DataFrame:
    """``files``, ``tokens``."""
    return df.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"))


def histogram(df: DataFrame, column: str = "language", other: str = "Other") -> DataFrame:
    """``language``, ``files``, most first; nulls count as ``other``."""
    out = df.groupBy(F.coalesce(column, F.lit(other)).alias("language")).agg(F.count(F.lit(1)).alias("files"))
    return out.orderBy(F.desc("files"), "language")


def gitignore_rules(lines: Sequence[str]) -> list[tuple[bool, str]]:
    """Compile ignore-file lines to (ignore, regular expression) pairs, in order; the last that matches a path decides."""
    out = []
    for raw in lines:
        line = raw.rstrip("\n").rstrip()
        if not line or line.startswith("#"):
            continue
        ignore = not line.startswith("!")
        line = line if ignore else line[1:]
        only_dir = line.endswith("/")
        body = line.strip("/")
        anchored = "/" in line.rstrip("/")
        rx, i = "", 0
        while i < len(body):
            if body.startswith("**/", i):
                rx, i = rx + "(?:.*/)?", i + 3
            elif body.startswith("**", i):
                rx, i = rx + ".*", i + 2
            elif body[i] == "*":
                rx, i = rx + "[^/]*", i + 1
            elif body[i] == "?":
                rx, i = rx + "[^/]", i + 1
            elif body[i] == "[" and "]" in body[i + 1 :]:
                j = body.index("]", i + 1)
                rx, i = rx + "[" + body[i + 1 : j].replace("!", "^", 1) + "]", j + 1
            else:
                rx, i = rx + ("\\" + body[i] if body[i] in r".^$+{}()|\[]" else body[i]), i + 1
        out.append((ignore, ("^" if anchored else "(?:^|/)") + rx + ("/" if only_dir else "(?:/|$)")))
    return out


def ignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the rules ignore a path."""
    out = F.lit(False)
    for ignore, rx in rules:
        out = F.when(path.rlike(rx), F.lit(ignore)).otherwise(out)
    return out
