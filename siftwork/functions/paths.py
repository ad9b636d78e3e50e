"""Column expressions over slash-separated paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "pyi": "python", "go": "go"}
WATCHED = ("rs", "ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "pyi", "go", "toml", "yaml", "yml", "json")
SKIPPED_WHEN_WATCHING = ("target", "node_modules", ".git", "dist", "build", "__pycache__")
SKIPPED_WHEN_SCANNING = ("target", "node_modules", ".git", "dist", "build")
OWN_STATE = ".siftwork"


def parts(path: Column) -> Column:
    """The components of a path, without empty ones."""
    return F.filter(F.split(path, "/"), lambda p: p != "")


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; empty without one, and for names that only begin with it."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.substring_index(name, ".", -1)).otherwise(F.lit(""))


def language(path: Column) -> Column:
    """The language of a file by its extension, null where it has none of those known."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), extension(path))


def is_watched(path: Column, extensions: Sequence[str] = WATCHED) -> Column:
    return extension(path).isin(*extensions)


def has_component(path: Column, names: Sequence[str]) -> Column:
    """Whether any component of the path is one of ``names``."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def group_key(path: Column, grouping: str = "directory") -> Column:
    """The directory of a file, or with ``parent`` the one above it; the path itself where there is none.

    A file at the root has the empty directory.
    """
    up = F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.when(path == "", None).otherwise(F.lit("")))
    if grouping == "directory":
        return F.coalesce(up, path)
    if grouping != "parent":
        raise ValueError(f"unknown grouping: {grouping}")
    above = F.when(up == "", None).when(F.contains(up, F.lit("/")), F.regexp_replace(up, r"/[^/]*$", "")).otherwise(F.lit(""))
    return F.coalesce(above, path)


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading components that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(differs > 0, differs - 1).otherwise(n)


def path_proximity(a: Column, b: Column) -> Column:
    """One over one plus the steps from ``a`` to ``b`` through their common ancestor."""
    x, y = parts(a), parts(b)
    return (F.lit(1.0) / (1 + F.size(x) + F.size(y) - 2 * common_prefix(x, y))).cast("float")


def proximity(path: Column, focus: Sequence[str]) -> Column:
    """The nearest focus path's proximity; 0 without focus paths."""
    if not focus:
        return F.lit(0.0).cast("float")
    return F.array_max(F.array(*[path_proximity(path, F.lit(f)) for f in focus]))
