"""Dependency graph: edges, breadth-first distances, import resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.paths import parts
from siftwork.session import stored


def distances(edges: DataFrame, focus: DataFrame, most: int | None = None) -> DataFrame:
    """``node``, ``distance``: steps from the nearest focus node over ``edges`` (``src``, ``dst``) taken either way.

    Focus nodes are at 0 even where no edge has them. Unreachable nodes are left out. Each round is written to the shared
    folder; ``most`` bounds the distance.
    """
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = stored(both.filter("src is not null and dst is not null and src <> dst").distinct(), "edges")
    front = stored(focus.select(F.col(focus.columns[0]).alias("node")).filter("node is not null").distinct(), "front")
    seen, out, d = front, front.withColumn("distance", F.lit(0)), 0
    while (most is None or d < most) and not front.isEmpty():
        d += 1
        step = both.join(front, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, "node", "left_anti"), "front")
        seen = seen.unionAll(front)
        out = out.unionAll(front.withColumn("distance", F.lit(d)))
    return out


def _parent(p: Column, up: int = 1) -> Column:
    """A path ``up`` directories above, as an array; null above the root."""
    return F.when(F.size(p) >= up, F.slice(p, 1, F.greatest(F.size(p) - up, F.lit(0))))


def _joined(*pieces: Column) -> Column:
    return F.concat_ws("/", *pieces)


def _plain(path: Column) -> Column:
    """A path with ``.`` left out and ``..`` resolved."""
    step = lambda acc, x: (
        F.when((x == ".") | (x == ""), acc)
        .when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def candidates(imports: DataFrame, strict: bool = False) -> DataFrame:
    """``src``, ``raw_path``, ``rank``, ``candidate``: the files an import may mean, best first.

    ``imports`` has ``src``, ``language``, ``raw_path``. With ``strict``, a path that names an item within a module, ``super`` from a plain file, and ``..`` resolve only literally.
    """
    raw, dir_ = F.trim("raw_path"), _parent(parts(F.col("src")))
    mods = F.regexp_replace(F.regexp_replace(raw, r"^(crate|super|self)::", ""), r"::(\{.*|\*)$", "")
    segs = F.split(mods, "::")
    is_mod = F.element_at(parts(F.col("src")), -1).isin("mod.rs", "lib.rs", "main.rs")
    base = (
        F.when(raw.startswith("crate::"), F.array(F.lit("src")))
        .when(raw.startswith("super::"), _parent(dir_) if strict else F.when(is_mod, _parent(dir_)).otherwise(dir_))
        .when(raw.startswith("self::"), dir_)
    )
    longs = [F.array_join(segs, "/")]
    if not strict:
        longs.append(F.when(F.size(segs) > 1, F.array_join(F.slice(segs, 1, F.size(segs) - 1), "/")))
    rust = [_joined(F.array_join(base, "/"), F.concat(x, F.lit(end))) for x in longs for end in (".rs", "/mod.rs")]
    rust = [F.when(x.isNotNull() & base.isNotNull(), c) for x, c in zip([y for y in longs for _ in range(2)], rust, strict=True)]
    spec = _joined(F.array_join(dir_, "/"), raw)
    stem = F.regexp_replace(spec, r"(?<=[^/.])\.[^/.]*$", "")
    script = [F.concat(stem, F.lit(f".{e}")) for e in ("ts", "tsx", "js", "jsx")] + [F.concat(spec, F.lit(f"/index.{e}")) for e in ("ts", "tsx", "js")]
    script = [F.when(raw.startswith("."), _plain(c) if not strict else F.regexp_replace(c, r"(^|/)\./", "$1")) for c in script]
    dots = F.length(raw) - F.length(F.ltrim(raw, F.lit(".")))
    rel = F.array_join(F.split(F.ltrim(raw, F.lit(".")), r"\."), "/")
    up = F.when(F.size(dir_) >= dots - 1, F.slice(dir_, 1, F.greatest(F.size(dir_) - dots + 1, F.lit(0))))
    root = F.col("python_root") if "python_root" in imports.columns else F.array_join(dir_, "/")
    start = F.when(dots > 0, F.array_join(up, "/")).otherwise(root)
    python = [F.when((rel != "") & start.isNotNull(), _joined(start, F.concat(rel, F.lit(end)))) for end in (".py", "/__init__.py")]
    lang = F.col("language")
    by = {"rust": rust, "typescript": script, "javascript": script, "python": python}
    lists = F.coalesce(*[F.when(lang == k, F.array(*[F.ltrim(c, F.lit("/")) for c in v])) for k, v in by.items()])
    named = imports.withColumn("_c", lists).select("src", "raw_path", F.posexplode("_c").alias("rank", "candidate"))
    return named.filter("candidate is not null")


def _python_roots(files: DataFrame) -> DataFrame:
    """``dir``, ``python_root``: the nearest directory at or above one that has no ``__init__.py``."""
    has = files.filter(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("pkg")).distinct()
    dirs = files.select(F.regexp_replace(F.col("path"), r"/?[^/]*$", "").alias("dir")).distinct()
    ups = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(0), F.size(parts(F.col("dir")))), lambda n: F.array_join(F.slice(parts(F.col("dir")), 1, F.size(parts(F.col("dir"))) - n), "/"))).alias("up", "above"))
    return ups.join(has, F.col("above") == F.col("pkg"), "left_anti").groupBy("dir").agg(F.min_by("above", "up").alias("python_root"))


def resolve_imports(imports: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """``src``, ``raw_path``, ``dst``: the first candidate of each import among ``files`` (``path``); others are left out.

    A Go package stands for the least of its files.
    """
    roots = _python_roots(files).withColumnRenamed("dir", "_dir")
    with_root = imports.withColumn("_d", F.regexp_replace("src", r"/?[^/]*$", "")).join(roots, F.col("_d") == F.col("_dir"), "left").drop("_d", "_dir")
    cand = candidates(with_root, strict)
    hits = cand.join(files.select(F.col("path").alias("dst")).distinct(), F.col("candidate") == F.col("dst"))
    first = hits.groupBy("src", "raw_path").agg(F.min_by("dst", "rank").alias("dst"))
    packages = files.filter(F.col("path").rlike(r"\.go$")).groupBy(F.regexp_replace("path", r"/?[^/]*$", "").alias("pkg")).agg(F.min("path").alias("dst"))
    go = imports.filter((F.col("language") == "go") & ~F.contains(F.col("raw_path"), F.lit("."))).select("src", "raw_path").distinct()
    go = go.join(packages, F.trim("raw_path") == F.col("pkg")).select("src", "raw_path", "dst")
    return first.unionByName(go)


def build_edges(imports: DataFrame, files: DataFrame, strict: bool = False) -> DataFrame:
    """``src``, ``dst``: distinct edges between files; unresolved imports are dropped."""
    return resolve_imports(imports, files, strict).select("src", "dst").filter("src <> dst").distinct()


