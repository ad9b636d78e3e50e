"""Signatures and imports of source files, by regular expressions for each language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AST = "struct<signatures:array<struct<kind:string,text:string,line:int>>,imports:array<struct<raw_path:string,line:int>>>"
MAX_BYTES = 262_144

_VIS = r"^[ \t]*(?:pub(?:\([^)\n]*\))?[ \t]+)?"
_EXPORT = r"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_SCRIPT = (
    ("function", _EXPORT + r"(?:async[ \t]+)?function\b\*?[ \t]*\w+[^{;]*"),
    ("class", _EXPORT + r"(?:abstract[ \t]+)?class[ \t]+\w+[^{]*"),
    ("interface", _EXPORT + r"interface[ \t]+\w+[^{]*"),
    ("type_alias", _EXPORT + r"type[ \t]+\w+[^={;\n]*=[^{;]*"),
)
#: By language, (kind, pattern): the match is the declaration up to its body.
SIGNATURES = {
    "rust": (
        ("function", _VIS + r'(?:(?:default|const|async|unsafe|extern(?:[ \t]+"[^"\n]*")?)[ \t]+)*fn[ \t]+\w+[^{;]*'),
        ("struct", _VIS + r"struct[ \t]+\w+[^{;]*"),
        ("enum", _VIS + r"enum[ \t]+\w+[^{]*"),
        ("trait", _VIS + r"(?:unsafe[ \t]+)?trait[ \t]+\w+[^{]*"),
        ("type_alias", _VIS + r"type[ \t]+\w+[^;]*"),
        ("impl", r"^[ \t]*(?:unsafe[ \t]+)?impl\b[^{;]*"),
    ),
    "typescript": _SCRIPT,
    "javascript": _SCRIPT[:2],
    "python": (
        ("function", r"^[ \t]*(?:async[ \t]+)?def[ \t]+\w+[ \t]*(?:\[[^\]]*\])?\((?:[^()]|\([^()]*\))*\)[^:\n]*"),
        ("class", r"^[ \t]*class[ \t]+\w+(?:\((?:[^()]|\([^()]*\))*\))?"),
    ),
    "go": (
        ("method", r"^func[ \t]*\([^)\n]*\)[ \t]*\w+[^{\n]*"),
        ("function", r"^func[ \t]+\w+[^{\n]*"),
        ("type_alias", r"^type[ \t]+\w+[^{\n(]*"),
    ),
}
_QUOTED = r"""(?:from[ \t]*|^[ \t]*import[ \t]*)(["'][^"'\n]+["'])"""
IMPORTS = {
    "rust": (_VIS + r"use[ \t]+([^;]+);",),
    "typescript": (_QUOTED,),
    "javascript": (_QUOTED,),
    "python": (r"^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b", r"^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+\w+)?((?:[ \t]*,[ \t]*[\w.]+(?:[ \t]+as[ \t]+\w+)?)*)"),
    "go": (r'^import[ \t]+(?:[\w.]+[ \t]+)?("[^"\n]+")',),
}
_GO_BLOCK, _GO_SPEC = re.compile(r"^import[ \t]*\(([^)]*)\)", re.M), re.compile(r'"[^"\n]+"')
_HIDDEN = {
    "python": re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|\#[^\n]*'),
    "": re.compile(r'"(?:\\.|[^"\\\n])*"|//[^\n]*|/\*[\s\S]*?\*/'),
}
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in SIGNATURES.items()}
_IMPORTS = {k: [re.compile(p, re.M) for p in v] for k, v in IMPORTS.items()}


def _without_comments(source: str, language: str) -> str:
    """Comments and doc strings as blanks, so that places and lines stay."""
    blank = lambda m: m.group() if m.group()[0] == '"' and language != "python" else re.sub(r"[^\n]", " ", m.group())
    return _HIDDEN["python" if language == "python" else ""].sub(blank, source)


def _clean(text: str) -> str:
    return " ".join(text.split("{", 1)[0].split())


def _name(raw: str) -> str:
    return raw.strip().strip('"').strip("'").strip()


def analyze(source: str | None, language: str | None, max_bytes: int = MAX_BYTES) -> dict | None:
    """Signatures and imports of one file, in order of their lines.

    None for a null source, one of more than ``max_bytes``, or an unknown language.
    """
    if source is None or language not in SIGNATURES or len(source.encode("utf-8", "surrogatepass")) > max_bytes:
        return None
    code = _without_comments(source, language)
    line = lambda at: code.count("\n", 0, at) + 1
    found = []
    for kind, rx in _COMPILED[language]:
        for m in rx.finditer(code):
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            found.append((at, kind, _clean(m.group())))
    imports = []
    for rx in _IMPORTS[language]:
        for m in rx.finditer(code):
            names = [m.group(1), *(x.split(" as ")[0] for x in m.group(2).split(",")[1:])] if rx.groups > 1 else [m.group(1)]
            imports += [(m.start(1), _name(n)) for n in names]
    if language == "go":
        for block in _GO_BLOCK.finditer(code):
            imports += [(block.start(1) + m.start(), _name(m.group())) for m in _GO_SPEC.finditer(block.group(1))]
    return {
        "signatures": [{"kind": k, "text": t, "line": line(at)} for at, k, t in sorted(found)],
        "imports": [{"raw_path": p, "line": line(at)} for at, p in sorted(imports, key=lambda x: x[0]) if p],
    }


def ast_column(content: Column, language: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Signatures and imports as one struct column; files that can't be read by any language's rules have null."""

    @F.pandas_udf(AST)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, lang in parts:
            rows = [analyze(t, k, max_bytes) for t, k in zip(text, lang, strict=True)]
            empty = {"signatures": None, "imports": None}
            yield pd.DataFrame([r or empty for r in rows], columns=["signatures", "imports"])

    known = language.isin(*SIGNATURES) & content.isNotNull()
    got = run(F.when(known, content.cast("string")), F.when(known, language))
    return F.when(got["signatures"].isNotNull(), got)


def signatures(files: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """``path``, ``kind``, ``text``, ``line``: one row per declaration."""
    a = files.select(F.col(path).alias("path"), ast_column(F.col(content), F.col(language)).alias("ast"))
    return a.select("path", F.explode("ast.signatures").alias("s")).select("path", "s.*")


def imports(files: DataFrame, path: str = "path", language: str = "language", content: str = "content") -> DataFrame:
    """``src``, ``language``, ``raw_path``, ``line``: one row per import."""
    a = files.select(F.col(path).alias("src"), F.col(language).alias("language"), ast_column(F.col(content), F.col(language)).alias("ast"))
    return a.select("src", "language", F.explode("ast.imports").alias("s")).select("src", "language", "s.*")
