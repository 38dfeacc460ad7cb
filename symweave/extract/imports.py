"""What a file imports and passes on: (local name, exported name, source)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.extract.blanking import blank
from symweave.functions.paths import language_of

JS = ("typescript", "javascript", "tsx", "jsx")
_ES = re.compile(r"""\bimport\s+(?:type\s+)?(?P<clause>[^'";]+?)\s*\bfrom\s*['"](?P<source>[^'"]+)['"]""")
_REQUIRE = re.compile(r"""\b(?:const|let|var)\s+(?P<clause>\w+|\{[^}]+\})\s*=\s*require\(\s*['"](?P<source>[^'"]+)['"]\s*\)""")
_EXPORT = re.compile(r"""\bexport\s+(?:type\s+)?(?P<clause>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['"](?P<source>[^'"]+)['"]""")
_FROM = re.compile(r"^[ \t]*from\s+(?P<source>[\w.]+)\s+import\s+(?P<names>\([^)]*\)|[^#\n]+)", re.M)
_IMPORT = re.compile(r"^[ \t]*import\s+(?P<names>[\w., \t]+)", re.M)
_GO = re.compile(r"""(?:^|\bimport)\s*(?:(?P<alias>[\w.]+)\s+)?"(?P<source>[^"\s]+)"\s*$""", re.M)
_PHP = re.compile(r"^\s*use\s+(?P<source>[\w\\]+)(?:\s+as\s+(?P<alias>\w+))?\s*;", re.M)


def _listed(clause: str, separator: str) -> Iterator[tuple[str, str]]:
    """(local, exported) of the names between braces."""
    for part in clause.strip(" {}()\n\t").split(","):
        words = re.sub(r"^\s*type\s+", "", part.strip())
        if words:
            exported, _, local = (w.strip() for w in words.partition(separator))
            yield local or exported, exported


def mappings(text: str, language: str) -> list[tuple[str, str, str, str]]:
    """(local, exported, source, kind): kind is named, default or namespace."""
    code, out = blank(text, language), []
    if language in JS:
        for m in _ES.finditer(code):
            rest, source = m["clause"].strip(), m["source"]
            if b := re.search(r"\{([^}]*)\}", rest):
                out += [(a, e, source, "default" if e == "default" else "named") for a, e in _listed(b[1], " as ")]
                rest = rest.replace(b[0], "")
            if n := re.search(r"\*\s*as\s+(\w+)", rest):
                out.append((n[1], "*", source, "namespace"))
                rest = rest.replace(n[0], "")
            if d := re.match(r"\s*(\w+)", rest):
                out.append((d[1], "default", source, "default"))
        for m in _REQUIRE.finditer(code):
            if m["clause"].startswith("{"):
                out += [(a, e, m["source"], "named") for a, e in _listed(m["clause"], ":")]
            else:
                out.append((m["clause"], "default", m["source"], "default"))
    elif language == "python":
        for m in _FROM.finditer(code):
            out += [(a, e, m["source"], "named") for a, e in _listed(m["names"], " as ") if e != "*"]
        for m in _IMPORT.finditer(code):
            out += [(a if a != e else e.rsplit(".", 1)[-1], "*", e, "namespace") for a, e in _listed(m["names"], " as ")]
    elif language == "go":
        heads = [(m.start(), m.end()) for m in re.finditer(r"\bimport\s*\([^)]*\)|\bimport\s[^\n]*", code)]
        for m in _GO.finditer(code):
            if any(a <= m.start("source") < b for a, b in heads):
                out.append((m["alias"] or m["source"].rsplit("/", 1)[-1], "*", m["source"], "namespace"))
    elif language == "php":
        out += [(m["alias"] or m["source"].rsplit("\\", 1)[-1], m["source"].rsplit("\\", 1)[-1], m["source"], "named") for m in _PHP.finditer(code)]
    return out


def passed_on(text: str, language: str) -> list[tuple[str, str, str, str]]:
    """(exported, original, source, kind) of re-exports: kind is named or wildcard."""
    if language not in JS:
        return []
    out = []
    for m in _EXPORT.finditer(blank(text, language)):
        if m["clause"].startswith("*"):
            out.append(("*", "*", m["source"], "wildcard"))
        else:
            out += [(a, e, m["source"], "named") for a, e in _listed(m["clause"], " as ")]
    return out


def _table(sources: DataFrame, read, names: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, lang, k, *row) for p, lang, text in zip(pdf["path"], pdf["language"], pdf["content"]) for k, row in enumerate(read(text or "", lang))]
            yield pd.DataFrame(rows, columns=["path", "language", "turn", *names])

    known = sources.filter("path is not null").select("path", language_of(F.col("path"), F.col("content")).alias("language"), "content")
    return known.mapInPandas(run, "path string, language string, turn int, " + ", ".join(f"{n} string" for n in names))


def import_table(sources: DataFrame) -> DataFrame:
    """(path, language, turn, local, exported, source, kind) of sources (path, content)."""
    return _table(sources, mappings, ("local", "exported", "source", "kind"))


def export_table(sources: DataFrame) -> DataFrame:
    """(path, language, turn, exported, original, source, kind)."""
    return _table(sources, passed_on, ("exported", "original", "source", "kind"))
