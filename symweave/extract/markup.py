"""Component files, templates and forms: Svelte, Vue, Liquid, Delphi forms."""

from __future__ import annotations

import json
import re

from symweave.extract import blocks
from symweave.extract.model import Found

SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)
TAG = re.compile(r"<([A-Z]\w*)\b")
TEMPLATE_CALL = re.compile(r"\{[^{}]*?\b([A-Za-z_$][\w$]*)\s*\(")
LIQUID = re.compile(r"\{%-?\s*(render|include|section)\s+['\"]([^'\"]+)['\"]")
ASSIGN = re.compile(r"\{%-?\s*assign\s+(\w+)\s*=")
SCHEMA = re.compile(r"\{%-?\s*schema\s*-?%\}(.*?)\{%-?\s*endschema\s*-?%\}", re.S)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def component(found: Found, text: str) -> None:
    """A component node for the file, its scripts as TypeScript or JavaScript, calls and child components of its template."""
    lines = text.count("\n") + 1
    root = found.file(lines)
    name = found.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    own = found.node("component", name, 1, lines, [], root, is_exported=True)
    for m in SCRIPT.finditer(text):
        inner = Found(found.path, "typescript" if re.search(r"lang=['\"]?ts", m[1]) else "javascript")
        blocks.extract(inner, m[2])
        shift = _line(text, m.start(2)) - 1
        for row in inner.nodes[1:]:
            found.nodes.append(row | {"start_line": row["start_line"] + shift, "end_line": row["end_line"] + shift})
        for rows, into in ((inner.edges, found.edges), (inner.refs, found.refs)):
            for row in rows:
                swap = {k: own for k in ("source", "from_node_id") if row.get(k) == f"file:{found.path}"}
                into.append(row | {"line": row["line"] + shift} | swap)
    template = SCRIPT.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    template = re.sub(r"<style\b.*?</style>|<!--.*?-->", lambda m: re.sub(r"[^\n]", " ", m[0]), template, flags=re.S | re.I)
    for pattern, kind in ((TAG, "references"), (TEMPLATE_CALL, "calls")):
        for m in pattern.finditer(template):
            if m[1] not in blocks._KEYWORDS:
                found.ref(own, m[1], kind, _line(template, m.start(1)))


def liquid(found: Found, text: str) -> None:
    root = found.file(text.count("\n") + 1)
    for m in LIQUID.finditer(text):
        line = _line(text, m.start())
        folder = "sections" if m[1] == "section" else "snippets"
        found.node("import", m[2], line, line, [], root, signature=m[0])
        made = found.node("component", m[2], line, line, [], root)
        found.ref(made, f"{folder}/{m[2]}.liquid", "references", line)
    for m in ASSIGN.finditer(text):
        line = _line(text, m.start())
        found.node("variable", m[1], line, line, [], root)
    for m in SCHEMA.finditer(text):
        try:
            name = json.loads(m[1]).get("name")
        except (ValueError, AttributeError):
            name = None
        found.node("constant", str(name or "schema"), _line(text, m.start()), _line(text, m.end()), [], root, docstring=m[1].strip()[:200])


def form(found: Found, text: str) -> None:
    """Objects of a form and the handlers that its events name."""
    lines = text.split("\n")
    root = found.file(len(lines))
    held: list[tuple[str, str]] = []
    for number, raw in enumerate(lines, 1):
        line = raw.strip()
        if m := re.match(r"(?:object|inherited|inline)\s+(?:(\w+)\s*:\s*)?(\w+)", line, re.I):
            name = m[1] or m[2]
            ident = found.node("component", name, number, number, [], held[-1][1] if held else root, signature=m[2])
            found.nodes[-1]["qualified_name"] = f"{found.path}#{name}"
            held.append((name, ident))
        elif re.fullmatch(r"end", line, re.I) and held:
            _, ident = held.pop()
            next(n for n in found.nodes if n["id"] == ident)["end_line"] = number
        elif held and (m := re.match(r"(On\w+)\s*=\s*(\w+)$", line)):
            found.ref(held[-1][1], m[2], "references", number)
