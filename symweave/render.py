"""Small results as text: file views, contexts, node details.  Everything here works on collected rows under a limit."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import glob_regex

MOST = 2000


def _beyond(n: int, limit: int, before: str = "") -> list[str]:
    return [f"{before}... and {n - limit} more"] if n > limit else []


def files_view(files: DataFrame, style: str = "tree", prefix: str = "", glob: str | None = None, depth: int | None = None, limit: int = MOST) -> str:
    """Tracked files as a flat list, by language, or as a tree down to a depth; a last line says how many are beyond the limit."""
    rows = files.filter(F.col("path").startswith(prefix))
    if glob:
        rows = rows.filter(F.col("path").rlike(glob_regex(glob)))
    if style == "grouped":
        found = rows.groupBy("language").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("path")), 1, limit).alias("paths")).orderBy(F.desc("n"), "language").collect()
        return "\n".join(f"{r['language']} ({r['n']})\n" + "\n".join([*(f"  {p}" for p in r["paths"]), *_beyond(r["n"], limit, "  ")]) for r in found)
    paths = [r["path"] for r in rows.select("path").orderBy("path").limit(limit).collect()]
    more = _beyond(rows.count(), limit) if len(paths) == limit else []
    if style == "flat":
        return "\n".join(paths + more)
    out: list[str] = []
    open_: list[str] = []
    for path in paths:
        parts = path.split("/")
        shared = 0
        while shared < min(len(open_), len(parts) - 1) and open_[shared] == parts[shared]:
            shared += 1
        for k in range(shared, len(parts)):
            if depth is None or k < depth:
                out.append("  " * k + parts[k] + ("/" if k < len(parts) - 1 else ""))
        open_ = parts[:-1]
    return "\n".join(out + more)


def impact_view(nodes: DataFrame, limit: int = MOST) -> str:
    """Touched symbols (id, dist, name, kind, file_path, start_line) by file, the nearest files first."""
    rows = nodes.orderBy("dist", "file_path", "start_line", "id").limit(limit).collect()
    by_file: dict[str, list] = {}
    for r in rows:
        by_file.setdefault(r["file_path"], []).append(r)
    parts = [f"{path} ({len(found)})\n" + "\n".join(f"  {r['kind']} {r['name']}:{r['start_line']} at {r['dist']}" for r in found) for path, found in by_file.items()]
    return "\n".join(parts + (_beyond(nodes.count(), limit) if len(rows) == limit else []))


def outline(node, members: DataFrame, limit: int = 100) -> str:
    """A container and its members, in order of their lines."""
    rows = members.orderBy("start_line", "id").limit(limit).collect()
    lines = [f"  {r['kind']} {r['name']}{(' ' + r['signature']) if r['signature'] else ''} ({r['start_line']}-{r['end_line']})" for r in rows]
    return "\n".join([f"{node['kind']} {node['qualified_name']} ({node['file_path']}:{node['start_line']})", *lines, *(_beyond(members.count(), limit, "  ") if len(rows) == limit else [])])


def node_details(nodes: DataFrame, limit: int = 20) -> str:
    parts = []
    for r in nodes.orderBy("file_path", "start_line").limit(limit).collect():
        lines = [f"{r['kind']} {r['qualified_name']}", f"  {r['file_path']}:{r['start_line']}-{r['end_line']}"]
        lines += [f"  {r[k]}" for k in ("signature", "docstring") if r[k]]
        parts.append("\n".join(lines))
    return "\n".join(parts)


def context(kept: DataFrame, edges: DataFrame, style: str = "markdown", blocks: DataFrame | None = None) -> str:
    """A retrieved subgraph as Markdown, JSON or a tree of its roots."""
    rows = [r.asDict() for r in kept.orderBy(F.desc("is_root"), "dist", "id").collect()]
    links = [r.asDict() for r in edges.orderBy("source", "target", "kind").collect()]
    code = [r.asDict() for r in blocks.orderBy("turn", "id").collect()] if blocks is not None else []
    if style == "json":
        return json.dumps({"nodes": rows, "edges": links, "code": code}, indent=1)
    names = {r["id"]: r["name"] for r in rows}
    if style == "tree":
        out = []
        for r in (r for r in rows if r["is_root"]):
            out.append(f"{r['kind']} {r['name']} ({r['file_path']})")
            out += [f"  {e['kind']} -> {names.get(e['target'], e['target'])}" for e in links if e["source"] == r["id"]]
        return "\n".join(out)
    out = ["## Entry points", *(f"- {r['kind']} `{r['name']}` in {r['file_path']}" for r in rows if r["is_root"]), "", "## Related", *(f"- {r['kind']} `{r['name']}` in {r['file_path']}" for r in rows if not r["is_root"])]
    out += ["", "## Relationships", *(f"- {names.get(e['source'], e['source'])} {e['kind']} {names.get(e['target'], e['target'])}" for e in links)]
    for c in code:
        out += ["", f"### {c['name']} ({c['file_path']}:{c['start_line']})", "```", c["code"] or "", "```"]
    return "\n".join(out)
