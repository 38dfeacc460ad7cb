"""What an extractor returns for one file."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field


@dataclass
class Found:
    """Symbols, containment edges, references and issues of one file, as rows for the graph tables."""

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    routes: set[str] = field(default_factory=set)

    def file(self, lines: int) -> str:
        name = self.path.rsplit("/", 1)[-1]
        self.nodes.append({"id": f"file:{self.path}", "kind": "file", "name": name, "qualified_name": self.path, "start_line": 1, "end_line": lines})
        return f"file:{self.path}"

    def node(self, kind: str, name: str, line: int, end: int, scope: list[str], parent: str | None, **facts) -> str:
        ident = f"{kind}:{hashlib.sha256(f'{self.path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"
        self.nodes.append({"id": ident, "kind": kind, "name": name, "qualified_name": "::".join([*scope, name]), "start_line": line, "end_line": end} | facts)
        if parent:
            self.edges.append({"source": parent, "target": ident, "kind": "contains", "line": line})
        return ident

    def ref(self, source: str, name: str, kind: str, line: int, col: int = 0) -> None:
        self.refs.append({"from_node_id": source, "reference_name": name, "reference_kind": kind, "line": line, "col": col})

    def error(self, message: str, code: str, line: int | None = None, severity: str = "error") -> None:
        self.errors.append({"message": message, "file_path": self.path, "line": line, "column": None, "severity": severity, "code": code})
