"""Python sources, by the language's own parser."""

from __future__ import annotations

import ast
import warnings

from symweave.extract.model import Found

BUILT_IN_TYPES = frozenset("int str float bool bytes list dict set tuple None Any Optional Union List Dict Set Tuple object type Callable Iterable Iterator Sequence".split())


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
        return ".".join(reversed(parts))
    return parts[0] if parts and isinstance(node, ast.Call) else None


class _Walk(ast.NodeVisitor):
    def __init__(self, found: Found, root: str):
        self.found, self.scope, self.at, self.kinds = found, [], [root], ["file"]

    def _enter(self, node, kind: str, **facts) -> None:
        name = node.name
        ident = self.found.node(kind, name, node.lineno, node.end_lineno or node.lineno, self.scope, self.at[-1], docstring=ast.get_docstring(node), start_column=node.col_offset, **facts)
        for d in node.decorator_list:
            called = _dotted(d.func if isinstance(d, ast.Call) else d)
            if called:
                self.found.ref(ident, called.rsplit(".", 1)[-1], "decorates", d.lineno, d.col_offset)
            self.visit(d)
        self.scope.append(name)
        self.at.append(ident)
        self.kinds.append(kind)
        for child in node.body:
            self.visit(child)
        self.scope.pop()
        self.at.pop()
        self.kinds.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self._enter(node, "class", is_exported=not node.name.startswith("_"))
        ident = next(n["id"] for n in reversed(self.found.nodes) if n["kind"] == "class" and n["start_line"] == node.lineno and n["name"] == node.name)
        for base in node.bases:
            name = _dotted(base)
            if name:
                self.found.ref(ident, name, "extends", node.lineno, base.col_offset)

    def _function(self, node) -> None:
        args = ast.unparse(node.args)
        signature = f"({args})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        static = any(_dotted(d) in ("staticmethod", "classmethod") for d in node.decorator_list)
        self._enter(node, "method" if self.kinds[-1] == "class" else "function", signature=signature, is_async=isinstance(node, ast.AsyncFunctionDef), is_static=static, is_exported=not node.name.startswith("_"))
        ident = next(n["id"] for n in reversed(self.found.nodes) if n["start_line"] == node.lineno and n["name"] == node.name)
        for hint in [*(a.annotation for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)), node.returns]:
            for part in ast.walk(hint) if hint else ():
                if isinstance(part, ast.Name) and part.id not in BUILT_IN_TYPES:
                    self.found.ref(ident, part.id, "references", part.lineno, part.col_offset)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _assigned(self, node, targets: list[ast.AST], value: ast.AST | None) -> None:
        if self.kinds[-1] in ("file", "class"):
            for t in targets:
                if isinstance(t, ast.Name):
                    kind = "constant" if t.id.isupper() else "variable" if self.kinds[-1] == "file" else "field"
                    self.found.node(kind, t.id, node.lineno, node.end_lineno or node.lineno, self.scope, self.at[-1], signature=None if value is None else "= " + ast.unparse(value)[:100])
        if value is not None:
            self.visit(value)

    def visit_Assign(self, node: ast.Assign) -> None:
        self._assigned(node, node.targets, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assigned(node, [node.target], node.value)

    def _imported(self, node, name: str) -> None:
        self.found.node("import", name, node.lineno, node.end_lineno or node.lineno, self.scope, self.at[-1], signature=ast.unparse(node))
        self.found.ref(self.at[-1], name, "imports", node.lineno, node.col_offset)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self._imported(node, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        self._imported(node, "." * node.level + (node.module or ""))

    def visit_Call(self, node: ast.Call) -> None:
        name = _dotted(node.func)
        if name:
            head, _, rest = name.partition(".")
            self.found.ref(self.at[-1], rest if rest and head in ("self", "cls", "super") else name, "calls", node.lineno, node.col_offset)
        self.generic_visit(node)


def extract(found: Found, text: str) -> None:
    root = found.file(text.count("\n") + 1)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as why:
        found.error(str(why), "parse_error", getattr(why, "lineno", None))
        return
    _Walk(found, root).visit(tree)
