"""Routes that web frameworks declare: one route node each, with a reference to its handler."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from symweave.extract.blanking import blank
from symweave.extract.model import Found

VERBS = r"get|post|put|patch|delete|head|options|all"
STRING = r"""['"`](?P<path>[^'"`]*)['"`]"""
REF = r"(?P<handler>[\w$.:]+)"


@dataclass(frozen=True)
class Plugin:
    """languages it reads, a pattern with groups path, handler and method or verb, and what the file must hold."""

    name: str
    languages: tuple[str, ...]
    pattern: str
    holds: str = ""
    method: str = ""


JS = ("typescript", "javascript", "tsx", "jsx")
PLUGINS: list[Plugin] = [
    Plugin("express", JS, rf"\b(?:app|router|server|api)\.(?P<method>{VERBS}|use)\(\s*{STRING}\s*,(?:[^()\n]*,)?\s*{REF}"),
    Plugin("nestjs", JS, rf"@(?P<method>Get|Post|Put|Patch|Delete|Head|Options|All)\(\s*(?:{STRING})?\s*\)(?:\s*@[^\n]+)*\s*(?:public\s+|private\s+)?(?:async\s+)?(?P<handler>\w+)\s*\("),
    Plugin("nestjs-message", JS, rf"@(?P<method>Query|Mutation|Subscription|MessagePattern|EventPattern|SubscribeMessage)\(\s*(?:{STRING})?[^)]*\)(?:\s*@[^\n]+)*\s*(?:async\s+)?(?P<handler>\w+)\s*\("),
    Plugin("react", JS, rf"<Route\b[^>]*?\bpath=(?:\{{\s*)?{STRING}(?:\s*\}})?[^>]*?(?:element=\{{\s*<|component=\{{\s*)(?P<handler>\w+)", method="PAGE"),
    Plugin("flask", ("python",), rf"@\w+\.route\(\s*{STRING}(?P<rest>[^)]*)\)(?:\s*@[^\n]+)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"),
    Plugin("fastapi", ("python",), rf"@\w+\.(?P<method>{VERBS})\(\s*{STRING}[^)]*\)(?:\s*@[^\n]+)*\s*(?:async\s+)?def\s+(?P<handler>\w+)"),
    Plugin("django", ("python",), rf"\b(?:re_)?(?:path|url)\(\s*r?{STRING}\s*,\s*(?P<handler>[\w.]+)", method="ROUTE", holds="urlpatterns|django|path("),
    Plugin("rails", ("ruby",), r"""^\s*(?P<method>get|post|put|patch|delete)\s+['"](?P<path>[^'"]+)['"](?:\s*,\s*to:|\s*=>)\s*['"](?P<handler>[\w/#]+)['"]"""),
    Plugin("spring", ("java", "kotlin"), r"""@(?P<method>Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:(?:value|path)\s*=\s*)?"(?P<path>[^"]*)"[^)]*\)(?:\s*@[^\n]+)*\s*(?:public|private|protected|fun|suspend|\s)*(?:[\w<>?,. ]+\s+)?(?P<handler>\w+)\s*\("""),
    Plugin("go", ("go",), r"""\.(?P<method>GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc|Handle)\(\s*"(?P<path>[^"]*)"\s*,\s*(?P<handler>[\w.]+)"""),
    Plugin("rust-attribute", ("rust",), r"""#\[(?P<method>get|post|put|patch|delete|head|options)\(\s*"(?P<path>[^"]*)"[^)]*\)\](?:\s*#\[[^\n]+)*\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"""),
    Plugin("axum", ("rust",), r"""\.route\(\s*"(?P<path>[^"]*)"\s*,\s*(?P<method>get|post|put|patch|delete)\(\s*(?P<handler>[\w:]+)"""),
    Plugin("aspnet-attribute", ("csharp",), r"""\[Http(?P<method>Get|Post|Put|Patch|Delete)\(\s*"(?P<path>[^"]*)"[^)]*\)\](?:\s*\[[^\n]+)*\s*(?:public|private|protected|internal|static|async|virtual|\s)*[\w<>?,. ]+\s+(?P<handler>\w+)\s*\("""),
    Plugin("aspnet-minimal", ("csharp",), r"""\.Map(?P<method>Get|Post|Put|Patch|Delete)\(\s*"(?P<path>[^"]*)"\s*,\s*(?P<handler>[\w.]+)"""),
    Plugin("laravel", ("php",), r"""Route::(?P<method>get|post|put|patch|delete|any)\(\s*['"](?P<path>[^'"]*)['"]\s*,\s*(?:\[\s*[\w\\]+::class\s*,\s*['"](?P<handler>\w+)['"]\s*\]|['"][\w\\]+@(?P<handler2>\w+)['"]|(?P<handler3>\w+)::class)"""),
    Plugin("laravel-resource", ("php",), r"""Route::(?P<method>resource|apiResource)\(\s*['"](?P<path>[^'"]*)['"]\s*,\s*(?P<handler>\w+)::class"""),
    Plugin("vapor", ("swift",), r"""\b(?:app|routes|\w+)\.(?P<method>get|post|put|patch|delete)\(\s*"(?P<path>[^"]*)"(?:\s*,\s*"[^"]*")*\s*,\s*use:\s*(?P<handler>[\w.]+)"""),
    Plugin("swiftui", ("swift",), r"\bNavigationLink\(\s*destination:\s*(?P<handler>\w+)\(", method="VIEW"),
]
PAGES = (
    ("sveltekit", re.compile(r"(?:^|/)src/routes(?P<path>(?:/[^/]+)*)/\+(?:page|server|layout)(?:\.server)?\.\w+$")),
    ("nuxt", re.compile(r"(?:^|/)pages(?P<path>(?:/[^/]+)*?)(?:/index)?\.vue$")),
    ("nuxt-api", re.compile(r"(?:^|/)server(?P<path>/api(?:/[^/]+)*?)\.(?:ts|js)$")),
    ("next", re.compile(r"(?:^|/)(?:pages|app)(?P<path>(?:/[^/]+)*?)(?:/index|/page)?\.(?:tsx|jsx)$")),
)
_compiled: dict[str, re.Pattern] = {}


def register(plugin: Plugin) -> None:
    """Replaces the plugin of that name, or adds it."""
    for k, p in enumerate(PLUGINS):
        if p.name == plugin.name:
            PLUGINS[k] = plugin
            break
    else:
        PLUGINS.append(plugin)
    _compiled.pop(plugin.name, None)


def _add(found: Found, framework: str, method: str, path: str, line: int, handler: str | None, kind: str = "references") -> None:
    ident = f"route:{found.path}:{line}:{method}:{path}"
    if ident in found.routes:
        return
    found.routes.add(ident)
    found.nodes.append({"id": ident, "kind": "route", "name": f"{method} {path}".strip(), "qualified_name": f"{found.path}::{method}:{path}", "start_line": line, "end_line": line, "signature": framework})
    if handler:
        found.ref(ident, handler, kind, line)


def extract(found: Found, text: str) -> None:
    code = blank(text, found.language)
    ends = [m.start() for m in re.finditer("\n", code)]
    prefix = ""
    if found.language in JS and (m := re.search(r"@Controller\(\s*['\"]([^'\"]*)", code)):
        prefix = "/" + m[1].strip("/")
    if found.language in ("java", "kotlin") and (m := re.search(r'@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?"([^"]*)"[^)]*\)\s*(?:@[^\n]+\s*)*(?:public\s+)?(?:open\s+)?class\b', code)):
        prefix = "/" + m[1].strip("/")
    for p in PLUGINS:
        if found.language not in p.languages or p.holds and not any(h in code for h in p.holds.split("|")):
            continue
        if p.name not in _compiled:
            _compiled[p.name] = re.compile(p.pattern, re.M)
        for m in _compiled[p.name].finditer(code):
            groups = m.groupdict()
            handler = next((groups[g] for g in ("handler", "handler2", "handler3") if groups.get(g)), None)
            method = (groups.get("method") or p.method or "ANY").upper()
            if p.name == "flask":
                listed = re.search(r"methods\s*=\s*\[([^\]]*)\]", groups["rest"] or "")
                methods = re.findall(r"['\"](\w+)['\"]", listed[1]) if listed else ["GET"]
            else:
                methods = [{"REQUEST": "ANY", "HANDLEFUNC": "ANY", "HANDLE": "ANY"}.get(method, method)]
            path = groups.get("path") or ""
            if prefix and p.name in ("nestjs", "spring"):
                path = prefix + ("/" + path.strip("/") if path.strip("/") else "")
            if p.name == "rails" and handler:
                handler = handler.rpartition("#")[2] or handler
            if p.name == "django" and handler:
                handler = re.sub(r"\.as_view$", "", handler).rpartition(".")[2]
            for verb in methods:
                _add(found, p.name, verb, path, bisect.bisect_left(ends, m.start()) + 1, handler and re.split(r"\.|::", handler)[-1], "imports" if p.name == "laravel-resource" else "references")
    for name, pattern in PAGES:
        if m := pattern.search(found.path):
            path = re.sub(r"\[(?:\.\.\.)?(\w+)\]", r":\1", m["path"]) or "/"
            _add(found, name, "API" if "api" in name else "PAGE", path, 1, None)
            break
