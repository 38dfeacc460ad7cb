"""Languages with blocks in braces (or ended by a word), by tables of declarations over text without comments and strings."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

from symweave.extract.blanking import blank, comment_before
from symweave.extract import members
from symweave.extract.model import Found

NAME = r"[A-Za-z_$][\w$]*"


@dataclass
class Table:
    """declarations: (kind, pattern with a group name).  scopes: kinds whose functions are methods."""

    declarations: list[tuple[str, str]]
    imports: list[str]
    extends: str | None = None
    implements: str | None = None
    exported: str | None = None
    visibility: str | None = None
    default_visibility: str | None = None
    decorator: str | None = None
    receiver: str | None = None
    words: bool = False
    scopes: tuple[str, ...] = ("class", "struct", "interface", "trait", "enum")
    keywords: frozenset[str] = field(default_factory=frozenset)


#: Words before a parenthesis that declare nothing, and further ones that call nothing.
_CONTROL = frozenset("if for while switch catch return function new typeof await else do try throw sizeof foreach elseif unless until when with using lock yield".split())
_KEYWORDS = _CONTROL | frozenset(
    "async if for while switch catch return function new typeof await else do try throw sizeof loop fn func def when with in is as case super this self elseif elsif foreach unless until and or not using lock yield import export default void var let const public private protected static class struct interface enum trait impl extends implements where ".split()
)
_MORE_KEYWORDS = {"go": frozenset("go defer chan map range make panic select".split()), "php": frozenset("echo print".split()), "rust": frozenset(["match"]), "scala": frozenset(["match"])}
_ARROW = rf"\b(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{NAME})\s*(?::[^=;{{}}\n]+)?=>"
_JS = Table(
    [
        ("class", rf"\b(?:abstract\s+)?class\s+(?P<name>{NAME})"), ("interface", rf"\binterface\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"),
        ("type_alias", rf"\btype\s+(?P<name>{NAME})(?:<[^=]*>)?\s*="), ("function", rf"\bfunction\s*\*?\s*(?P<name>{NAME})\s*(?:<[^(]*>)?\("), ("function", _ARROW),
        ("member", rf"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?(?P<name>#?{NAME})\s*(?:<[^(\n]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?\{{)"),
        ("constant", rf"^(?:export\s+)?const\s+(?P<name>{NAME})\s*(?::[^=\n]+)?="), ("variable", rf"^(?:export\s+)?(?:let|var)\s+(?P<name>{NAME})\s*(?::[^=\n]+)?="),
    ],
    [r"""^\s*import\s+(?:type\s+)?(?:[^'";]*?\sfrom\s+)?['"](?P<name>[^'"]+)['"]""", r"""\brequire\(\s*['"](?P<name>[^'"]+)['"]\s*\)""", r"""^\s*export\s+[^'";=]*?\sfrom\s+['"](?P<name>[^'"]+)['"]"""],
    extends=r"\bextends\s+([\w$.]+(?:<[^{]*?>)?(?:\s*,\s*[\w$.]+)*)", implements=r"\bimplements\s+([\w$.<>, ]+)", exported=r"\bexport\b", visibility=r"\b(public|private|protected)\b", decorator=rf"@(?P<name>{NAME})",
)
_MODIFIED = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|partial|synchronized|native|readonly|open|data|inline|suspend|tailrec|operator|infix|external|const|lateinit|fileprivate|mutating|required|convenience|unsafe|extern|new)\s+)*"
_TYPE = r"[\w$.]+(?:<[^;{}()]*?>)?(?:\[\])*\??"
TABLES: dict[str, Table] = {
    "typescript": _JS, "javascript": _JS, "tsx": _JS, "jsx": _JS,
    "java": Table(
        [("class", rf"\b(?:class|record)\s+(?P<name>{NAME})"), ("interface", rf"(?<!@)\binterface\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"),
         ("member", rf"^[ \t]*{_MODIFIED}(?:<[^(\n]*>\s+)?(?:{_TYPE}\s+)?(?P<name>{NAME})\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w., ]+)?\s*[{{;])")],
        [r"^\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;"], r"\bextends\s+([\w.<>, ]+?)(?=\s+implements|\s*\{)", r"\bimplements\s+([\w.<>, ]+)", r"\bpublic\b", r"\b(public|private|protected)\b", None, rf"@(?P<name>{NAME})",
    ),
    "csharp": Table(
        [("class", rf"\b(?:class|record)\s+(?P<name>{NAME})"), ("struct", rf"\bstruct\s+(?P<name>{NAME})"), ("interface", rf"\binterface\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"),
         ("member", rf"^[ \t]*{_MODIFIED}(?:{_TYPE}\s+)(?P<name>{NAME})\s*(?:<[^(\n]*>)?\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:where[^{{;]*)?(?:[{{;]|=>))")],
        [r"^\s*using\s+(?:static\s+)?(?P<name>[\w.]+)\s*;"], r"(?<!\?)\s:\s*([\w.<>, ]+)", None, r"\bpublic\b", r"\b(public|private|protected|internal)\b", "private", rf"\[(?P<name>{NAME})",
    ),
    "go": Table(
        [("function", rf"^func\s+(?P<name>{NAME})\s*(?:\[[^\]]*\])?\("), ("method", rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<receiver>\w+)[^)]*\)\s*(?P<name>{NAME})\s*\("),
         ("struct", rf"^\s*(?:type\s+)?(?P<name>{NAME})\s+struct\b"), ("interface", rf"^\s*(?:type\s+)?(?P<name>{NAME})\s+interface\b"), ("type_alias", rf"^type\s+(?P<name>{NAME})\s+(?!struct|interface)\S"),
         ("constant", rf"^const\s+(?P<name>{NAME})\b"), ("variable", rf"^var\s+(?P<name>{NAME})\b")],
        [r'^\s*import\s+(?:\w+\s+)?"(?P<name>[^"]+)"', r'^\s+(?:[\w.]+\s+)?"(?P<name>[\w./-]+)"\s*$'], exported=r"^$",
    ),
    "rust": Table(
        [("function", rf"\bfn\s+(?P<name>{NAME})"), ("struct", rf"\bstruct\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"), ("trait", rf"\btrait\s+(?P<name>{NAME})"), ("module", rf"^\s*(?:pub\s+)?mod\s+(?P<name>{NAME})"),
         ("impl", rf"^\s*(?:unsafe\s+)?impl\b(?:<[^{{]*?>)?\s*(?:(?P<of>[\w:]+)(?:<[^{{]*?>)?\s+for\s+)?(?P<name>{NAME})"), ("type_alias", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>{NAME})"),
         ("constant", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>{NAME})\s*:")],
        [r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+(?P<name>\w+)"], r"^[^{]*\btrait\s+\w+[^:{]*:\s*([\w:+ ]+)", None, r"\bpub\b", None, None, None,
    ),
    "c": Table(
        [("struct", rf"\b(?:struct|union)\s+(?P<name>{NAME})(?=\s*\{{)"), ("enum", rf"\benum\s+(?P<name>{NAME})(?=\s*\{{)"), ("type_alias", rf"^\s*typedef\b[^;{{}}]*?\b(?P<name>{NAME})\s*;"),
         ("function", rf"^(?!\s*(?:return|else|typedef)\b)[ \t]*(?:[\w*]+[ \t*]+)+\**(?P<name>{NAME})\s*\((?=[^;{{}}]*\)\s*\{{)")],
        [r'^\s*#\s*include\s*[<"](?P<name>[^>"]+)[>"]'],
    ),
    "php": Table(
        [("class", rf"\bclass\s+(?P<name>{NAME})"), ("interface", rf"\binterface\s+(?P<name>{NAME})"), ("trait", rf"\btrait\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"), ("function", rf"\bfunction\s+&?(?P<name>{NAME})\s*\("), ("constant", rf"\bconst\s+(?P<name>{NAME})\s*=")],
        [r"^\s*use\s+(?:function\s+)?(?P<name>[\w\\]+)", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"](?P<name>[^'"]+)"""], r"\bextends\s+([\w\\, ]+?)(?=\s+implements|\s*\{)", r"\bimplements\s+([\w\\, ]+)", None, r"\b(public|private|protected)\b", "public",
    ),
    "kotlin": Table(
        [("class", rf"\b(?:class|object)\s+(?P<name>{NAME})"), ("interface", rf"\binterface\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+class\s+(?P<name>{NAME})"), ("function", rf"\bfun\s+(?:<[^(\n]*>\s*)?(?:(?P<receiver>\w+)(?:<[^(\n]*>)?\??\.)?(?P<name>{NAME})\s*\("), ("type_alias", rf"\btypealias\s+(?P<name>{NAME})"), ("property", rf"^\s*{_MODIFIED}(?:val|var)\s+(?P<name>{NAME})")],
        [r"^\s*import\s+(?P<name>[\w.*]+)"], r"\)?\s*:\s*([\w.<>(), ]+?)(?=\s*\{|\n|\s*$)", None, None, r"\b(public|private|protected|internal)\b", "public", rf"@(?P<name>{NAME})",
    ),
    "swift": Table(
        [("class", rf"\b(?:class|actor)\s+(?!func\b|var\b)(?P<name>{NAME})"), ("struct", rf"\bstruct\s+(?P<name>{NAME})"), ("interface", rf"\bprotocol\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"), ("class", rf"\bextension\s+(?P<name>{NAME})"), ("function", rf"\bfunc\s+(?P<name>{NAME})"), ("type_alias", rf"\btypealias\s+(?P<name>{NAME})")],
        [r"^\s*import\s+(?P<name>\w+)"], r"^[^{(]*?:\s*([\w., ]+)", None, r"\b(?:public|open)\b", r"\b(public|private|fileprivate|internal|open)\b", "internal", rf"@(?P<name>{NAME})",
    ),
    "scala": Table(
        [("class", rf"\b(?:class|object)\s+(?P<name>{NAME})"), ("trait", rf"\btrait\s+(?P<name>{NAME})"), ("function", rf"\bdef\s+(?P<name>{NAME})"), ("type_alias", rf"^\s*type\s+(?P<name>{NAME})"), ("variable", rf"^\s*(?:private\s+|protected\s+|lazy\s+|implicit\s+)*va[lr]\s+(?P<name>{NAME})")],
        [r"^\s*import\s+(?P<name>[\w.]+)"], r"\bextends\s+([\w.]+(?:\s+with\s+[\w.]+)*)", None, None, r"\b(private|protected)\b", "public", rf"@(?P<name>{NAME})",
    ),
    "dart": Table(
        [("class", rf"\b(?:class|mixin|extension)\s+(?P<name>{NAME})"), ("enum", rf"\benum\s+(?P<name>{NAME})"), ("type_alias", rf"\btypedef\s+(?P<name>{NAME})"), ("member", rf"^[ \t]*(?:(?:static|final|const|external|factory)\s+)*(?:{_TYPE}\s+)?(?P<name>{NAME})\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:async\*?|sync\*)?\s*(?:\{{|=>))")],
        [r"""^\s*(?:import|export)\s+['"](?P<name>[^'"]+)"""], r"\bextends\s+([\w.]+)", r"\bimplements\s+([\w., ]+)", None, None, None, rf"@(?P<name>{NAME})",
    ),
    "ruby": Table(
        [("class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"), ("module", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"), ("function", r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")],
        [r"""^\s*require(?:_relative)?\s+['"](?P<name>[^'"]+)"""], r"^\s*class\s+[\w:]+\s*<\s*([\w:]+)", None, None, None, "public", words=True, scopes=("class", "module"),
    ),
    "lua": Table(
        [("function", r"\bfunction\s+(?:(?P<receiver>\w+)[.:])?(?P<name>\w+)\s*\("), ("function", r"\blocal\s+(?P<name>\w+)\s*=\s*function\b"), ("variable", r"^local\s+(?P<name>\w+)\s*=(?!\s*(?:function|require))")],
        [r"""\brequire\s*\(?\s*['"](?P<name>[^'"]+)"""], words=True,
    ),
    "pascal": Table(
        [("module", r"(?i)^\s*(?:unit|program|library)\s+(?P<name>[\w.]+)\s*;"), ("class", rf"(?i)^\s*(?P<name>{NAME})\s*=\s*class\b"), ("struct", rf"(?i)^\s*(?P<name>{NAME})\s*=\s*(?:packed\s+)?record\b"), ("interface", rf"(?i)^\s*(?P<name>{NAME})\s*=\s*interface\b"),
         ("method", rf"(?i)^\s*(?:class\s+)?(?:procedure|function|constructor|destructor)\s+(?P<receiver>\w+)\.(?P<name>{NAME})"), ("function", rf"(?i)^\s*(?:procedure|function)\s+(?P<name>{NAME})\s*[(;:]")],
        [r"(?i)^\s*uses\s+(?P<name>[\w., \n]+);"], r"(?i)=\s*class\s*\(\s*([\w., ]+)\)",
    ),
}
TABLES["cpp"] = Table(
    [("class", rf"\bclass\s+(?P<name>{NAME})(?=[^;{{}}()]*\{{)"), *TABLES["c"].declarations, ("module", rf"\bnamespace\s+(?P<name>{NAME})(?=\s*\{{)"),
     ("method", rf"^[ \t]*(?:[\w:*&<>,]+[ \t*&]+)*(?P<receiver>\w+)::(?P<name>~?{NAME})\s*\((?=[^;{{}}]*\)[^;{{}}]*\{{)")],
    TABLES["c"].imports, r"\b(?:class|struct)\s+\w+\s*(?:final\s*)?:\s*((?:(?:public|private|protected|virtual)\s+)*[\w:<>, ]+)",
)
TABLES["luau"] = TABLES["lua"]
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|::|->|\?\.)[A-Za-z_$][\w$]*)*)(?:<[\w, ]+>)?\s*\(")
_OPENERS = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b|\bfunction\b|\bthen\b|\brepeat\b", re.M)
_compiled: dict[str, tuple] = {}


def _table(language: str) -> tuple[Table, list, list]:
    if language not in _compiled:
        t = TABLES[language]
        _compiled[language] = t, [(k, re.compile(p, re.M)) for k, p in t.declarations], [re.compile(p, re.M) for p in t.imports]
    return _compiled[language]


def _braces(code: str) -> dict[int, int]:
    """Where each opening brace closes."""
    ends, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.start()
    return ends


def _word_end(code: str, at: int, language: str) -> int:
    """Where the block that starts on the line of `at` meets its `end`."""
    depth = 0
    pattern = re.compile(r"\b(?:function|do|then|repeat|end|until|elseif)\b" if language in ("lua", "luau") else r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?=\s*(?:\|[^|\n]*\|)?\s*$)|=\s*(?:if|case|begin)\b|\bend\b", re.M)
    for m in pattern.finditer(code, at):
        word = m[0].strip()
        if word in ("end", "until") and (word == "end" or language in ("lua", "luau")):
            depth -= 1
        elif word == "elseif":
            depth -= 1
        else:
            depth += 1
        if depth <= 0:
            return m.end()
    return len(code)


def _names(listed: str) -> list[str]:
    flat = re.sub(r"<[^<>]*>|\([^()]*\)", "", re.sub(r"<[^<>]*>", "", listed))
    parts = re.split(r"\s*,\s*|\s+with\s+|\s*\+\s*|\s+&\s+", flat.strip())
    return [p.split()[-1] for p in parts if p.split()]


def extract(found: Found, text: str) -> None:
    table, declarations, imports = _table(found.language)
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    line_of = lambda at: bisect.bisect_right(lines, at)
    root = found.file(len(lines))
    plain, code = blank(text, found.language), blank(text, found.language, strings=True)
    braces = {} if table.words else _braces(code)
    openings = sorted(braces)
    spans: dict[int, tuple] = {}
    for kind, pattern in declarations:
        for m in pattern.finditer(code):
            name, at = m["name"], m.start("name")
            if at in spans or name in _CONTROL:
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            if table.words:
                end = _word_end(code, code.rfind("\n", 0, start) + 1, found.language) if kind != "variable" else code.find("\n", m.end())
                head = code[start : (code.find("\n", m.end()) if code.find("\n", m.end()) > 0 else len(code))]
            else:
                k = bisect.bisect_left(openings, m.end())
                body = openings[k] if k < len(openings) else -1
                stop = re.compile(r";|\n\s*\n" if kind not in ("constant", "variable", "property", "type_alias") else r";|\n").search(code, m.end())
                if body >= 0 and (stop is None or body < stop.start()) and kind not in ("constant", "variable", "property"):
                    end, head = braces[body] + 1, code[start:body]
                else:
                    end = stop.start() if stop else len(code)
                    head = code[start:end]
                if found.language == "pascal":
                    close = re.compile(r"(?im)^\s*end\s*;").search(code, m.end()) if kind != "module" else None
                    end = len(code) if kind == "module" else close.end() if close else end
            spans[at] = (start, end if end >= 0 else len(code), kind, name, m, head)
    ids: list[tuple[int, int, str, str]] = []
    symbols: list[tuple[int, int, str, str, int, int]] = []
    open_: list[tuple[int, str, str, str]] = []
    for at in sorted(spans, key=lambda a: (spans[a][0], -spans[a][1])):
        start, end, kind, name, m, head = spans[at]
        while open_ and open_[-1][0] <= start:
            open_.pop()
        holder = open_[-1] if open_ else None
        scope = [n for _, n, k, _ in open_ if k != "file"]
        parent = next((i for _, _, k, i in reversed(open_) if k != "impl"), root)
        if kind == "impl":
            open_.append((end, name, "impl", root))
            if m["of"]:
                found.ref(root, m["of"].split("::")[-1], "implements", line_of(start))
            continue
        in_type = holder is not None and holder[2] in (*table.scopes, "impl")
        if kind == "member":
            if not in_type and holder is not None:
                continue  # a call with a block, not a declaration
            kind = "method" if in_type else "function"
            if holder is None and found.language in ("typescript", "javascript", "tsx", "jsx", "java", "csharp"):
                continue
        elif kind == "function" and in_type:
            kind = "method"
        elif kind in ("constant", "variable", "property") and holder is not None and not in_type:
            continue
        row, marks = line_of(start) - 1, []
        if table.decorator:  # decorators stand on the lines right above, or on the declaration's own line
            marked = [code[lines[row] : start]]
            while row > 0 and re.match(rf"\s*{table.decorator}", code[lines[row - 1] : lines[row]]):
                row -= 1
                marked.insert(0, code[lines[row] : lines[row + 1]])
            marks = [d["name"] for d in re.finditer(table.decorator, "".join(marked))]
        line_head = plain[max(text.rfind("\n", 0, start) + 1, 0) : start] + head
        facts: dict = {"docstring": comment_before(text, lines[row]), "start_column": start - lines[line_of(start) - 1]}
        if kind in ("function", "method"):
            shown = text[at + len(name) : start + len(head)].strip()
            shown = shown[: shown.find(")") + 1] if table.words else shown
            facts |= {"signature": re.sub(r"\s+", " ", shown)[:200] or None, "is_async": bool(re.search(r"\b(?:async|suspend)\b", line_head)), "is_static": bool(re.search(r"\bstatic\b", line_head))}
        elif kind in ("constant", "variable"):
            value = text[m.end() : end].strip()
            facts["signature"] = f"= {value[:100]}" if value else None
        if table.visibility:
            seen = re.search(table.visibility, line_head)
            facts["visibility"] = seen[1] if seen else table.default_visibility
        if found.language == "go":
            facts["is_exported"] = name[:1].isupper()
        elif table.exported:
            facts["is_exported"] = bool(re.search(table.exported, line_head))
        receiver = m.groupdict().get("receiver")
        if receiver:
            kind, scope = ("method", [receiver])
        ident = found.node(kind, name, line_of(start), line_of(max(start, end - 1)), scope, parent, **facts)
        ids.append((start, end, ident, kind))
        symbols.append((start, end, ident, kind, at + len(name), start + len(head)))
        open_.append((end, name, kind, ident))
        for edge, pattern in (("extends", table.extends), ("implements", table.implements)):
            if pattern and kind in ("class", "struct", "interface", "trait", "enum"):
                seen = re.search(pattern, head)
                for base in _names(seen[1]) if seen else ():
                    as_interface = found.language == "csharp" and re.match(r"I[A-Z]", base)
                    found.ref(ident, re.split(r"[.\\]|::", base)[-1], "implements" if as_interface else edge, line_of(start))
        for d in marks:
            found.ref(ident, d, "decorates", line_of(start))
    starts = [s for s, *_ in ids]

    def within(at: int, only: tuple[str, ...] | None = None) -> str:
        for k in range(bisect.bisect_right(starts, at) - 1, -1, -1):
            s, e, ident, kind = ids[k]
            if e > at and (only is None or kind in only):
                return ident
        return root

    for pattern in imports:
        for m in pattern.finditer(plain):
            for name in re.split(r"\s*,\s*", m["name"].strip()) if found.language == "pascal" else [m["name"]]:
                line = line_of(m.start("name"))
                found.node("import", name, line, line, [], root, signature=re.sub(r"\s+", " ", m[0].strip())[:200])
                found.ref(root, name, "imports", line)
    declared = {at for at in spans}
    keywords = _KEYWORDS | _MORE_KEYWORDS.get(found.language, frozenset())
    heads = sorted((v[0], v[0] + len(v[5])) for v in spans.values() if v[2] in ("class", "struct", "interface", "trait", "enum"))
    head_starts = [a for a, _ in heads]
    bodiless = [(a, b) for a, b, _, k in ids if k in ("interface", "trait", "enum", "type_alias")]
    for m in _CALL.finditer(code):
        at = m.start("name")
        name = m["name"].replace("?.", ".").replace("->", ".")
        head, dot, rest = name.partition(".")
        if dot and head in ("this", "self", "super", "cls", "base"):
            name = rest
        last = re.split(r"\.|::", name)[-1]
        if at in declared or any(at <= a < m.end("name") for a in (at + len(name) - len(last),) if a in declared) or last in keywords or name in keywords:
            continue
        k = bisect.bisect_right(head_starts, at) - 1
        if k >= 0 and at < heads[k][1]:
            continue  # the head of a type: bases, not calls
        if code[at - 1 : at] in ("@", "#") or code[at - 1 : at] == "[" and found.language in ("csharp", "rust", "php"):
            continue  # a decorator or attribute
        owner = within(at)
        if found.language in ("c", "cpp", "java", "csharp", "dart") and owner == within(at, ("class", "struct")) != root:
            continue  # a member's declaration
        if any(a < at < b for a, b in bodiless) and owner == within(at, ("interface", "trait", "enum", "type_alias")):
            continue  # the signature of a member
        if m["new"]:
            found.ref(within(at), last, "instantiates", line_of(at), at - lines[line_of(at) - 1])
        else:
            found.ref(within(at), name, "calls", line_of(at), at - lines[line_of(at) - 1])
    if not table.words and found.language != "pascal":
        members.extend(found, code, line_of, symbols)
