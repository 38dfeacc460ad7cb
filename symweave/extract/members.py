"""Members of types and the types that signatures name: enum members, fields, properties, annotations; over text without comments and strings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from symweave.extract.model import Found

NAME = r"[A-Za-z_]\w*"
#: Languages whose enum members are introduced by a word.
CASES = ("swift", "php", "scala")
_KINDS = r"[\w.]+(?:<[^;{}()]*>)?(?:\[\s*\])*\??"
_WORDS = r"(?:(?:public|private|protected|internal|static|final|readonly|volatile|transient|const|abstract|virtual|override|sealed|new|required|lateinit|open)\s+)*"
#: (kind, pattern) of what stands in a type's body, by language.
FIELDS: dict[str, list[tuple[str, re.Pattern]]] = {
    "java": [("field", re.compile(rf"(?m)^[ \t]*(?:@\w+[ \t]*)*{_WORDS}(?P<type>{_KINDS})\s+(?P<name>{NAME})\s*(?==[^=]|;|,)"))],
    "csharp": [
        ("property", re.compile(rf"(?m)^[ \t]*{_WORDS}(?P<type>{_KINDS})\s+(?P<name>{NAME})\s*(?=\{{|=>)")),
        ("field", re.compile(rf"(?m)^[ \t]*{_WORDS}(?P<type>{_KINDS})\s+(?P<name>{NAME})\s*(?==[^=>]|;|,)")),
    ],
    "php": [("field", re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|static|var|readonly)\s+)+(?:[\w?|\\]+\s+)?\$(?P<name>\w+)"))],
}
#: Where a type follows a colon, and where it stands before the name.
AFTER_COLON = ("typescript", "tsx", "kotlin", "swift", "rust")
BEFORE_NAME = ("java", "csharp", "dart", "go")
# Names of types that every program has.
BUILT_IN = frozenset(
    """string number boolean void null undefined never any unknown object symbol bigint true false str bool i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize
    f32 f64 char int long short byte float double int8 int16 int32 int64 uint8 uint16 uint32 uint64 float32 float64 complex64 complex128 rune error""".split()
)
_NO_TYPES = frozenset("mut dyn impl ref self Self in out inout where const final async readonly keyof typeof is asserts extends infer unique fun func fn".split())


def level(code: str) -> str:
    """The text with blanks for what stands inside of brackets; brackets and line ends stay."""
    out, depth = [], 0
    for c in code:
        if c in ")]}":
            depth = max(0, depth - 1)
        out.append(c if depth == 0 or c == "\n" else " ")
        if c in "([{":
            depth += 1
    return "".join(out)


def body(code: str, start: int, end: int) -> tuple[int, str]:
    """Where the body in braces of code[start:end] begins, and its own level of text."""
    opens = code.find("{", start, end)
    if opens < 0:
        return end, ""
    close = end - 1 if code[end - 1 : end] == "}" else end
    return opens + 1, level(code[opens + 1 : close])


def enum_names(language: str, text: str) -> Iterable[tuple[str, int]]:
    """(name, place) of the members in an enum's body."""
    if language in CASES:
        for m in re.finditer(r"\bcase\s+([^\n;:=]+)", text):
            for part in re.finditer(rf"(?:^|,)\s*({NAME})", m[1]):
                yield part[1], m.start(1) + part.start(1)
        return
    text = re.sub(r"@\w+|#", lambda m: " " * len(m[0]), text)
    stop = text.find(";") if language in ("java", "kotlin", "dart") else -1
    for part in re.finditer(rf"(?:^|,)\s*(?:\[\s*\]\s*)*(?:\(\s*\)\s*)*({NAME})", text[: stop if stop >= 0 else len(text)]):
        yield part[1], part.start(1)


def after_colons(text: str) -> Iterable[tuple[str, int]]:
    """What follows each single colon or arrow, up to a comma, a default, a body or the end of the list it stands in; and where."""
    at = 0
    while at < len(text):
        if text.startswith("::", at):
            at += 2
            continue
        start = at + 1 if text[at] == ":" else at + 2 if text.startswith("->", at) else 0
        if not start:
            at += 1
            continue
        at, depth = start, 0
        while at < len(text):
            c = text[at]
            if c in "([<":
                depth += 1
            elif c in ")]" or c == ">" and text[at - 1] not in "-=":
                if not depth:
                    break
                depth -= 1
            elif c in "={;" and text[at : at + 2] != "=>" or c == "," and not depth:
                break
            at += 1
        yield text[start:at], start


def types_in(language: str, before: str, after: str) -> Iterable[tuple[str, int]]:
    """(name, place in after; -1 for what stands before the symbol's own name) of the types that a signature names."""

    def names(text: str, at: int) -> Iterable[tuple[str, int]]:
        for m in re.finditer(rf"(?<![\w'.]){NAME}(?:\s*(?:\.|::)\s*{NAME})*(?!\s*\??:(?!:)|\w)", text):
            last = re.split(r"\s*(?:\.|::)\s*", m[0])[-1]
            if last not in BUILT_IN and last not in _NO_TYPES:
                yield last, at + m.start() if at >= 0 else -1

    if language in AFTER_COLON:
        for text, at in after_colons(after):
            yield from names(text, at)
    else:
        for name, at in [*names(before, -1), *names(after, 0)]:
            if name[:1].isupper():
                yield name, at


def extend(found: Found, code: str, line_of: Callable[[int], int], symbols: list[tuple[int, int, str, str, int, int]]) -> None:
    """Adds members and annotations.  symbols: (start, end, id, kind, end of the name, end of the head) of the file's declarations."""
    known = {n["id"]: n for n in found.nodes}
    noted = found.language in (*AFTER_COLON, *BEFORE_NAME)

    def annotate(ident: str, before: str, after: str, at: int) -> None:
        own = known.get(ident, {}).get("name")
        for name, place in dict.fromkeys(types_in(found.language, before, after)):
            if name != own:
                found.ref(ident, name, "references", line_of(at + max(place, 0)))

    for start, end, ident, kind, named, head in symbols:
        if ident not in known:
            continue
        scope = known[ident]["qualified_name"].split("::")
        if kind == "enum" or found.language == "kotlin" and re.search(r"\benum\s+class\s+$", code[:named - len(known[ident]["name"])][-40:]):
            at, text = body(code, start, end)
            for name, place in enum_names(found.language, text):
                found.node("enum_member", name, line_of(at + place), line_of(at + place), scope, ident)
        elif kind in ("class", "struct", "interface", "trait") and found.language in FIELDS:
            at, text = body(code, start, end)
            taken: set[str] = set()
            for sort, pattern in FIELDS[found.language]:
                for m in pattern.finditer(text):
                    shape = (m.groupdict().get("type") or "").strip()
                    if m["name"] in taken or shape in ("return", "class", "package", "import", "throw", "record", "enum", "interface", "struct", "namespace", "new", "else"):
                        continue
                    taken.add(m["name"])
                    line = line_of(at + m.start("name"))
                    inner = found.node(sort, m["name"], line, line, scope, ident, signature=shape or None)
                    known[inner] = found.nodes[-1]
                    if noted and shape:
                        annotate(inner, shape if found.language in BEFORE_NAME else "", f": {shape}" if found.language in AFTER_COLON else "", at + m.start("name"))
        elif kind in ("function", "method") and noted:
            before = code[start:named]
            before = before[: len(before) - len(known[ident]["name"])] if found.language in ("java", "csharp", "dart") else ""
            annotate(ident, re.sub(r"\b(?:func|fn|fun)\b", " ", before), code[named:head], named)
