"""Comments and strings overwritten by spaces: offsets and line numbers stay."""

from __future__ import annotations

import re

HASH = ("python", "ruby", "php")
#: For each family: patterns of comments, then of strings.  The scanner takes whichever starts first.
_LINE, _BLOCK, _HASHED = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r"\#[^\n]*"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?' + r"|'(?:\\.|[^'\\\n])*'?"
_TICK = r"`(?:\\.|[^`\\])*`?"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)' + r"|'''(?:\\.|[^\\])*?(?:'''|\Z)"
FAMILIES: dict[str, tuple[str, str]] = {
    "c": (f"{_LINE}|{_BLOCK}", f"{_QUOTED}|{_TICK}"),
    "rust": (f"{_LINE}|{_BLOCK}", r'"(?:\\.|[^"\\])*"?' + r"|'(?:\\.|[^'\\\n])'"),
    "python": (f"{_HASHED}|{_TRIPLE}", _QUOTED),
    "ruby": (rf"{_HASHED}|^=begin.*?(?:^=end[^\n]*|\Z)", _QUOTED),
    "php": (f"{_LINE}|{_HASHED}|{_BLOCK}", _QUOTED),
    "lua": (r"--\[\[.*?(?:\]\]|\Z)|--[^\n]*", _QUOTED + r"|\[\[.*?(?:\]\]|\Z)"),
    "pascal": (r"//[^\n]*|\{.*?(?:\}|\Z)|\(\*.*?(?:\*\)|\Z)", r"'[^'\n]*'?"),
}
FAMILY = {"python": "python", "ruby": "ruby", "php": "php", "lua": "lua", "luau": "lua", "pascal": "pascal", "rust": "rust"}
_scanners: dict[str, re.Pattern] = {}


def blank(text: str, language: str, strings: bool = False) -> str:
    """Comments become spaces, with `strings` strings too (their quotes stay); line ends stay."""
    family = FAMILY.get(language, "c")
    if family not in _scanners:
        comments, quoted = FAMILIES[family]
        _scanners[family] = re.compile(f"(?P<comment>{comments})|(?P<string>{quoted})", re.S | re.M)

    def over(m: re.Match) -> str:
        if m["comment"] is not None:
            return re.sub(r"[^\n]", " ", m[0])
        if strings and len(m[0]) > 1:
            return m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
        return m[0]

    return _scanners[family].sub(over, text)


def comment_before(text: str, at: int) -> str | None:
    """The comment that ends right above a declaration, without its marks."""
    end = at  # read from here backwards: what is copied does not grow with the file
    while end and text[end - 1] in " \t":
        end -= 1
    if text[end - 1 : end] != "\n":
        return None
    while end and text[end - 1].isspace():
        end -= 1
    if text.endswith("*/", 0, end):
        start = text.rfind("/*", 0, end)
        lines = text[start + 2 : end - 2].strip("*").split("\n") if start >= 0 else []
    else:
        lines = []
        while end >= 0:
            start = text.rfind("\n", 0, end) + 1
            bare = text[start:end].strip()
            if not bare.startswith(("//", "#", "--")) or bare.startswith(("#[", "#include", "#define", "#!")):
                break
            lines.append(bare)
            end = start - 1
        lines.reverse()
    cleaned = "\n".join(re.sub(r"^\s*(?:/{2,}!?|\*+|#+|--+)? ?", "", x).rstrip() for x in lines).strip()
    return cleaned or None
