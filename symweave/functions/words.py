"""Search words: query parsing, terms, stems, and scores of names and paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from symweave.functions.paths import basename, dirname, is_test_file
from symweave.schema import LANGUAGES, NODE_KINDS

# Words that say nothing about a symbol.
STOP_WORDS = frozenset(
    """the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should
    may might can shall not no all each every how what where when who which why i me my we our you your he she they show give tell
    been done made used using work works found also into then than just more some such over only out its so up as if look need needs
    want happen happens affect affected break breaks failing implemented implement
    code file files function method class type fix bug called""".split()
)
# Points for each kind of symbol.
KIND_POINTS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8,
    "route": 9, "module": 4, "property": 3, "field": 3, "variable": 2, "constant": 3, "import": 1, "export": 1, "parameter": 0,
    "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}


@dataclass(frozen=True)
class Query:
    """What a query line asks for."""

    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


#: A token: anything but white space, where a quote runs to the next quote or to the end.
TOKEN = re.compile(r'(?:[^\s"]|"[^"]*(?:"|$))+')


def parse_query(line: str) -> Query:
    """Fields kind:, lang: or language:, path: and name:; everything else, unknown values included, is text."""
    found, words = Query(), []
    for token in TOKEN.findall(line):
        key, colon, value = token.partition(":")
        key = key.lower()
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = value[1:-1]
        if key == "kind" and value in NODE_KINDS:
            found.kinds.append(value)
        elif key in ("lang", "language") and value.lower() in LANGUAGES:
            found.languages.append(value.lower())
        elif key == "path" and value:
            found.paths.append(value)
        elif key == "name" and value:
            found.names.append(value)
        else:
            words.append(token)
    return Query(" ".join(words).strip(), found.kinds, found.languages, found.paths, found.names)


#: Suffix, least length of the word, endings that replace it, and the suffix that must not be there.
STEM_RULES = (
    ("ing", 6, ("", "e"), None, True),
    ("tion", 6, ("t",), None, False),
    ("sion", 6, ("s",), None, False),
    ("ment", 7, ("",), None, False),
    ("ed", 5, ("e", ""), "eed", False),
    ("ied", 6, ("y",), None, False),
    ("er", 5, ("", "e"), None, True),
)


def stems(term: str) -> list[str]:
    """Prefixes that related words share; three letters or more."""
    word, out = term.lower(), {}
    for suffix, least, endings, but, undouble in STEM_RULES:
        if word.endswith(suffix) and len(word) >= least and not (but and word.endswith(but)):
            base = word[: -len(suffix)]
            out |= dict.fromkeys(base + e for e in endings)
            if undouble and len(base) > 1 and base[-1] == base[-2]:
                out[base[:-1]] = None
    if len(word) > 4:  # plurals: the longest suffix decides
        if word.endswith("ies"):
            out[word[:-3] + "y"] = None
        elif word.endswith("es"):
            out[word[:-2]] = None
        elif word.endswith("s") and not word.endswith("ss"):
            out[word[:-1]] = None
    return [v for v in out if len(v) > 2 and v != word]


CAMEL = re.compile(r"\b(?:[a-zA-Z][a-zA-Z0-9]*(?:[A-Z][a-z]+)+|[A-Z][a-z]+(?:[A-Z][a-z]*)+)\b")
SNAKE = re.compile(r"\b[a-zA-Z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b")


def split_camel(text: str) -> str:
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", text))


def search_terms(text: str, with_stems: bool = True) -> list[str]:
    """Compound names and their parts, without stop words, then stems."""
    out = {m.lower(): None for pattern in (CAMEL, SNAKE) for m in pattern.findall(text) if len(m) > 2}
    parts = re.split(r"[^a-zA-Z0-9]+", split_camel(text).replace("_", " ").replace(".", " "))
    out |= {w: None for w in map(str.lower, parts) if len(w) > 2 and w not in STOP_WORDS}
    if with_stems:
        out |= {s: None for t in list(out) for s in stems(t) if s not in out and s not in STOP_WORDS}
    return list(out)


def kind_points(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in KIND_POINTS.items() for x in pair])[kind], F.lit(0))


def path_points(path: Column, query: str) -> Column:
    """For each term 10 in the file name, 5 in the directory or else 3 anywhere; 15 off for tests unless the query is about them."""
    low, points = F.lower(path), F.lit(0)
    terms = search_terms(query, with_stems=False)
    if not terms:
        return points
    for term in terms:
        points += F.when(basename(low).contains(term), 10).otherwise(0) + F.when(dirname(low).contains(term), 5).when(low.contains(term), 3).otherwise(0)
    if not re.search("test|spec", query.lower()):
        points -= F.when(is_test_file(path), 15).otherwise(0)
    return points


def name_points(name: Column, query: str) -> Column:
    """80 for the name itself, 60 for one of several words, 10 to 40 for a prefix, 15 for all words, 10 for a part, else 0."""
    low, whole = F.lower(name), re.sub(r"\s+", "", query).lower()
    words = [w for w in query.lower().split() if len(w) > 1]
    parts = [w for w in map(str.lower, re.split(r"[\s_.\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))) if len(w) > 1]
    points = F.when(low == whole, 80)
    if len(words) > 1:
        points = points.when(low.isin(words), 60)
    points = points.when(low.startswith(whole), F.floor(10 + 30 * len(whole) / F.length(low) + 0.5).cast("int"))
    if len(parts) > 1:
        every = F.lit(True)
        for p in parts:
            every &= low.contains(p)
        points = points.when(every, 15)
    return points.when(low.contains(whole), 10).otherwise(0)


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance; most + 1 for anything farther."""
    near = F.levenshtein(a, b, most)
    return F.when(near < 0, most + 1).otherwise(near)
