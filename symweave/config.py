"""Settings of a project: which files belong to it, how large they may be, patterns of its own."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields, replace

from symweave.errors import ConfigError
from symweave.schema import LANGUAGES, NODE_KINDS
from symweave.sources.tree import EXCLUDE, INCLUDE, MOST

FOLDER, NAME = ".symweave", "config.json"


@dataclass(frozen=True)
class Pattern:
    """Symbols of a kind that a pattern finds in any source."""

    name: str
    pattern: str
    kind: str


@dataclass(frozen=True)
class Config:
    version: int = 1
    include: tuple[str, ...] = tuple(INCLUDE)
    exclude: tuple[str, ...] = tuple(EXCLUDE)
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    most: int = MOST
    docstrings: bool = True
    call_sites: bool = True
    patterns: tuple[Pattern, ...] = field(default=())


def safe_pattern(pattern: str) -> bool:
    """Whether a pattern compiles, is short, and repeats no group that repeats itself."""
    if len(pattern) > 500 or re.search(r"[+*}]\s*[+*{]", pattern) or re.search(r"\([^)]*[+*][^)]*\)[+*{]", pattern):
        return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def checked(config: Config) -> Config:
    """config, or ConfigError with what is wrong."""
    wrong = [f"unknown language {x}" for x in config.languages if x not in LANGUAGES]
    wrong += [f"pattern {p.name} may take too long or does not compile" for p in config.patterns if not safe_pattern(p.pattern)]
    wrong += [f"pattern {p.name} has an unknown kind {p.kind}" for p in config.patterns if p.kind not in NODE_KINDS]
    for name in ("include", "exclude"):
        wrong += [f"{name} holds {x!r}" for x in getattr(config, name) if not isinstance(x, str)]
    for name, sort in (("version", int), ("most", int), ("docstrings", bool), ("call_sites", bool)):
        if type(getattr(config, name)) is not sort:
            wrong.append(f"{name} is no {sort.__name__}")
    if wrong:
        raise ConfigError("; ".join(wrong))
    return config


def path_of(root: str) -> str:
    return os.path.join(root, FOLDER, NAME)


def load(root: str) -> Config:
    """The project's settings over the defaults; the defaults where it has none."""
    at = path_of(root)
    if not os.path.exists(at):
        return Config()
    try:
        with open(at, encoding="utf-8") as file:
            given = json.load(file)
    except ValueError as why:
        raise ConfigError(f"no valid JSON in {at}", path=at) from why
    if not isinstance(given, dict):
        raise ConfigError(f"no settings in {at}", path=at)
    known = {f.name for f in fields(Config)}
    kept = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in known and v is not None}
    try:
        kept["patterns"] = tuple(Pattern(**p) for p in kept.get("patterns", ()))
    except TypeError as why:
        raise ConfigError(f"a pattern in {at} has a wrong shape", path=at) from why
    return checked(replace(Config(), **kept))


def save(root: str, config: Config) -> None:
    """Writes a new file and puts it in the old one's place."""
    at = path_of(root)
    os.makedirs(os.path.dirname(at), exist_ok=True)
    with open(f"{at}.new", "w", encoding="utf-8") as file:
        json.dump(asdict(checked(config)), file, indent=1)
    os.replace(f"{at}.new", at)


def changed(root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), pattern: Pattern | None = None, **values) -> Config:
    """Adds globs, adds or replaces a pattern of a name, sets other values; saves and returns the result."""
    now = replace(load(root), **values)
    now = replace(now, include=tuple(dict.fromkeys((*now.include, *include))), exclude=tuple(dict.fromkeys((*now.exclude, *exclude))))
    if pattern:
        now = replace(now, patterns=(*(p for p in now.patterns if p.name != pattern.name), pattern))
    save(root, now)
    return now
