"""Columns over file paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directories that hold no production code.
NON_PRODUCTION = ("integration", "sample", "samples", "example", "examples", "fixture", "fixtures", "benchmark", "benchmarks", "demo", "demos")
TEST_DIRS = ("tests", "test", "__tests__", "spec", "specs", "testlib", "testing")
TEST_ROOTS = ("test", "tests", "spec", "specs")
# Patterns of files that a change can make fail.
AFFECTED = (r"\.spec\.", r"\.test\.", r"/__tests__/", r"/tests?/", r"/e2e/", r"/spec/")
# File extensions and their languages.
EXTENSIONS = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "jsx",
    ".py": "python", ".pyw": "python", ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp",
    ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hxx": "cpp", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".rake": "ruby",
    ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".dart": "dart", ".liquid": "liquid", ".svelte": "svelte",
    ".vue": "vue", ".pas": "pascal", ".dpr": "pascal", ".dpk": "pascal", ".lpr": "pascal", ".dfm": "pascal", ".fmx": "pascal",
    ".scala": "scala", ".sc": "scala", ".lua": "lua", ".luau": "luau",
}
# Fixed value: what tells a C++ header from a C one, in its first 8 KiB.
CPP_HEADER = r"\bnamespace\b|\bclass\s+\w+\s*[:{]|\btemplate\s*<|\b(?:public|private|protected)\s*:|\bvirtual\b|\busing\s+(?:namespace\b|\w+\s*=)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The directory; '.' for files at the root."""
    cut = F.length(path) - F.length(basename(path)) - 1
    return F.when(cut > 0, F.substring(path, F.lit(1), cut)).when(cut == 0, F.lit("/")).otherwise(F.lit("."))


def is_test_file(path: Column) -> Column:
    """By file name, by CamelCase suffix, by directory; non-production directories count too."""
    name = basename(path)
    low, low_name = F.lower(path), F.lower(name)
    found = low_name.startswith("test_") | low_name.startswith("test.")
    found |= low_name.rlike(r"[._-](test|tests|spec|specs)\.[a-z0-9]+$") | name.rlike(r"(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$")
    found |= low.rlike("/(" + "|".join(TEST_DIRS) + ")/") | low.rlike("^(" + "|".join(TEST_ROOTS) + ")/")
    found |= path.rlike(r"(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/") | low.rlike("(^|/)(" + "|".join(NON_PRODUCTION) + ")/")
    return found


def is_affected_test(path: Column, pattern: str | None = None) -> Column:
    """Whether a change report lists the file as a test: its own, narrower set of patterns; or a glob that may match anywhere."""
    if not pattern:
        return path.rlike("|".join(AFFECTED))
    parts = re.split(r"(\*\*|\*)", pattern)
    return path.rlike("".join({"**": ".+", "*": "[^/]*"}.get(x) or re.escape(x) for x in parts))


def glob_regex(glob: str) -> str:
    """An anchored pattern: ** any path, * within a directory, ? one letter, {a,b} and [..] as in shells; dot files match."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            continue
        if c in "{}":
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^(?:{out})$"


def included(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Exclusions first, then inclusions."""
    away = F.lit(False)
    for g in exclude:
        away |= path.rlike(glob_regex(g))
    wanted = F.lit(not include)
    for g in include:
        wanted |= path.rlike(glob_regex(g))
    return ~away & wanted


def language_of(path: Column, source: Column | None = None) -> Column:
    """By extension; a .h file whose start looks like C++ is C++."""
    low = F.lower(path)
    extension = F.when(basename(low).contains("."), F.concat(F.lit("."), F.substring_index(low, ".", -1)))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    found = F.coalesce(table[extension], F.lit("unknown"))
    if source is None:
        return found
    return F.when((extension == ".h") & F.substring(source, 1, 8192).rlike(CPP_HEADER), F.lit("cpp")).otherwise(found)


def inside(path: Column, root: str) -> Column:
    """Whether a relative or absolute path stays below root: no part climbs out of it."""
    root = root.rstrip("/")
    absolute = path.startswith("/")
    rest = F.when(absolute, F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 20))).otherwise(path)
    step = F.transform(F.split(rest, "/"), lambda p: F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1))
    least = F.aggregate(step, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.least(a["low"], a["at"] + x).alias("low")))
    return F.coalesce(least["low"] >= 0, F.lit(False))


def proximity(a: Column, b: Column) -> Column:
    """15 for each leading directory that two paths share, 80 at most."""
    folders = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    pairs = F.zip_with(folders(a), folders(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + F.when(s["on"] & same, 1).otherwise(0)).alias("n"), (s["on"] & same).alias("on")))
    return F.least(shared["n"] * 15, F.lit(80))
