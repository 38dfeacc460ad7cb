"""Source trees: which files belong to one, and reading them as a DataFrame.

Listing git's files needs the driver's file system; reading goes through Spark, so a tree may lie in any store that Spark reads.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.functions.paths import included, language_of

MOST = 1 << 20
MARKER = ".codeindexignore"
# Directories that hold no sources of a project, wherever they stand, and files that are made by tools.
PRUNED = (
    ".git node_modules vendor Pods dist build out bin obj target .next .nuxt .svelte-kit .output .turbo .cache .parcel-cache .vite .astro .docusaurus .gatsby .webpack .nx "
    ".pnpm-store storybook-static .expo web-build __pycache__ .venv venv site-packages dist-packages .pytest_cache .mypy_cache .ruff_cache .tox .nox .eggs .gradle .m2 "
    "generated-sources .kotlin .dart_tool .vs .nuget artifacts publish CMakeFiles vcpkg_installed .conan Debug Release x64 .pio release DerivedData .build .swiftpm "
    "xcuserdata SourcePackages __history __recovery .composer .bundle .yardoc coverage htmlcov .nyc_output test-results .coverage .idea logs tmp temp _build site"
).split()
PRUNED_PATHS = (
    ".yarn/cache ios/Pods ios/build android/build android/.gradle go/pkg/mod target/debug target/release cmake-build-* bazel-* *.egg-info *.app Carthage/Build "
    "storage/framework bootstrap/cache tmp/cache public/assets public/packs docs/_build"
).split()
MADE = "*.min.js *.bundle.js *.asar *.dcu".split()
EXCLUDE = [f"**/{d}/**" for d in (*PRUNED, *PRUNED_PATHS)] + [f"**/{f}" for f in MADE]
INCLUDE = [
    f"**/*.{e}"
    for e in "ts tsx js jsx mjs cjs py pyw go rs java c h cpp hpp cc cxx hxx cs php rb rake swift kt kts dart svelte vue liquid pas dpr dpk lpr dfm fmx scala sc lua luau".split()
]


def git_files(root: str) -> list[str] | None:
    """Tracked files and untracked ones that are not ignored, those of nested repositories too; None where git does not see the directory."""

    def ask(at: str, *what: str) -> list[str] | None:
        done = subprocess.run(["git", "-C", at, *what, "-z"], capture_output=True)
        return [p for p in done.stdout.decode("utf-8", "surrogateescape").split("\0") if p] if done.returncode == 0 else None

    if subprocess.run(["git", "-C", root, "check-ignore", "-q", "."], capture_output=True).returncode == 0:
        return None
    tracked = ask(root, "ls-files", "-c", "--recurse-submodules")
    if tracked is None:
        return None
    found = dict.fromkeys(tracked)
    for path in ask(root, "ls-files", "-o", "--exclude-standard") or []:
        if path.endswith("/"):
            found |= {f"{path}{inner}": None for inner in git_files(os.path.join(root, path)) or []}
        else:
            found[path] = None
    return list(found)


def walked(root: str) -> list[str]:
    """Files below root; pruned directories, directories with a marker file and links that lead back are left out."""
    found, seen = [], set()
    for here, folders, names in os.walk(root, followlinks=True):
        real = os.path.realpath(here)
        if real in seen or MARKER in names:
            folders.clear()
            continue
        seen.add(real)
        folders[:] = sorted(d for d in folders if d not in PRUNED)
        found += [os.path.relpath(os.path.join(here, n), root).replace(os.sep, "/") for n in sorted(names)]
    return found


def listed(spark: SparkSession, root: str, include: Iterable[str] = INCLUDE, exclude: Iterable[str] = EXCLUDE) -> DataFrame:
    """(path) of the files that belong to the tree, as git sees it or else as a walk does."""
    paths = git_files(root)
    rows = spark.createDataFrame([(p,) for p in (walked(root) if paths is None else paths)], "path string")
    return rows.filter(included(F.col("path"), list(include), list(exclude)))


def read(spark: SparkSession, root: str, include: Iterable[str] = INCLUDE, exclude: Iterable[str] = EXCLUDE, most: int = MOST) -> DataFrame:
    """(path, content, content_hash, size, modified_at) of the files below root in any store; content is null for files over `most` bytes, the hash is of all bytes."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    tail = base.split("://", 1)[-1].split("/", 1)[-1] if "://" in base else base.lstrip("/")
    path = F.element_at(F.split("path", f"/{tail}/".replace(".", r"\."), 2), 2)
    rows = raw.select(path.alias("path"), "length", "modificationTime", "content")
    kept = rows.filter(included(F.col("path"), list(include), list(exclude)))
    text = F.when(F.col("length") <= most, F.decode("content", "UTF-8"))
    return kept.select("path", text.alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))


def hashed(sources: DataFrame) -> DataFrame:
    """(path, content_hash, size): as read, or of the text where sources have none."""
    have = set(sources.columns)
    own = F.sha2(F.coalesce("content", F.lit("")), 256)
    return sources.select("path", (F.coalesce("content_hash", own) if "content_hash" in have else own).alias("content_hash"), (F.col("size") if "size" in have else F.octet_length("content")).cast("long").alias("size"))


def git_changes(root: str) -> list[tuple[str, str]] | None:
    """(path, change) of what git's status lists: added, modified or removed; a renamed file is removed and added.  None where git does not see the directory."""
    done = subprocess.run(["git", "-C", root, "status", "--porcelain", "-z", "--untracked-files=all", "--no-renames"], capture_output=True)
    if done.returncode:
        return None
    found = []
    for line in done.stdout.decode("utf-8", "surrogateescape").split("\0"):
        if line:
            state = line[:2]
            found.append((line[3:], "removed" if "D" in state else "added" if "?" in state or "A" in state else "modified"))
    return found


def summary(files: DataFrame) -> DataFrame:
    """(language, n) of files (path)."""
    return files.groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
