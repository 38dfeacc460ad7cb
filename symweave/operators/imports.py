"""Imports: from module names to files, along re-exports, to symbols."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.paths import dirname
from symweave.plans.staging import staged

CHAIN = 8
# Endings to try for each language, in order; the name as it is comes last.
ENDINGS = {
    "typescript": (".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"),
    "tsx": (".tsx", ".ts", ".d.ts", ".js", ".jsx", "/index.tsx", "/index.ts", "/index.js"),
    "jsx": (".jsx", ".js", "/index.jsx", "/index.js"),
    "python": (".py", "/__init__.py"), "go": (".go",), "rust": (".rs", "/mod.rs"), "java": (".java",), "csharp": (".cs",), "php": (".php",), "ruby": (".rb",),
}
# Prefixes that stand for directories where a project names none itself.
FALLBACK_ALIASES = (("@/", "src/"), ("~/", "src/"), ("@src/", "src/"), ("src/", "src/"), ("@app/", "app/"), ("app/", "app/"))


def aliases_of(config: str) -> list[tuple[str, str, list[tuple[str, str]]]]:
    """(prefix, suffix, targets) of a project file with comments and trailing commas: compilerOptions.paths, most specific first; each target is a prefix and suffix."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", config, flags=re.S)
    text = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)
    try:
        options = json.loads(text).get("compilerOptions", {})
    except (ValueError, AttributeError):
        return []
    base = options.get("baseUrl", ".").strip("./")

    def rooted(target: str) -> str:
        target = target.removeprefix("./")
        return f"{base}/{target}" if base else target

    out = []
    for pattern, targets in options.get("paths", {}).items():
        head, star, tail = pattern.partition("*")
        out.append((head, tail if star else None, [tuple(rooted(t).partition("*")[::2]) for t in targets]))
    return sorted(out, key=lambda x: (x[1] is not None, -len(x[0])))


def normal(path: Column) -> Column:
    """Without . and .. parts; null where it climbs above the root."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(True).alias("ok"))

    def step(a, p):
        up = p == ".."
        parts = F.when(up, F.slice(a["parts"], 1, F.greatest(F.size(a["parts"]) - 1, F.lit(0)))).when(p.isin("", "."), a["parts"]).otherwise(F.concat(a["parts"], F.array(p)))
        return F.struct(parts.alias("parts"), (a["ok"] & ~(up & (F.size(a["parts"]) == 0))).alias("ok"))

    done = F.aggregate(F.split(path, "/"), start, step)
    return F.when(done["ok"], F.array_join(done["parts"], "/"))


def candidates(path: Column, source: Column, language: Column, aliases=()) -> Column:
    """Files that a module name may mean, best first."""
    relative = source.startswith(".") & (language != "python")
    dots = F.length(F.regexp_extract(source, r"^(\.*)", 1))
    up = F.when(dots > 1, F.repeat(F.lit("../"), dots - 1)).otherwise("")
    python = F.when(dots > 0, F.concat(dirname(path), F.lit("/"), up, F.regexp_replace(F.regexp_replace(source, r"^\.+", ""), r"\.", "/"))).otherwise(F.regexp_replace(source, r"\.", "/"))
    bases = [F.when(relative, normal(F.concat(dirname(path), F.lit("/"), source))).when(language == "python", normal(python))]
    free = ~relative & (language != "python")
    for head, tail, targets in aliases:
        whole = source == head if tail is None else source.startswith(head) & source.endswith(tail) & (F.length(source) >= len(head) + len(tail))
        for before, after in targets:
            fill = F.lit(before) if tail is None else F.concat(F.lit(before), F.substring(source, F.lit(len(head) + 1), F.length(source) - len(head) - len(tail)), F.lit(after))
            bases.append(F.when(free & whole, normal(fill)))
    for head, to in FALLBACK_ALIASES:
        bases.append(F.when(free & source.startswith(head), normal(F.concat(F.lit(to), F.substring(source, F.lit(len(head) + 1), F.length(source))))))
    bases.append(F.when(free, source))
    ends = F.create_map(*[x for k, v in ENDINGS.items() for x in (F.lit(k), F.array(*map(F.lit, (*v, ""))))])
    tails = F.coalesce(ends[language], F.array(F.lit("")))
    return F.flatten(F.transform(F.filter(F.array(*bases), lambda b: b.isNotNull()), lambda b: F.transform(tails, lambda t: F.concat(b, t))))


def located(names: DataFrame, files: DataFrame, aliases=()) -> DataFrame:
    """names (path, language, source, ...) with target, the first candidate that is a file; names of other projects go."""
    asked = names.select("path", "language", "source").distinct()
    tried = asked.select("path", "language", "source", F.posexplode(candidates(F.col("path"), F.col("source"), F.col("language"), aliases)).alias("place", "target"))
    hits = tried.join(files.select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    first = hits.groupBy("path", "language", "source").agg(F.min_by("target", "place").alias("target"))
    return names.join(first, ["path", "language", "source"])


def exported_symbols(wanted: DataFrame, nodes: DataFrame, exports: DataFrame) -> DataFrame:
    """(ref_id, target): exported symbols for wanted (ref_id, file, name, kind) along re-exports of CHAIN files at most.

    kind is named, default or namespace (name is then a member).  exports: (path, target, exported, original, kind, turn), located.  Each round
    looks in the files reached so far; names passed on by name come before wildcards, nearer files before farther ones.
    """
    bearers = nodes.filter("is_exported").select(F.col("file_path").alias("file"), F.col("name").alias("n"), F.col("kind").alias("k"), "id", "start_line")
    by_name = bearers.groupBy("file", F.col("n").alias("name")).agg(F.min_by("id", F.struct("start_line", "id")).alias("target"))
    main = bearers.filter("k in ('function', 'class')").groupBy("file").agg(F.min_by("id", F.struct("start_line", "id")).alias("target"))
    frontier = staged(wanted.select("ref_id", "file", "name", "kind", F.array(F.struct(F.lit(0).alias("wild"), F.lit(0).alias("turn"))).alias("way")), "chain")
    seen, found = frontier.select("ref_id", "file"), []
    for _ in range(CHAIN + 1):
        named = frontier.filter("kind <> 'default'").join(by_name, ["file", "name"]).select("ref_id", "target", "way")
        default = frontier.filter("kind = 'default'").join(main, "file").select("ref_id", "target", "way")
        hits = staged(named.unionAll(default), "chain")
        found.append(hits)
        open_ = frontier.join(hits.select("ref_id"), "ref_id", "left_anti")
        asked = F.when(F.col("kind") == "default", "default").otherwise(F.col("name"))
        on = open_.withColumn("asked", asked).join(exports.select(F.col("path").alias("file"), F.col("target").alias("next"), "exported", "original", F.col("kind").alias("how"), "turn"), "file")
        by_names = on.filter("how = 'named' and exported = asked").select(
            "ref_id", F.col("next").alias("file"), F.col("original").alias("name"), F.when(F.col("original") == "default", "default").otherwise("named").alias("kind"), F.concat("way", F.array(F.struct(F.lit(0).alias("wild"), "turn"))).alias("way")
        )
        wild = on.filter("how = 'wildcard'").select("ref_id", F.col("next").alias("file"), "name", "kind", F.concat("way", F.array(F.struct(F.lit(1).alias("wild"), "turn"))).alias("way"))
        new = by_names.unionAll(wild).join(seen, ["ref_id", "file"], "left_anti")
        best = F.row_number().over(Window.partitionBy("ref_id", "file").orderBy("way"))
        frontier = staged(new.withColumn("place", best).filter("place = 1").drop("place"), "chain")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier.select("ref_id", "file"))
    return reduce(DataFrame.unionAll, found).groupBy("ref_id").agg(F.min_by("target", "way").alias("target"))


def by_import(refs: DataFrame, nodes: DataFrame, imports: DataFrame, exports: DataFrame, files: DataFrame, aliases=()) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): references whose name, or whose receiver, the file imports.  Certain to .9."""
    places = located(imports, files, aliases).select("path", "turn", "local", "exported", F.col("kind").alias("how"), "target")
    head = F.substring_index("reference_name", ".", 1)
    asked = refs.select("ref_id", F.col("file_path").alias("path"), "reference_name", head.alias("local")).join(places, ["path", "local"])
    member = F.when(F.col("how") == "namespace", F.expr("substring(reference_name, length(local) + 2)")).otherwise(F.col("exported"))
    first = F.row_number().over(Window.partitionBy("ref_id").orderBy("turn"))
    wanted = asked.withColumn("place", first).filter("place = 1").select("ref_id", F.col("target").alias("file"), member.alias("name"), F.col("how").alias("kind"))
    chain = located(exports, files, aliases).select("path", "target", "exported", "original", "kind", "turn")
    return exported_symbols(wanted, nodes, staged(chain, "exports")).select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))
