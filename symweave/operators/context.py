"""Hybrid retrieval: several search channels give scored symbols; the best become roots of a small subgraph.

Channels are DataFrames of (id, score) that are united once.  After the cut to a few roots all caps are ranks within the few rows
that are left.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.paths import dirname, is_test_file
from symweave.functions.words import path_points, search_terms, stems
from symweave.graph import Graph
from symweave.operators.lookups import between
from symweave.operators.search import by_exact_names, search_each
from symweave.operators.textindex import TextIndex
from symweave.operators.traversal import bfs, hierarchy
from symweave.plans.staging import staged

DEFINITIONS = ("class", "interface", "struct", "trait", "protocol", "enum", "type_alias")
SEARCHABLE = ("file", "module", *DEFINITIONS, "function", "method", "property", "field", "variable", "constant", "enum_member", "namespace", "export", "route", "component")
RECOVERED = ("calls", "extends", "implements", "references", "overrides")
# Words of questions that are no symbol names.
COMMON_WORDS = frozenset(
    """the and for with from this that have been will would could should does done make made use used using work works find found show
    call called calling get set add all any how what when where which who why not but are was were has had its can did may also into
    than then them each other some such only same about after before between through during without again further once here there both
    just more most very being having doing system need needs want wants like look change changes changed changing layer handle handles
    handling incoming outgoing data flow flows level levels request requests response responses implement implements implementation
    interface interfaces class classes method methods trigger triggers affected affect affects else code failing failed silently decide
    decides return returns returned take takes taken check checks checked create creates created read reads write writes written start
    starts stop stops run runs running""".split()
)
# What looks like a symbol: camel case, snake case, capitals, dotted names (and their parts), plain words.
SYMBOLS = (
    r"\b(?:[A-Z][a-z]+(?:[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]*)+)\b",
    r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+\b",
    r"\b[A-Z]{2,}\b",
    r"\b[a-zA-Z][a-zA-Z0-9]*(?:\.[a-zA-Z][a-zA-Z0-9]*)+\b",
    r"\b[a-z][a-z0-9]{2,}\b",
)


@dataclass(frozen=True)
class Budget:
    """How much a retrieval may return."""

    roots: int = 3
    depth: int = 1
    nodes: int = 20
    least: float = 0.3


def symbols_in(question: str) -> list[str]:
    found: dict[str, None] = {}
    for pattern in SYMBOLS:
        for word in re.findall(pattern, question):
            if len(word) > 1:
                found[word] = None
            if "." in word:
                found |= {p: None for p in word.split(".") if len(p) > 1}
    return [w for w in found if w.lower() not in COMMON_WORDS]


def about_tests(question: str) -> bool:
    return "test" in question.lower() or "spec" in question.lower()


def colocated(found: DataFrame) -> DataFrame:
    """20 more for every further name of the question that stands in the same file."""
    names = F.size(F.collect_set(F.lower("name")).over(Window.partitionBy("file_path")))
    return found.withColumn("score", F.col("score") + (names - 1) * 20)


def _top(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("score"), "id").limit(n)


def _brief(found: DataFrame) -> DataFrame:
    return found.select("id", "name", "kind", "file_path", "score")


def definitions(nodes: DataFrame, index: TextIndex, symbols: list[str], n: int) -> DataFrame | None:
    """Definitions whose names start like a symbol or one of its stems; short names first, n for each."""
    words = dict.fromkeys([*symbols, *(s for w in symbols for s in stems(w))])
    titles = [t for w in words if (t := w[:1].upper() + w[1:].lower()) != w]
    if not titles:
        return None
    hits = search_each(nodes, index, titles, 30, DEFINITIONS).filter(F.lower("name").startswith(F.lower("asked")))
    brevity = F.greatest(F.lit(0.0), 10 - (F.length("name") - F.length("asked")) / 3)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    return _brief(hits.withColumn("score", F.col("score") + 15 + brevity).withColumn("place", place).filter(F.col("place") <= n))


def by_terms(nodes: DataFrame, index: TextIndex, question: str, n: int) -> DataFrame | None:
    """Each term searched by itself; five more for every further term that finds a symbol."""
    terms = search_terms(question)
    if not terms:
        return None
    out = search_each(nodes, index, terms, 2 * n, SEARCHABLE)
    return _top(out.groupBy("id", "name", "kind", "file_path").agg((F.max("score") + (F.count("*") - 1) * 5).alias("score")), 2 * n)


def merged(*channels: DataFrame | None) -> DataFrame:
    """Each symbol once, with its best score."""
    some = [c for c in channels if c is not None]
    out = some[0]
    for c in some[1:]:
        out = out.unionAll(c)
    return out.groupBy("id", "name", "kind", "file_path").agg(F.max("score").alias("score"))


def term_groups(terms: list[str]) -> list[list[str]]:
    """Terms of which one holds the other are one concept."""
    left, groups = sorted(terms, key=lambda t: (-len(t), terms.index(t))), []
    while left:
        head = left[0]
        group = [t for t in left if t in head or head in t]
        groups.append(group)
        left = [t for t in left if t not in group]
    return groups


def reranked(found: DataFrame, question: str, exact: DataFrame | None) -> DataFrame:
    """Symbols that meet two or more concepts in name or directories gain half as much again for each; others lose, exact names aside."""
    groups = term_groups(search_terms(question))
    if sum(map(len, groups)) < 2:
        return found
    low, folders = F.lower("name"), F.split(F.lower(dirname(F.col("file_path"))), "/")
    met = F.lit(0)
    for group in groups:
        any_of = F.lit(False)
        for t in group:
            any_of |= low.contains(t) | F.array_contains(folders, t)
        met += any_of.cast("int")
    spared = F.lit(False)
    if exact is not None:
        found = found.join(exact.select("id", F.lit(True).alias("spared")).distinct(), "id", "left")
        spared = F.coalesce("spared", F.lit(False))
    score = F.when(met >= 2, F.col("score") * (1 + met * 0.5)).when(spared, F.col("score")).otherwise(F.col("score") * 0.6)
    return found.withColumn("score", score).select("id", "name", "kind", "file_path", "score")


def _pairs(nodes: DataFrame, symbols: list[str]) -> DataFrame | None:
    """(symbol columns, word): definitions that hold a word of the question, as written with a capital."""
    titles = [t for t in dict.fromkeys(w[:1].upper() + w[1:].lower() for w in symbols) if len(t) > 2]
    if not titles:
        return None
    words = F.array(*map(F.lit, titles))
    rows = nodes.filter(F.col("kind").isin(*DEFINITIONS)).select("id", "name", "kind", "file_path", F.explode(words).alias("word"))
    return rows.filter(F.lower("name").contains(F.lower("word")))


def camel_parts(nodes: DataFrame, question: str, symbols: list[str], n: int) -> DataFrame | None:
    """Words that start inside a name at a letter boundary: 8, brevity and path; several words multiply."""
    pairs = _pairs(nodes, symbols)
    if pairs is None:
        return None
    at = F.instr(F.col("name"), F.col("word"))
    pairs = pairs.filter((at > 1) & F.substring("name", at - 1, F.lit(1)).rlike("[a-zA-Z]"))
    if not about_tests(question):
        pairs = pairs.filter(~is_test_file(F.col("file_path")))
    score = 8 + F.greatest(F.lit(0.0), 6 - (F.length("name") - F.length("word")) / 4) + path_points(F.col("file_path"), question)
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("score"), "id"))
    pairs = pairs.withColumn("score", score).withColumn("place", place).filter(F.col("place") <= 4 * math.ceil(n / 2))
    met = F.count("*")
    return _top(pairs.groupBy("id", "name", "kind", "file_path").agg((F.max("score") * (1 + met) + (met - 1) * 30).alias("score")), n)


def compounds(nodes: DataFrame, question: str, symbols: list[str], n: int) -> DataFrame | None:
    """Names that hold two or more words of the question anywhere."""
    pairs = _pairs(nodes, symbols)
    if pairs is None or len(symbols) < 2:
        return None
    if not about_tests(question):
        pairs = pairs.filter(~is_test_file(F.col("file_path")))
    met = pairs.groupBy("id", "name", "kind", "file_path").agg(F.countDistinct("word").alias("met")).filter("met > 1")
    score = 10 + (F.col("met") - 1) * 20 + path_points(F.col("file_path"), question) + F.greatest(F.lit(0.0), 6 - F.length("name") / 8)
    return _top(met.withColumn("score", score).drop("met"), math.ceil(n / 2))


def defined(found: DataFrame, graph: Graph) -> DataFrame:
    """Imports and exports replaced by what they lead to; those that lead nowhere go."""
    through = found.filter(F.col("kind").isin("import", "export"))
    names = graph.nodes.select(F.col("id").alias("target"), F.col("name").alias("n"), F.col("kind").alias("k"), F.col("file_path").alias("p"))
    led = through.join(graph.of_kind("imports", "exports", "references"), F.col("id") == F.col("source")).select("score", "target").join(names, "target").filter(~F.col("k").isin("import", "export"))
    return merged(found.filter(~F.col("kind").isin("import", "export")), led.select(F.col("target").alias("id"), F.col("n").alias("name"), F.col("k").alias("kind"), F.col("p").alias("file_path"), "score"))


def entry_points(graph: Graph, index: TextIndex, question: str, budget: Budget = Budget()) -> DataFrame:
    """(id, name, kind, file_path, score): the symbols a question is about, best first."""
    n, nodes = budget.roots, graph.nodes
    symbols = symbols_in(question)
    exact = None
    if symbols:
        exact = _brief(_top(colocated(by_exact_names(nodes, symbols, 5 * n)), 2 * n))
        more = definitions(nodes, index, symbols, n)
        exact = staged(_top(merged(exact, more), 3 * n), "exact")
    found = merged(exact, by_terms(nodes, index, question, n)) if symbols or search_terms(question) else None
    if found is None:
        return _brief(nodes.limit(0).withColumn("score", F.lit(0.0)))
    if not about_tests(question):
        found = found.withColumn("score", F.when(is_test_file(F.col("file_path")), F.col("score") * 0.3).otherwise(F.col("score")))
    found = staged(reranked(found, question, exact), "merged")
    camel = camel_parts(nodes.join(found.select("id"), "id", "left_anti"), question, symbols, n)
    compound = compounds(nodes.join(found.select("id"), "id", "left_anti"), question, symbols, n)
    best = _top(merged(found, camel, compound), 3 * n).filter(F.col("score") >= budget.least)
    return _top(defined(best, graph), n)


def _capped(found: DataFrame, part: Column, cap: int, order: list[Column], only: Column | None = None) -> DataFrame:
    """At most cap rows of each part, of those that `only` names."""
    counted = F.lit(True) if only is None else only
    place = F.row_number().over(Window.partitionBy(part, counted).orderBy(*order))
    return found.withColumn("cap_place", place).filter(~counted | (F.col("cap_place") <= cap)).drop("cap_place")


def relevant(graph: Graph, index: TextIndex, question: str, budget: Budget = Budget()) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind, file_path, is_root, dist) and edges of the subgraph a question is about.

    Roots, their type hierarchy, and the ball around them in both directions, each root with its share of the nodes.  Then caps: nodes nearest
    to roots first; a fifth of the nodes from one file; 15 in a hundred from files that are no production code.
    """
    roots = staged(entry_points(graph, index, question, budget), "roots")
    n = max(1, roots.count())
    starts = roots.select(F.col("id").alias("root"), "id")
    types = roots.filter(F.col("kind").isin(*DEFINITIONS)).select(F.col("id").alias("root"), "id")
    kin = hierarchy(graph, types).filter("dist > 0").select("id", "dist").groupBy("id").agg(F.min("dist").alias("dist")).orderBy("dist", "id").limit(math.ceil(budget.nodes / 4))
    ball = bfs(graph, starts, budget.depth, direction="both", limit=math.ceil(budget.nodes / n))[0].select("id", "dist")
    near = ball.unionByName(kin).groupBy("id").agg(F.min("dist").alias("dist"))
    facts = graph.nodes.select("id", "name", "kind", "file_path").join(near, "id")
    facts = facts.join(roots.select("id", F.lit(True).alias("is_root")), "id", "left").na.fill(False, ["is_root"])
    rank = [F.desc("is_root"), F.asc("dist"), F.when(F.col("kind").isin(*DEFINITIONS), 0).when(F.col("kind").isin("function", "method"), 1).otherwise(2), F.asc("id")]
    kept = staged(facts.orderBy(*rank).limit(budget.nodes), "kept")
    kept = _capped(kept, F.col("file_path"), max(5, math.ceil(0.2 * budget.nodes)), rank)
    if not about_tests(question):
        kept = _capped(kept, F.lit(0), max(3, math.ceil(0.15 * budget.nodes)), rank, is_test_file(F.col("file_path")) & ~F.col("is_root"))
    kept = staged(kept, "kept")
    return kept, between(graph.edges, kept).select("source", "target", "kind").distinct()


def summary(kept: DataFrame, edges: DataFrame) -> str:
    """One line on a retrieved subgraph: its size, its files and its first entry points."""
    row = kept.agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"), F.count(F.when(F.col("is_root"), 1)).alias("roots")).first()
    names = [r[0] for r in kept.filter("is_root").orderBy("dist", "id").select("name").limit(3).collect()]
    more = f" and {row['roots'] - 3} more" if row["roots"] > 3 else ""
    return f"{row['n']} symbols in {row['files']} files; entry points: {', '.join(names)}{more}; {edges.count()} relationships."


def related_files(kept: DataFrame) -> DataFrame:
    """(file_path): the files of a retrieved subgraph, in order."""
    return kept.select("file_path").distinct().orderBy("file_path")


def code(nodes: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(id, code): the lines of each node out of sources (path, content); cut at `most` letters with a mark."""
    lines = nodes.select("id", "file_path", "start_line", "end_line").join(sources.select(F.col("path").alias("file_path"), "content"), "file_path")
    start = F.greatest("start_line", F.lit(1))
    text = F.array_join(F.slice(F.split("content", "\n"), start, F.greatest(F.col("end_line") - start + 1, F.lit(0))), "\n")
    if most:
        text = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n... (truncated)"))).otherwise(text)
    return lines.select("id", text.alias("code"))


def code_blocks(kept: DataFrame, graph: Graph, sources: DataFrame, blocks: int = 5, most: int = 1500) -> DataFrame:
    """Code of roots, then functions and methods, then classes."""
    order = F.when(F.col("is_root"), 0).when(F.col("kind").isin("function", "method"), 1).when(F.col("kind") == "class", 2)
    chosen = kept.withColumn("turn", order).filter("turn is not null").orderBy("turn", "id").limit(blocks)
    full = graph.nodes.select("id", "start_line", "end_line").join(chosen, "id")
    return full.join(code(full, sources, most), "id").select("id", "name", "kind", "file_path", "start_line", "end_line", "code", "turn")
