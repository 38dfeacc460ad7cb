"""Whole-graph questions: context, file dependencies, cycles, metrics, dead code, affected tests, statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import dirname, is_affected_test
from symweave.graph import Graph, Links
from symweave.operators.traversal import ancestors, children
from symweave.plans.fixpoint import reach, strong_components, ways
from symweave.plans.staging import staged

#: Kinds that are never reported as unused.
STRUCTURAL = ("file", "module", "import", "export", "route")
USES = ("calls", "references", "imports", "instantiates", "decorates")


def context(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, role, id): the node itself, ancestors, children, where references come from and go to, its types, its file's imports."""

    def ends(df: DataFrame, role: str, ident: str = "id") -> DataFrame:
        return df.select("root", F.lit(role).alias("role"), F.col(ident).alias("id"))

    other, at = graph.links().where("kind <> 'contains'"), roots.select("root", "id")
    here = roots.join(graph.nodes.select("id", "file_path"), "id")
    files = graph.nodes.filter("kind = 'file'").select(F.col("id").alias("file"), "file_path")
    imports = here.join(files, "file_path").join(graph.of_kind("imports"), F.col("file") == F.col("source")).select("root", F.col("target").alias("id"))
    parts = [
        ends(roots, "focal"),
        ends(ancestors(graph, roots), "ancestor"),
        ends(children(graph, roots), "child"),
        ends(other.touching(at, "target").select("root", F.col("source").alias("end")), "incoming", "end"),
        ends(other.touching(at, "source").select("root", F.col("target").alias("end")), "outgoing", "end"),
        ends(roots.join(graph.of_kind("type_of", "returns"), F.col("id") == F.col("source")).select("root", F.col("target").alias("end")), "type", "end"),
        ends(imports, "import"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def file_dependencies(graph: Graph) -> DataFrame:
    """(path, depends_on): files whose imports, from the file node or from what stands in it, lead to another file; each pair once."""
    at = graph.nodes.select("id", "file_path")
    pairs = graph.of_kind("imports").join(at.withColumnsRenamed({"id": "source", "file_path": "path"}), "source").join(at.withColumnsRenamed({"id": "target", "file_path": "depends_on"}), "target")
    return pairs.filter("path <> depends_on").select("path", "depends_on").distinct()


def file_dependents(graph: Graph, path: str) -> DataFrame:
    """Files that import the file or one of its exported symbols."""
    targets = graph.nodes.filter((F.col("file_path") == path) & ((F.col("kind") == "file") | F.col("is_exported"))).select(F.col("id").alias("target"))
    sources = graph.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("path"))
    return graph.of_kind("imports").join(targets, "target", "left_semi").join(sources, "source").filter(F.col("path") != path).select("path").distinct()


def module_structure(graph: Graph) -> DataFrame:
    """(directory, files): files by directory, in order."""
    return graph.files.groupBy(dirname(F.col("path")).alias("directory")).agg(F.sort_array(F.collect_list("path")).alias("files"))


def cycles(graph: Graph) -> DataFrame:
    """(path, component): files on import cycles, by the smallest file of their strongly connected component."""
    deps = file_dependencies(graph)
    return strong_components(deps.select(F.col("path").alias("a"), F.col("depends_on").alias("b"))).select(F.col("id").alias("path"), "component")


def cycle_lists(graph: Graph) -> DataFrame:
    """(component, files): one import cycle of each strongly connected component, a shortest one through its smallest file, from which it is listed."""
    inside = staged(cycles(graph), "cycles")
    deps = file_dependencies(graph).join(inside.select("path", "component"), "path").join(inside.select(F.col("path").alias("depends_on"), F.col("component").alias("other")), "depends_on")
    steps = deps.filter("component = other").select(F.col("path").alias("a"), F.col("depends_on").alias("b"))
    ends = inside.select(F.col("component").alias("root"), F.col("component").alias("id")).distinct()
    found = ways(ends, steps, F.col("id") == F.col("root"))
    return found.select(F.col("root").alias("component"), F.slice("way", 1, F.size("way") - 1).alias("files"))


def metrics(graph: Graph, roots: DataFrame) -> DataFrame:
    """incoming, outgoing, calls, callers, children and depth of every root."""

    def counted(key: str, **counts: Column) -> DataFrame:
        near = graph.links().degrees(key).join(roots.select("root", "id"), "id")
        return near.groupBy("root").agg(*[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(n) for n, c in counts.items()])

    into = counted("target", incoming=F.lit(True), callers=F.col("kind") == "calls")
    out = counted("source", outgoing=F.lit(True), calls=F.col("kind") == "calls", children=F.col("kind") == "contains")
    deep = ancestors(graph, roots).groupBy("root").agg(F.count("*").alias("depth"))
    return roots.select("root").join(into, "root", "left").join(out, "root", "left").join(deep, "root", "left").na.fill(0)


def _without(nodes: DataFrame, links: Links, end: str = "target") -> DataFrame:
    return nodes.join(links.ends(end), "id", "left_anti").select(nodes.columns)


def dead_code(graph: Graph, kinds: Iterable[str] = ("function", "method", "class")) -> DataFrame:
    """Not exported and used by nothing but its container."""
    nodes = graph.nodes.filter(F.col("kind").isin(list(kinds)) & ~F.coalesce("is_exported", F.lit(False)))
    return _without(nodes, graph.links().where("kind <> 'contains'"))


def unused(graph: Graph) -> DataFrame:
    """Symbols that no call, reference, import, instantiation or decoration leads to."""
    return _without(graph.nodes.filter(~F.col("kind").isin(*STRUCTURAL)), graph.links(*USES))


def unreferenced(graph: Graph) -> DataFrame:
    """Symbols that are not exported and that no edge at all leads to."""
    nodes = graph.nodes.filter(~F.col("kind").isin(*STRUCTURAL) & ~F.coalesce("is_exported", F.lit(False)))
    return _without(nodes, graph.links())


def orphan_files(graph: Graph) -> DataFrame:
    imports = graph.links("imports")
    return _without(_without(graph.nodes.filter("kind = 'file'"), imports), imports, "source")


def dead_routes(graph: Graph) -> DataFrame:
    return _without(graph.nodes.filter("kind = 'route'"), graph.links())


def affected(graph: Graph, changed: DataFrame, depth: int = 5, pattern: str | None = None) -> DataFrame:
    """(path, is_test): all files that changed ones (column path) reach through dependents; tests are ends of the walk."""
    deps = file_dependencies(graph)
    steps = deps.select(F.col("depends_on").alias("a"), F.col("path").alias("b"))
    test = is_affected_test(F.col("id"), pattern)
    starts = changed.select(F.lit("all").alias("root"), F.col("path").alias("id")).distinct()
    # A changed test is reported and not gone on from.
    going = starts.filter(~test)
    found = reach(going, steps, depth, test).select("id").unionAll(starts.filter(test).select("id")).distinct()
    return found.select(F.col("id").alias("path"), test.alias("is_test"))


def statistics(graph: Graph) -> DataFrame:
    """(measure, value, n): totals, nodes and edges by kind, files by language; one pass a table."""
    nodes = graph.nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("nodes_by_kind").alias("measure"), F.col("kind").alias("value"), "n")
    edges = graph.edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edges_by_kind").alias("measure"), F.col("kind").alias("value"), "n")
    files = graph.files.groupBy("language").agg(F.count("*").alias("n")).select(F.lit("files_by_language").alias("measure"), F.col("language").alias("value"), "n")
    parts = nodes.unionAll(edges).unionAll(files)
    totals = parts.groupBy(F.substring_index("measure", "_", 1).alias("value")).agg(F.sum("n").cast("long").alias("n")).select(F.lit("total").alias("measure"), "value", "n")
    return parts.unionAll(totals)
