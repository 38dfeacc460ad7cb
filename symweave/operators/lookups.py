"""Point lookups, filters and deletions over the graph tables.

All are plain filters and semi or anti joins, so predicates and column choices reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.paths import basename
from symweave.graph import Graph, Links, as_links

#: Kinds that a qualified-name pattern looks among.
QUALIFIED_KINDS = ("class", "function", "method", "interface", "type_alias", "variable", "constant")
#: Kinds that a filtered subgraph looks among.
SUBGRAPH_KINDS = ("file", "module", "class", "struct", "interface", "trait", "function", "method", "variable", "constant", "enum", "type_alias")


def node(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.filter(F.col("id") == node_id)


def in_file(graph: Graph, path: str) -> DataFrame:
    return graph.nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def of_kind(graph: Graph, kind: str) -> DataFrame:
    return graph.nodes.filter(F.col("kind") == kind)


def listed(graph: Graph, limit: int) -> DataFrame:
    return graph.nodes.orderBy("kind", "name", "id").limit(limit)


def listed_edges(graph: Graph, limit: int) -> DataFrame:
    return graph.edges.orderBy("source", "target", "kind", "line").limit(limit)


def named(graph: Graph, name: str, ignore_case: bool = False) -> DataFrame:
    return graph.nodes.filter(F.lower("name") == name.lower() if ignore_case else F.col("name") == name)


def qualified(graph: Graph, name: str) -> DataFrame:
    return graph.nodes.filter(F.col("qualified_name") == name)


def outgoing(graph: Graph, source: str, kinds: Iterable[str] = (), provenance: str | None = None) -> DataFrame:
    found = graph.of_kind(*kinds).filter(F.col("source") == source)
    return found.filter(F.col("provenance") == provenance) if provenance else found


def incoming(graph: Graph, target: str, kinds: Iterable[str] = ()) -> DataFrame:
    return graph.of_kind(*kinds).filter(F.col("target") == target)


def between(edges: DataFrame | Links, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids (column id); repeats of an edge stay."""
    return as_links(edges).among(ids.select("id").distinct(), "source", "target").rows()


def files(graph: Graph) -> DataFrame:
    return graph.files.orderBy("path")


def stale_files(graph: Graph, current: DataFrame) -> DataFrame:
    """Tracked files whose current hash (path, hash) is given, not empty and another one."""
    now = current.select(F.col("path"), F.col("hash"))
    return graph.files.join(now, "path").filter((F.col("hash") != "") & (F.col("hash") != F.col("content_hash"))).drop("hash")


def refs_named(graph: Graph, name: str) -> DataFrame:
    return graph.refs.filter(F.col("reference_name") == name)


def refs_page(graph: Graph, limit: int, offset: int = 0) -> DataFrame:
    return graph.refs.orderBy("ref_id").offset(offset).limit(limit)


def refs_in(graph: Graph, paths: DataFrame) -> DataFrame:
    """References in the files of paths (column path)."""
    return graph.refs.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select(graph.refs.columns)


def without_refs(graph: Graph, gone: DataFrame, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """References but for those that match rows of gone on keys: ref_id, from_node_id, or (from_node_id, reference_name, reference_kind)."""
    return graph.refs.join(gone.select(*keys).distinct(), list(keys), "left_anti").select(graph.refs.columns)


def without_nodes(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without nodes (column id), their edges and their references."""
    gone = gone.select("id").distinct()
    links = graph.links().among(gone, "source", "target", how="left_anti")
    refs = graph.refs and graph.refs.join(gone.select(F.col("id").alias("from_node_id")), "from_node_id", "left_anti").select(graph.refs.columns)
    return Graph.of(graph.nodes.join(gone, "id", "left_anti").select(graph.nodes.columns), links, graph.files, refs)


def without_files(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without files (column path) and all that stands in them."""
    paths = paths.select("path").distinct()
    gone = graph.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    left = without_nodes(graph, gone)
    return Graph.of(left.nodes, left.links(), graph.files and graph.files.join(paths, "path", "left_anti").select(graph.files.columns), left.refs)


def upserted(nodes: DataFrame, changes: DataFrame, order: str = "updated_at") -> DataFrame:
    """nodes with changes: of the rows of an id the last one stays, changes before what was there."""
    both = nodes.withColumn("turn", F.lit(0)).unionByName(changes.select(nodes.columns).withColumn("turn", F.lit(1)))
    last = Window.partitionBy("id").orderBy(F.desc("turn"), F.desc_nulls_last(order), "file_path")
    return both.withColumn("place", F.row_number().over(last)).filter("place = 1").select(nodes.columns)


def exported(graph: Graph, path: str) -> DataFrame:
    return graph.nodes.filter((F.col("file_path") == path) & F.col("is_exported"))


def by_qualified_pattern(graph: Graph, pattern: str) -> DataFrame:
    """* is any text and ? one letter; the whole qualified name must match."""
    regex = "".join({"*": ".*", "?": "."}.get(c) or re.escape(c) for c in pattern)
    return graph.nodes.filter(F.col("kind").isin(*QUALIFIED_KINDS) & F.col("qualified_name").rlike(f"^{regex}$"))


def filtered(graph: Graph, where: Column, with_edges: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes that a predicate takes and, with_edges, the edges among them."""
    nodes = graph.nodes.filter(F.col("kind").isin(*SUBGRAPH_KINDS) & where)
    return nodes, between(graph.links(), nodes) if with_edges else graph.edges.limit(0)


def matches_symbol(symbol: str) -> Column:
    """Whether a node is meant by a plain, dotted, coloned or slashed symbol.

    The last part names the node.  The parts before it stand in its qualified name, or each is a part of its path, with or without its
    extension; crate, super and self stand for nothing.  A file is also meant by its name without extension.
    """
    path = F.col("file_path")
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    direct = (F.col("name") == symbol) | ((F.col("kind") == "file") & (stem == symbol))
    parts = [p for p in re.split(r"\.|::|/", symbol) if p]
    if len(parts) < 2:
        return direct
    segments = F.split(path, "/")
    hints = F.lit(True)
    kept = [h for h in parts[:-1] if h not in ("crate", "super", "self")]
    plain = F.transform(segments, lambda s: F.regexp_replace(s, r"\.[^.]*$", ""))
    for h in kept:
        hints &= F.array_contains(segments, h) | F.array_contains(plain, h)
    if not kept:
        hints = F.lit(False)
    inside = F.col("qualified_name").contains("::".join(parts)) | hints
    return direct | ((F.col("name") == parts[-1]) & inside)


def best_match(found: DataFrame, symbol: str) -> DataFrame:
    """The one row that fits a symbol best: by name, by qualified name, by its end, then the first line."""
    end = F.col("qualified_name").endswith(symbol)
    return found.orderBy(F.col("name") != symbol, F.col("qualified_name") != symbol, ~end, "start_line", "id").limit(1)
