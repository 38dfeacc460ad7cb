"""Walks over the graph: balls, callers and callees, impact, paths, ancestors and hierarchies.

Every walk is a frontier loop over many roots at once; results are sets or bags that do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.graph import Graph, Links
from symweave.operators.lookups import between
from symweave.plans.fixpoint import Steps, layered_reach, reach, ways
from symweave.plans.staging import staged
from symweave.schema import CONTAINERS

CALLS = ("calls", "references", "imports")


def roots_of(graph: Graph, ids: Iterable[str]) -> DataFrame:
    """(root, id) of the given nodes that exist."""
    return graph.nodes.filter(F.col("id").isin(list(ids))).select(F.col("id").alias("root"), "id")


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(a, b) and the edge's columns: steps along edges, against them, or both."""
    out = edges.withColumns({"a": F.col("source"), "b": F.col("target")})
    back = edges.withColumns({"a": F.col("target"), "b": F.col("source")})
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def steps_along(links: Links, direction: str = "out", known: DataFrame | None = None) -> Steps:
    """Steps along edges, against them, or both; with known (column id) only those that end in such a node."""

    def ending(df: DataFrame) -> DataFrame:
        return df if known is None else df.join(known.select(F.col("id").alias("b")), "b", "left_semi").select(df.columns)

    through = []
    if links.heads is not None:
        heads, tails = links.heads.select("bundle", "source"), links.tails.select("bundle", "target")
        for way, a, b in (("out", heads, tails), ("in", tails, heads)):
            if direction in (way, "both"):
                through.append((a.toDF("bundle", "a"), ending(b.toDF("bundle", "b"))))
    return Steps(ending(adjacency(links.single, direction).select("a", "b")), tuple(through))


def bfs(graph: Graph, roots: DataFrame, depth: int | None = None, kinds: Iterable[str] = (), node_kinds: Iterable[str] = (), direction: str = "out", limit: int | None = None, with_root: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, id, dist) of the ball around each root, and the edges (root, source, target, kind) that join it.

    node_kinds lets only such nodes in, the roots aside.  With a limit, the nodes nearest to a root come first, then by id; an edge joins where both
    of its ends did.
    """
    known = graph.nodes.select("id", "kind")
    if node_kinds := list(node_kinds):
        known = known.filter(F.col("kind").isin(node_kinds))
    found = reach(roots, steps_along(graph.links(*kinds), direction, known), depth)
    if not with_root:
        found = found.filter("id <> root")
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("root").orderBy("dist", "id"))
        found = staged(found.withColumn("place", place).filter(F.col("place") <= limit).drop("place"), "ball")
    return found, graph.links(*kinds).within(found).select("root", "source", "target", "kind")


def dfs(graph: Graph, roots: DataFrame, depth: int = 3, kinds: Iterable[str] = (), node_kinds: Iterable[str] = (), direction: str = "out", limit: int = 1000) -> DataFrame:
    """(root, id, dist, place): the nodes of bfs() with the same arguments in depth-first order, neighbours by id; dist counts the steps of the walk.

    The walk of a root is one task's work, over `limit` nodes at most.
    """
    found, edges = bfs(graph, roots, depth, kinds, node_kinds, direction, limit)
    steps = adjacency(edges, direction).filter("a <> b").select("root", "a", "b").distinct()
    steps = found.select("root", F.lit(None).cast("string").alias("a"), F.col("id").alias("b")).filter("root = b").unionByName(steps)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in sorted(zip(pdf["a"].fillna(""), pdf["b"]), reverse=True):
            near.setdefault(a, []).append(b)
        rows, seen, stack = [], set(), [(pdf["root"].iloc[0], 0)]
        while stack:
            at, dist = stack.pop()
            if at not in seen:
                seen.add(at)
                rows.append((pdf["root"].iloc[0], at, dist, len(rows) + 1))
                stack += [(b, dist + 1) for b in near.get(at, ())]
        return pd.DataFrame(rows, columns=["root", "id", "dist", "place"])

    return steps.groupBy("root").applyInPandas(walk, "root string, id string, dist int, place int")


def _called(graph: Graph, roots: DataFrame, depth: int, kinds: Iterable[str], direction: str) -> DataFrame:
    """Edges whose near end is within depth - 1 steps of a root; loops are left out, repeated edges stay."""
    links = graph.links(*kinds)
    near = reach(roots, steps_along(links, direction), depth - 1) if depth > 1 else roots.select("root", "id", F.lit(0).alias("dist"))
    found = links.touching(near, "source" if direction == "out" else "target").filter("source <> target")
    return found.select("root", "source", "target", "kind", "line", (F.col("dist") + 1).alias("depth"))


def callers(graph: Graph, roots: DataFrame, depth: int = 1, kinds: Iterable[str] = CALLS) -> DataFrame:
    """One row an edge: (root, source, target, kind, line, depth)."""
    return _called(graph, roots, depth, kinds, "in")


def callees(graph: Graph, roots: DataFrame, depth: int = 1, kinds: Iterable[str] = CALLS) -> DataFrame:
    return _called(graph, roots, depth, kinds, "out")


def call_graph(graph: Graph, roots: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, id) and edges of the roots, their callers and their callees."""
    edges = callers(graph, roots, depth).unionByName(callees(graph, roots, depth)).select("root", "source", "target", "kind", "line").distinct()
    ends = edges.select("root", F.explode(F.array("source", "target")).alias("id"))
    return roots.select("root", "id").union(ends).distinct(), edges


def hierarchy(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, id, dist, role): ancestors and descendants over extends and implements, each with distances of their own."""
    edges = graph.of_kind("extends", "implements")
    up = reach(roots, adjacency(edges, "out")).withColumn("role", F.when(F.col("dist") == 0, "focal").otherwise("ancestor"))
    down = reach(roots, adjacency(edges, "in")).filter("dist > 0").withColumn("role", F.lit("descendant"))
    return up.unionByName(down)


def usages(graph: Graph, roots: DataFrame) -> DataFrame:
    """All edges into the roots with the kind and name of where they start."""
    sources = graph.nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
    return graph.links().touching(roots.select("root", "id"), "target").select("root", "source", "kind", "line").join(sources, "source").select("root", "source", "source_name", "source_kind", "kind", "line")


def impact(graph: Graph, roots: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes (root, id, dist) that a change of the roots may touch, and the edges among them.

    An edge into a node costs one step.  The members of a container cost none, as long as it is nearer than `depth`.
    """
    paid = steps_along(graph.links(), "in", graph.nodes)
    holders = graph.nodes.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("id").alias("a"))
    free = adjacency(graph.of_kind("contains"), "out").select("a", "b").join(holders, "a", "left_semi").join(graph.nodes.select(F.col("id").alias("b")), "b", "left_semi")
    found = layered_reach(roots, paid, free, depth)
    return found, graph.links().within(found).select("root", "source", "target", "kind", "line")


def merged_impact(graph: Graph, roots: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """Impact of several symbols of one name as one: each node at its least distance, each edge once."""
    nodes, edges = impact(graph, roots, depth)
    return nodes.groupBy("id").agg(F.min("dist").alias("dist")), edges.select("source", "target", "kind").distinct()


def path(graph: Graph, start: str, goal: str, kinds: Iterable[str] = (), most: int | None = None) -> DataFrame:
    """(step, id): a shortest path along edges, of such paths the one with the smallest ids first; no rows where there is none."""
    ends = roots_of(graph, [goal]).join(F.broadcast(roots_of(graph, [start]).select(F.lit(True).alias("there"))), how="left_semi")
    if start == goal:
        return ends.select(F.lit(0).alias("step"), "id")
    steps = steps_along(graph.links(*kinds))
    return ways(ends, steps, F.col("id") == start, most).select(F.posexplode("way").alias("step", "id"))


def ancestors(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, id, dist): up the containment edges; a node in several containers belongs to the smallest id."""
    first = graph.of_kind("contains").groupBy(F.col("target").alias("a")).agg(F.min("source").alias("b"))
    return reach(roots, first).filter("dist > 0")


def children(graph: Graph, roots: DataFrame) -> DataFrame:
    """(root, id): what the roots contain."""
    held = graph.of_kind("contains")
    return roots.join(held, F.col("id") == F.col("source")).select("root", F.col("target").alias("id"))


def induced(graph: Graph, ids: DataFrame, kinds: Iterable[str] = ()) -> DataFrame:
    return between(graph.links(*kinds), ids)


def only_nodes(graph: Graph, where: Column) -> DataFrame:
    return graph.nodes.filter(where)
