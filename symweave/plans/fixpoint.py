"""Loops over a frontier: every round is one join with the edges and one anti-join with what has been seen.

Frontiers are written to the shared folder, so plans stay short.  Nothing is collected but counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.graph import met
from symweave.plans.staging import staged


@dataclass(frozen=True)
class Steps:
    """Steps (a, b), and steps through bundles: pairs of tables (bundle, a) and (bundle, b), from each a of a bundle to each of its b.

    No node is an a and a b of one bundle.  A round goes once through a bundle for each root, however many of its a the root has come to.
    """

    single: DataFrame
    through: tuple[tuple[DataFrame, DataFrame], ...] = ()


def as_steps(steps: DataFrame | Steps) -> Steps:
    return steps if isinstance(steps, Steps) else Steps(steps)


def _onward(going: DataFrame, steps: Steps) -> DataFrame:
    """(root, id): where one step leads from going (root, id); each once."""
    single = steps.single.select("a", "b").filter("a <> b")
    found = going.join(single, going["id"] == single["a"]).select("root", F.col("b").alias("id"))
    for into, out in steps.through:
        entered = going.join(into, going["id"] == into["a"]).select("root", "bundle").distinct()
        found = found.unionAll(met(entered, out.select("bundle", "b")).select("root", F.col("b").alias("id")))
    return found.distinct()


#: Rounds after which what was seen is written as one table again.
ROUNDS = 8


def reach(starts: DataFrame, steps: DataFrame | Steps, depth: int | None = None, stops: Column | None = None) -> DataFrame:
    """(root, id, dist): everything within `depth` steps of each root.

    starts: (root, id).  steps: (a, b), one row a possible step, or Steps; repeats do no harm.  stops: over root and id; such nodes are
    found but not gone on from.  Nodes enter at their smallest distance.
    """
    steps = as_steps(steps)
    frontier = staged(starts.select("root", "id", F.lit(0).alias("dist")).distinct(), "reach")
    parts, dist = [frontier], 0
    while depth is None or dist < depth:
        dist += 1
        seen = _union(parts)
        going = frontier if stops is None or dist == 1 else frontier.filter(~stops)
        new = _onward(going, steps)
        new = staged(new.join(seen, ["root", "id"], "left_anti").withColumn("dist", F.lit(dist)), "reach")
        if new.isEmpty():
            break
        parts, frontier = [*parts, new], new
        if len(parts) > ROUNDS:
            parts = [staged(_union(parts[:-1]), "reach", replaces=tuple(parts[:-1])), new]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def ways(goals: DataFrame, steps: DataFrame | Steps, start: Column, depth: int | None = None) -> DataFrame:
    """(root, way): for each root whose start reaches its goal a shortest way of ids from start to goal, of such ways the one with the smallest ids first.

    goals: (root, id).  start: over root and id, looked at from the first step on.  The walk goes back from the goals; a root whose start is met is
    not gone on with, and the walk ends when none is left.  Every node keeps the smallest node after it, so ways are put together from the layers.
    """
    steps = as_steps(steps)
    single = steps.single.select("a", "b").filter("a <> b")
    layer = staged(goals.select("root", "id").distinct(), "way")
    layers: list[DataFrame] = []
    while depth is None or len(layers) < depth:
        new = layer.join(single, layer["id"] == single["b"]).select("root", "a", "id")
        for into, out in steps.through:  # all a of a bundle have the same smallest node after them
            left = layer.join(out, layer["id"] == out["b"]).groupBy("root", "bundle").agg(F.min("id").alias("id"))
            new = new.unionAll(met(left, into.select("bundle", "a")).select("root", "a", "id"))
        new = new.groupBy("root", "a").agg(F.min("id").alias("after")).withColumnRenamed("a", "id")
        if layers:
            new = new.join(_union([x.select("root", "id") for x in layers]), ["root", "id"], "left_anti")
        new = staged(new.select("root", "id", "after", start.alias("met")), "way")
        layers.append(new)
        layer = new.join(new.filter("met").select("root").distinct(), "root", "left_anti").select("root", "id")
        if layer.isEmpty():
            break
    found = goals.select("root", F.array("id").alias("way"), F.col("id").alias("at")).limit(0)
    for new in reversed(layers):
        # Ways that started further off have come to this layer; those that start here join them.
        found = found.join(new.select("root", F.col("id").alias("at"), "after"), ["root", "at"]).select("root", F.concat("way", F.array("after")).alias("way"), F.col("after").alias("at"))
        found = found.unionByName(new.filter("met").select("root", F.array("id", "after").alias("way"), F.col("after").alias("at")))
    return found.select("root", "way")


def layered_reach(starts: DataFrame, paid: DataFrame | Steps, free: DataFrame, depth: int) -> DataFrame:
    """(root, id, dist) where steps of `paid` cost one and steps of `free` nothing; free steps are taken only from nodes nearer than `depth`."""
    seen = staged(starts.select("root", "id", F.lit(0).alias("dist")).distinct(), "layer")
    layer = seen
    for dist in range(depth):
        edge = layer
        while True:  # the nodes that free steps add to this layer
            new = edge.join(free, edge["id"] == free["a"]).select("root", F.col("b").alias("id")).distinct()
            new = staged(new.join(seen, ["root", "id"], "left_anti").withColumn("dist", F.lit(dist)), "layer")
            if new.isEmpty():
                break
            seen, layer, edge = seen.unionAll(new), layer.unionAll(new), new
        new = _onward(layer, as_steps(paid))
        layer = staged(new.join(seen, ["root", "id"], "left_anti").withColumn("dist", F.lit(dist + 1)), "layer")
        if layer.isEmpty():
            break
        seen = seen.unionAll(layer)
    return seen


def strong_components(steps: DataFrame) -> DataFrame:
    """(id, component): nodes on cycles with the smallest node of their strongly connected component.

    Nodes without a way in or out are trimmed.  Then every node takes the smallest node that leads to it as its colour; the nodes
    of a colour that lead back to it form a component, which leaves the graph; and so on.
    """
    steps = staged(steps.select("a", "b").filter("a <> b").distinct(), "scc")
    found: DataFrame | None = None
    while True:
        while True:
            size = steps.count()
            kept = steps.join(steps.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(steps.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
            steps = staged(kept.select("a", "b"), "scc")
            if steps.count() == size:
                break
        if not size:
            break
        colour = staged(steps.select(F.col("a").alias("id")).distinct().withColumn("colour", F.col("id")), "colour")
        while True:
            offers = colour.join(steps, colour["id"] == steps["a"]).groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("offer"))
            after = staged(colour.join(offers, "id", "left").select("id", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")), "colour")
            colour = after.select("id", "colour")
            if after.filter("moved").isEmpty():
                break
        back = steps.join(colour.withColumnsRenamed({"id": "a", "colour": "ca"}), "a").join(colour.withColumnsRenamed({"id": "b", "colour": "cb"}), "b").filter("ca = cb").select(F.col("b").alias("a"), F.col("a").alias("b"))
        roots = colour.filter("id = colour").select(F.col("colour").alias("root"), "id")
        own = reach(roots, back).select("id", F.col("root").alias("component"))
        found = own if found is None else found.unionAll(own)
        steps = staged(steps.join(own.select(F.col("id").alias("a")), "a", "left_anti").join(own.select(F.col("id").alias("b")), "b", "left_anti"), "scc")
    if found is None:
        return steps.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    many = found.groupBy("component").count().filter("count > 1").select("component")
    return found.join(many, "component", "left_semi").select("id", "component")
