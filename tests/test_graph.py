"""Graph operators against plain Python on random multigraphs with cycles, loops, repeated edges and dangling ids."""

import random

import pytest
from pyspark.sql import functions as F

from symweave.graph import Graph
from symweave.operators import analytics, lookups, traversal
from symweave.plans.fixpoint import strong_components
from symweave.schema import CONTAINERS, EDGES, FILES, NODES, conform

KINDS = ("contains", "calls", "references", "imports", "extends")


def made(seed):
    rng = random.Random(seed)
    kinds = ("class", "function", "method", "file", "module", "route")
    nodes = [(f"n{i}", rng.choice(kinds), f"name{i % 7}", f"q{i}", f"src/d{i % 4}/f{i % 9}.ts", "typescript", rng.randrange(100), bool(i % 2)) for i in range(40)]
    ids = [n[0] for n in nodes] + ["gone1", "gone2"]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(KINDS), rng.randrange(3)) for _ in range(75)]
    return nodes, edges + edges[:6] + [("n1", "n1", "calls", 1)]


@pytest.fixture(scope="module", params=[1, 2])
def both(spark, request):
    nodes, edges = made(request.param)
    n = spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean")
    e = spark.createDataFrame(edges, "source string, target string, kind string, line int")
    files = n.select(F.col("file_path").alias("path"), "language").distinct()
    return nodes, edges, Graph(conform(n, NODES).cache(), conform(e, EDGES).cache(), conform(files, FILES).cache())


def ball(start, steps, depth):
    dist, layer = {start: 0}, [start]
    for d in range(1, depth + 1):
        layer = {b for a in layer for x, b in steps if x == a and b not in dist}
        dist |= dict.fromkeys(layer, d)
    return dist


def test_balls_callers_and_callees(both):
    nodes, edges, g = both
    known = {n[0] for n in nodes}
    roots = traversal.roots_of(g, ["n1", "n2", "n3"])
    found, joined = traversal.bfs(g, roots, 3, direction="both")
    steps = [(a, b) for a, b, *_ in edges if b in known] + [(b, a) for a, b, *_ in edges if a in known]
    want = {(r, i, d) for r in ("n1", "n2", "n3") for i, d in ball(r, steps, 3).items()}
    assert {tuple(x) for x in found.collect()} == want
    assert joined.filter("root = 'n1'").count() == sum((("n1", a) in {w[:2] for w in want}) and (("n1", b) in {w[:2] for w in want}) for a, b, *_ in edges)
    for depth in (1, 3):
        got = sorted(map(tuple, traversal.callers(g, roots, depth).select("root", "source", "target", "kind", "line").collect()))
        back = [(b, a) for a, b, k, _ in edges if k in traversal.CALLS and a != b]
        near = {r: ball(r, back, depth - 1) for r in ("n1", "n2", "n3")}
        assert got == sorted((r, a, b, k, line) for r in near for a, b, k, line in edges if k in traversal.CALLS and a != b and b in near[r])


def test_impact_is_a_layered_distance(both):
    nodes, edges, g = both
    kind = {n[0]: n[1] for n in nodes}
    for depth in (1, 2, 3):
        got = {(r.root, r.id): r.dist for r in traversal.impact(g, traversal.roots_of(g, list(kind)[:6]), depth)[0].collect()}
        want = {}
        for root in list(kind)[:6]:
            dist, todo = {root: 0}, [root]
            while todo:
                at = todo.pop(0)
                options = [(a, 1) for a, b, *_ in edges if b == at and a != at and a in kind and dist[at] < depth]
                options += [(b, 0) for a, b, k, _ in edges if a == at and k == "contains" and kind[at] in CONTAINERS and dist[at] < depth and b in kind]
                for to, cost in options:
                    if dist[at] + cost < dist.get(to, 99):
                        dist[to] = dist[at] + cost
                        todo.append(to)
            want |= {(root, i): d for i, d in dist.items()}
        assert got == want


def test_shortest_paths(both):
    nodes, edges, g = both
    known = {n[0] for n in nodes}
    steps = [(a, b) for a, b, *_ in edges if a != b]
    for start, goal in (("n1", "n7"), ("n3", "n20"), ("n5", "n5"), ("n8", "nowhere")):
        got = [r.id for r in traversal.path(g, start, goal).orderBy("step").collect()]
        best, layer = None, [[start]]
        while layer and best is None and goal in known:
            ends = [p for p in layer if p[-1] == goal]
            best = min(ends) if ends else None
            seen = {x for p in layer for x in p}
            layer = [p + [b] for p in layer for a, b in set(steps) if a == p[-1] and b not in seen][:5000]
        assert got == (best or [])


def test_cycles_are_strong_components(both, spark):
    _, edges, _ = both
    steps = {(a, b) for a, b, *_ in edges if a != b}
    reach = {a: set(ball(a, steps, 99)) for a in {x for s in steps for x in s}}
    want = {}
    for a in reach:
        mutual = {b for b in reach if b in reach[a] and a in reach[b]}
        if len(mutual) > 1:
            want[a] = min(mutual)
    got = {r.id: r.component for r in strong_components(spark.createDataFrame(sorted(steps), "a string, b string")).collect()}
    assert got == want
    assert strong_components(spark.createDataFrame([("a", "b")], "a string, b string")).count() == 0


def test_unused_and_deletions(both):
    nodes, edges, g = both
    into = lambda *kinds: {b for _, b, k, _ in edges if k in kinds}
    assert {r.id for r in analytics.dead_code(g).collect()} == {n[0] for n in nodes if n[1] in ("function", "method", "class") and not n[7]} - into("calls", "references", "imports", "extends")
    assert {r.id for r in analytics.unused(g).collect()} == {n[0] for n in nodes if n[1] not in ("file", "module", "route")} - into("calls", "references", "imports")
    assert {r.id for r in analytics.dead_routes(g).collect()} == {n[0] for n in nodes if n[1] == "route"} - into(*KINDS)
    left = lookups.without_nodes(g, g.nodes.filter("kind = 'class'"))
    gone = {n[0] for n in nodes if n[1] == "class"}
    assert sorted((r.source, r.target) for r in left.edges.collect()) == sorted((a, b) for a, b, *_ in edges if a not in gone and b not in gone)


def test_hierarchy_goes_both_ways(both):
    nodes, edges, g = both
    up = [(a, b) for a, b, k, _ in edges if k == "extends"]
    got = {(r.id, r.dist, r.role) for r in traversal.hierarchy(g, traversal.roots_of(g, ["n4"])).collect()}
    want = {(i, d, "ancestor" if d else "focal") for i, d in ball("n4", up, 99).items()} | {(i, d, "descendant") for i, d in ball("n4", [(b, a) for a, b in up], 99).items() if d}
    assert got == want
