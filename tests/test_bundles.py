"""Operators on bundles of edges give what they give on the same edges written out, and do not write the bundles out on their way."""

import random

import pytest
from pyspark.sql import functions as F

from symweave import catalog
from symweave.graph import Graph, Links
from symweave.operators import analytics, explore, lookups, traversal
from symweave.schema import EDGES, FILES, NODES, conform
from symweave.sources import driver_tables
from symweave.streaming import changes


@pytest.fixture(scope="module", params=[3, 4])
def graphs(spark, request):
    rng = random.Random(request.param)
    kinds = ("class", "function", "method", "file", "module")
    nodes = [(f"n{i:02}", rng.choice(kinds), f"name{i % 7}", f"q{i}", f"src/d{i % 4}/f{i % 9}.ts", "typescript", rng.randrange(100), bool(i % 2)) for i in range(40)]
    ids = [n[0] for n in nodes]
    heads = [(i % 3, ids[i], "references", 0) for i in range(10)] + [(0, "gone1", "references", 0)]
    tails = [(i % 3, ids[i]) for i in range(10, 30)] + [(1, "gone2"), (2, "n12")] + [(7, "n39")]
    tails = [t for n, t in enumerate(tails) if t not in tails[:n]]
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(("contains", "calls", "imports", "references")), rng.randrange(2)) for _ in range(60)]
    edges += edges[:5] + [("n00", "n12", "references", 0), ("n01", "n01", "calls", 1)]
    n = conform(spark.createDataFrame(nodes, "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"), NODES).cache()
    e = conform(spark.createDataFrame(edges, "source string, target string, kind string, line int"), EDGES).cache()
    h = spark.createDataFrame(heads, "bundle long, source string, kind string, line int")
    h = h.select("bundle", *[F.col(f.name) if f.name in h.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EDGES.fields if f.name != "target"]).cache()
    links = Links(e, h, spark.createDataFrame(tails, "bundle long, target string").cache(), ("references",))
    files = conform(n.select(F.col("file_path").alias("path"), "language").distinct(), FILES).cache()
    out = links.rows().cache()
    assert out.count() == len(edges) + sum(b == c for b, *_ in heads for c, _ in tails)
    return Graph.of(n, links, files), Graph(n, out, files)


def same(a, b):
    assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect()))


SHORT = ["source", "target", "kind", "line"]
CASES = {
    "balls": lambda g: traversal.bfs(g, traversal.roots_of(g, ["n01", "n15"]), 3)[0],
    "balls both ways": lambda g: traversal.bfs(g, traversal.roots_of(g, ["n01", "n15"]), 2, ("references",), direction="both")[0],
    "edges of balls": lambda g: traversal.bfs(g, traversal.roots_of(g, ["n01", "n15", "n20"]), 2)[1],
    "callers": lambda g: traversal.callers(g, traversal.roots_of(g, ["n12", "n15"]), 2),
    "callees": lambda g: traversal.callees(g, traversal.roots_of(g, ["n01", "n35"]), 3),
    "usages": lambda g: traversal.usages(g, traversal.roots_of(g, ["n12", "n20"])),
    "impact": lambda g: traversal.impact(g, traversal.roots_of(g, ["n12", "n30"]), 2)[0],
    "edges of an impact": lambda g: traversal.impact(g, traversal.roots_of(g, ["n12", "n30"]), 1)[1],
    "path": lambda g: traversal.path(g, "n02", "n29", ("references", "calls")),
    "metrics": lambda g: analytics.metrics(g, g.nodes.select(F.col("id").alias("root"), "id")),
    "context": lambda g: analytics.context(g, traversal.roots_of(g, ["n03", "n12"])),
    "dead code": analytics.dead_code,
    "unused": analytics.unused,
    "unreferenced": analytics.unreferenced,
    "between": lambda g: lookups.between(g.links(), g.nodes.filter("start_line < 60")).select(SHORT),
    "without nodes": lambda g: lookups.without_nodes(g, g.nodes.filter("kind = 'class'")).edges.select(SHORT),
    "without files": lambda g: lookups.without_files(g, g.files.filter("path like '%f3%'")).edges.select(SHORT),
    "synced": lambda g: changes.synced(g, g, g.files.select("path", F.when(F.col("path") < "src/d1", "removed").otherwise("modified").alias("change")).filter("path < 'src/d3'")).edges.select(SHORT),
    "scores": lambda g: explore.file_scores(g.nodes.withColumn("is_root", F.expr("id like '%5'")), g.links("calls", "references")),
    "relationships": lambda g: explore.relationships(g.links(), g.nodes, 3),
    "distinct": lambda g: g.links().distinct(*SHORT).rows(),
    "conditions": lambda g: g.links().where("kind <> 'contains' and source > 'n03'").rows().select(SHORT),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_bundles_are_their_edges(graphs, name):
    bundled, plain = graphs
    same(CASES[name](bundled), CASES[name](plain))


def test_driver_edges_come_as_bundles(spark):
    """References grow with the product of suppliers and customers, their bundles with the sum."""
    links = driver_tables.links(spark, "/root/testdata/sf0.1")
    pairs = links.rows().filter("kind = 'references'").count()
    assert pairs > 3 * (links.heads.count() + links.tails.count()) and links.single.filter("kind = 'references'").isEmpty()


@pytest.mark.parametrize("name", ["node_metrics", "dead_code", "unreferenced_symbols", "file_scores"])
def test_counts_do_not_write_bundles_out(spark, name):
    """The plan has no heads that go to all parts of their bundles, nor a join of suppliers and customers."""
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "explode" not in plan and not any("s_nationkey" in line and "c_nationkey" in line for line in joins)
