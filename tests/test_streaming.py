from pyspark.sql import functions as F

from symweave.graph import Graph
from symweave.schema import EDGES, FILES, NODES, conform
from symweave.streaming import changes


def test_bursts_close_after_a_quiet_stretch(spark, tmp_path):
    rows = [("a.ts", 0), ("b.ts", 1), ("a.ts", 2), ("c.ts", 30), ("d.ts", 31), ("e.ts", 600)]
    events = spark.createDataFrame(rows, "path string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [(r.n, r.end.second) for r in changes.debounced(events).orderBy("start").collect()] == [(3, 4), (2, 33), (1, 2)]
    for k, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "path string, s int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, s int, ts timestamp").json(str(tmp_path / "in"))
    seen = []
    query = changes.watch(stream, lambda batch, _: seen.extend(r.n for r in batch.collect()), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert sorted(seen) == [2, 3]  # the last burst may still grow


def test_synced_graph_equals_the_fresh_one(spark):
    def graph(files, edges):
        nodes = spark.createDataFrame([(f"{p}#{n}", "function", n, n, p, "typescript") for p, (_, names) in files.items() for n in names], "id string, kind string, name string, qualified_name string, file_path string, language string")
        tracked = spark.createDataFrame([(p, h) for p, (h, _) in files.items()], "path string, content_hash string")
        return Graph(conform(nodes, NODES), conform(spark.createDataFrame(edges, "source string, target string, kind string"), EDGES), conform(tracked, FILES))

    old = graph({"a": ("1", ["x", "y"]), "b": ("1", ["z"]), "c": ("1", ["w"])}, [("a#x", "b#z", "calls"), ("b#z", "c#w", "calls"), ("c#w", "a#y", "calls")])
    new = graph({"a": ("1", ["x", "y"]), "b": ("2", ["z", "q"]), "d": ("1", ["v"])}, [("a#x", "b#z", "calls"), ("b#q", "a#y", "calls"), ("d#v", "a#x", "calls")])
    found = changes.changed(old.files, new.files)
    assert {tuple(r) for r in found.collect()} == {("b", "modified"), ("c", "removed"), ("d", "added")}
    got = changes.synced(old, new, found)
    pairs = lambda g: sorted((r.source, r.target) for r in g.edges.collect())
    assert {r.id for r in got.nodes.collect()} == {r.id for r in new.nodes.collect()} and pairs(got) == pairs(new)
    assert {r.path for r in got.files.collect()} == {"a", "b", "d"}
