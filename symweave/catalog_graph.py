"""Registered queries over the graph that the driver's tables give, with the same questions in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.functions.paths import is_affected_test, is_test_file, language_of
from symweave.graph import Graph
from symweave.operators import analytics, lookups, traversal
from symweave.sources import driver_tables

GRAPH_SQL = """
nat AS (SELECT *, 'src/' || r_name || '/' || n_name || '.ts' AS path FROM nation JOIN region ON n_regionkey = r_regionkey),
nodes AS (
  SELECT 'module:' || r_regionkey AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, 'src/' || r_name AS file_path, 1 AS start_line, 1000 AS end_line, true AS is_exported FROM region
  UNION ALL SELECT 'class:' || n_nationkey, 'class', n_name, r_name || '::' || n_name, path, 1, 500, true FROM nat
  UNION ALL SELECT 'file:' || path, 'file', n_name || '.ts', path, path, 1, 500, false FROM nat
  UNION ALL SELECT 'method:' || c_custkey, 'method', c_name, r_name || '::' || n_name || '::' || c_name, path, c_custkey % 400 + 2, c_custkey % 400 + 9, false FROM customer JOIN nat ON c_nationkey = n_nationkey
  UNION ALL SELECT 'function:' || s_suppkey, 'function', s_name, r_name || '::' || n_name || '::' || s_name, path, s_suppkey % 90 + 405, s_suppkey % 90 + 409, s_suppkey % 2 = 0 FROM supplier JOIN nat ON s_nationkey = n_nationkey
),
edges AS (
  SELECT 'module:' || r_regionkey AS source, 'class:' || n_nationkey AS target, 'contains' AS kind, 0 AS line FROM nat
  UNION ALL SELECT 'file:' || path, 'class:' || n_nationkey, 'contains', 0 FROM nat
  UNION ALL SELECT 'class:' || c_nationkey, 'method:' || c_custkey, 'contains', 0 FROM customer
  UNION ALL SELECT 'class:' || s_nationkey, 'function:' || s_suppkey, 'contains', 0 FROM supplier
  UNION ALL SELECT 'method:' || o_custkey, 'function:' || l_suppkey, 'calls', l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND l_linenumber = 1
  UNION ALL SELECT 'function:' || s_suppkey, 'method:' || c_custkey, 'references', 0 FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_suppkey % 10 = c_custkey % 10
  UNION ALL SELECT 'file:' || a.path, 'file:' || b.path, 'imports', 0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nat a ON c_nationkey = a.n_nationkey JOIN nat b ON s_nationkey = b.n_nationkey WHERE l_linenumber = 1 AND o_orderkey % 199 = 0 AND a.path <> b.path
)
"""
HIERARCHY_SQL = """
edges AS (
  SELECT DISTINCT 'class:' || p_brand AS source, 'interface:' || p_type AS target, 'implements' AS kind FROM part
  UNION ALL SELECT DISTINCT 'interface:' || p_type, 'interface:' || regexp_extract(p_type, '[^ ]*$'), 'extends' FROM part WHERE p_type <> regexp_extract(p_type, '[^ ]*$')
)
"""
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, run, body: str | None = None, more: str = "", base: str = GRAPH_SQL) -> None:
    """A query on the graph; `more` are further common table expressions of its SQL."""
    QUERIES[name] = run
    if body:
        SQL[name] = f"WITH RECURSIVE {base}{',' + more if more else ''}\n{body}"


def _on_graph(name: str, body: str | None = None, more: str = ""):
    """Registers a function of a graph."""

    def add(f):
        _register(name, lambda spark, sf_dir: f(driver_tables.graph(spark, sf_dir)), body, more)
        return f

    return add


BRIEF = ["id", "kind", "name", "file_path", "start_line"]
ONE, HUB = "method:7", "function:3"

_on_graph("node_by_id", f"SELECT id, kind, name, file_path, start_line FROM nodes WHERE id = '{ONE}'")(lambda g: lookups.node(g, ONE).select(BRIEF))
_on_graph("nodes_in_file", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE file_path = (SELECT path FROM nat WHERE n_nationkey = 3)")(
    lambda g: lookups.in_file(g, g.nodes.filter("id = 'class:3'").select("file_path").first()[0]).select(BRIEF)
)
_on_graph("nodes_of_kind", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE kind = 'class'")(lambda g: lookups.of_kind(g, "class").select(BRIEF))
_on_graph("nodes_listed", "SELECT id, kind, name, file_path, start_line FROM nodes ORDER BY kind, name, id LIMIT 100")(lambda g: lookups.listed(g, 100).select(BRIEF))
_on_graph("edges_listed", "SELECT source, target, kind, line FROM edges ORDER BY source, target, kind, line LIMIT 200")(lambda g: lookups.listed_edges(g, 200).select("source", "target", "kind", "line"))
_on_graph("nodes_named", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE name = (SELECT n_name FROM nation WHERE n_nationkey = 5)")(
    lambda g: lookups.named(g, g.nodes.filter("id = 'class:5'").select("name").first()[0]).select(BRIEF)
)
_on_graph("nodes_named_any_case", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE lower(name) = (SELECT lower(c_name) FROM customer WHERE c_custkey = 7)")(
    lambda g: lookups.named(g, g.nodes.filter(F.col("id") == ONE).select(F.upper("name")).first()[0], ignore_case=True).select(BRIEF)
)
_on_graph("nodes_by_qualified_name", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE qualified_name = (SELECT r_name || '::' || n_name FROM nat WHERE n_nationkey = 5)")(
    lambda g: lookups.qualified(g, g.nodes.filter("id = 'class:5'").select("qualified_name").first()[0]).select(BRIEF)
)
_on_graph("edges_out", f"SELECT source, target, kind, line FROM edges WHERE source = '{HUB}' AND kind IN ('references', 'calls')")(lambda g: lookups.outgoing(g, HUB, ("references", "calls")).select("source", "target", "kind", "line"))
_on_graph("edges_in", f"SELECT source, target, kind, line FROM edges WHERE target = '{HUB}'")(lambda g: lookups.incoming(g, HUB).select("source", "target", "kind", "line"))
_on_graph(
    "edges_between",
    "SELECT source, target, kind, line FROM edges WHERE source IN (SELECT id FROM picked) AND target IN (SELECT id FROM picked)",
    "picked AS (SELECT id FROM nodes WHERE kind IN ('class', 'module') OR is_exported)",
)(lambda g: lookups.between(g.links(), g.nodes.filter("kind in ('class', 'module') or is_exported")).select("source", "target", "kind", "line"))
_on_graph("files_listed", "SELECT path FROM nat")(lambda g: lookups.files(g).select("path"))
_on_graph("files_stale", "SELECT path FROM nat WHERE n_nationkey % 3 = 0")(
    lambda g: lookups.stale_files(
        g,
        g.files.join(g.nodes.filter("kind = 'class'").select(F.col("file_path").alias("path"), F.substring_index("id", ":", -1).cast("int").alias("k")), "path").select(
            "path", F.when(F.col("k") % 3 == 0, "changed").when(F.col("k") % 3 == 1, F.col("content_hash")).otherwise("").alias("hash")
        ),
    ).select("path")
)
_on_graph("exported_symbols", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE is_exported AND file_path = (SELECT path FROM nat WHERE n_nationkey = 3)")(
    lambda g: lookups.exported(g, g.nodes.filter("id = 'class:3'").select("file_path").first()[0]).select(BRIEF)
)
_on_graph("qualified_pattern", r"SELECT id, kind, name, file_path, start_line FROM nodes WHERE kind IN ('class', 'function', 'method') AND regexp_full_match(qualified_name, 'A.*::.*0.')")(lambda g: lookups.by_qualified_pattern(g, "A*::*0?").select(BRIEF))
_on_graph(
    "filtered_subgraph",
    "SELECT source, target, kind, line FROM edges WHERE source IN (SELECT id FROM picked) AND target IN (SELECT id FROM picked)",
    "picked AS (SELECT id FROM nodes WHERE kind IN ('method', 'function', 'class') AND start_line < 420)",
)(lambda g: lookups.filtered(g, F.col("kind").isin("method", "function", "class") & (F.col("start_line") < 420))[1].select("source", "target", "kind", "line"))
_on_graph(
    "symbol_matches",
    "SELECT id, kind, name, file_path, start_line FROM nodes, one WHERE name = n_name AND (contains(qualified_name, r_name || '::' || n_name) OR list_contains(string_split(file_path, '/'), r_name))",
    "one AS (SELECT r_name, n_name FROM nat WHERE n_nationkey = 4)",
)(lambda g: g.nodes.filter(lookups.matches_symbol(g.nodes.filter("id = 'class:4'").select("qualified_name").first()[0])).select(BRIEF))
_on_graph("nodes_without", "SELECT id, kind, name, file_path, start_line FROM nodes WHERE kind <> 'method'")(lambda g: lookups.without_nodes(g, g.nodes.filter("kind = 'method'")).nodes.select(BRIEF))
_on_graph("edges_without_nodes", "SELECT source, target, kind, line FROM edges WHERE source NOT LIKE 'method:%' AND target NOT LIKE 'method:%'")(lambda g: lookups.without_nodes(g, g.nodes.filter("kind = 'method'")).edges.select("source", "target", "kind", "line"))
_on_graph("edges_without_files", "SELECT e.source, e.target, e.kind, e.line FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE a.file_path NOT LIKE 'src/A%' AND b.file_path NOT LIKE 'src/A%'")(
    lambda g: lookups.without_files(g, g.nodes.filter("file_path like 'src/A%'").select(F.col("file_path").alias("path"))).edges.select("source", "target", "kind", "line")
)
_on_graph("nodes_upserted", "SELECT id, CASE WHEN kind = 'class' THEN upper(name) || '!' ELSE name END AS name FROM nodes")(
    lambda g: lookups.upserted(g.nodes, g.nodes.filter("kind = 'class'").withColumn("name", F.concat(F.upper("name"), F.lit("!")))).select("id", "name")
)

BALL = """
ball(id, dist) AS (
  SELECT id, 0 FROM nodes WHERE id = '{root}'
  UNION SELECT {b}, dist + 1 FROM ball JOIN edges ON {a} = id JOIN nodes n ON n.id = {b} WHERE dist < {depth} AND {where}
),
near AS (SELECT id, min(dist) AS dist FROM ball GROUP BY id)
"""


def _ball(root: str, depth: int, a: str = "source", b: str = "target", where: str = "true") -> str:
    return BALL.format(root=root, depth=depth, a=a, b=b, where=where)


_on_graph("bfs_out", "SELECT id, dist FROM near", _ball(HUB, 3))(lambda g: traversal.bfs(g, traversal.roots_of(g, [HUB]), 3)[0].select("id", "dist"))
_on_graph("bfs_both_calls", "SELECT id, dist FROM near", _ball(HUB, 4, "CASE WHEN source = ball.id THEN source ELSE target END", "CASE WHEN source = ball.id THEN target ELSE source END", "edges.kind IN ('calls', 'references')"))(
    lambda g: traversal.bfs(g, traversal.roots_of(g, [HUB]), 4, ("calls", "references"), direction="both")[0].select("id", "dist")
)
_on_graph("bfs_limited", "SELECT id, dist FROM near ORDER BY dist, id LIMIT 25", _ball("module:1", 3))(lambda g: traversal.bfs(g, traversal.roots_of(g, ["module:1"]), 3, limit=25)[0].select("id", "dist"))
_on_graph("bfs_edges", "SELECT source, target, kind FROM edges WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", _ball(HUB, 2))(lambda g: traversal.bfs(g, traversal.roots_of(g, [HUB]), 2)[1].select("source", "target", "kind"))
CALL_KINDS = "kind IN ('calls', 'references', 'imports')"
_on_graph("callers", f"SELECT source, target, kind, line, 1 AS depth FROM edges WHERE target = '{HUB}' AND {CALL_KINDS} AND source <> target")(lambda g: traversal.callers(g, traversal.roots_of(g, [HUB])).drop("root"))
_on_graph("callers_deep", f"SELECT source, target, kind, line, dist + 1 AS depth FROM near JOIN edges ON target = near.id WHERE {CALL_KINDS} AND source <> target", _ball(HUB, 2, "target", "source", f"edges.{CALL_KINDS}"))(
    lambda g: traversal.callers(g, traversal.roots_of(g, [HUB]), 3).drop("root")
)
_on_graph("callees_deep", f"SELECT source, target, kind, line, dist + 1 AS depth FROM near JOIN edges ON source = near.id WHERE {CALL_KINDS} AND source <> target", _ball(HUB, 1, where=f"edges.{CALL_KINDS}"))(
    lambda g: traversal.callees(g, traversal.roots_of(g, [HUB]), 2).drop("root")
)
_on_graph(
    "call_graph",
    f"SELECT '{HUB}' AS id UNION SELECT source FROM found UNION SELECT target FROM found",
    f"up(id, dist) AS (SELECT '{HUB}', 0 UNION SELECT source, dist + 1 FROM up JOIN edges ON target = id WHERE {CALL_KINDS} AND dist < 2), "
    f"down(id, dist) AS (SELECT '{HUB}', 0 UNION SELECT target, dist + 1 FROM down JOIN edges ON source = id WHERE {CALL_KINDS} AND dist < 2), "
    f"found AS (SELECT source, target FROM edges WHERE {CALL_KINDS} AND target IN (SELECT id FROM up WHERE dist < 2) UNION SELECT source, target FROM edges WHERE {CALL_KINDS} AND source IN (SELECT id FROM down WHERE dist < 2))",
)(lambda g: traversal.call_graph(g, traversal.roots_of(g, [HUB]), 2)[0].select("id"))
_on_graph("usages", f"SELECT e.source, n.name AS source_name, n.kind AS source_kind, e.kind, e.line FROM edges e JOIN nodes n ON e.source = n.id WHERE e.target = '{HUB}'")(lambda g: traversal.usages(g, traversal.roots_of(g, [HUB])).drop("root"))
IMPACT_SQL = """
walk(id, dist) AS (
  SELECT id, 0 FROM nodes WHERE id = '{root}'
  UNION SELECT n.id, s.dist + s.cost FROM (
    SELECT source AS next, dist, 1 AS cost FROM walk JOIN edges ON target = walk.id WHERE dist < {depth}
    UNION ALL SELECT target, dist, 0 FROM walk JOIN nodes c ON c.id = walk.id JOIN edges ON source = walk.id AND edges.kind = 'contains'
      WHERE dist < {depth} AND c.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')
  ) s JOIN nodes n ON n.id = s.next
)
"""
_on_graph("impact", "SELECT id, min(dist) AS dist FROM walk GROUP BY id", IMPACT_SQL.format(root=HUB, depth=2))(lambda g: traversal.impact(g, traversal.roots_of(g, [HUB]), 2)[0].select("id", "dist"))
_on_graph(
    "impact_merged_edges",
    "SELECT DISTINCT source, target, kind FROM edges WHERE source IN (SELECT id FROM walk) AND target IN (SELECT id FROM walk)",
    IMPACT_SQL.format(root=HUB, depth=1),
)(lambda g: traversal.merged_impact(g, traversal.roots_of(g, [HUB]), 1)[1])
_on_graph(
    "shortest_path",
    "SELECT unnest(range(len(p))::INTEGER[]) AS step, unnest(p) AS id FROM (SELECT p FROM paths WHERE id = 'function:3' ORDER BY len(p), p LIMIT 1)",
    "paths(id, p) AS (SELECT 'method:922', ['method:922'] UNION ALL SELECT target, list_append(p, target) FROM paths JOIN (SELECT DISTINCT source, target FROM edges WHERE kind <> 'contains') e ON source = id WHERE len(p) < 6)",
)(lambda g: traversal.path(g, "method:922", "function:3", ("calls", "references", "imports")))
_on_graph(
    "ancestors",
    "SELECT id, dist FROM up WHERE dist > 0",
    "up(id, dist) AS (SELECT 'method:7', 0 UNION SELECT p.source, dist + 1 FROM up JOIN (SELECT target, min(source) AS source FROM edges WHERE kind = 'contains' GROUP BY target) p ON p.target = up.id)",
)(lambda g: traversal.ancestors(g, traversal.roots_of(g, [ONE])).select("id", "dist"))
_on_graph("children", "SELECT target AS id FROM edges WHERE kind = 'contains' AND source = 'class:3'")(lambda g: traversal.children(g, traversal.roots_of(g, ["class:3"])).select("id"))
_on_graph(
    "node_context",
    f"""SELECT 'focal' AS role, '{HUB}' AS id UNION SELECT 'ancestor', id FROM up WHERE dist > 0
  UNION SELECT 'incoming', source FROM edges WHERE target = '{HUB}' AND kind <> 'contains' UNION SELECT 'outgoing', target FROM edges WHERE source = '{HUB}' AND kind <> 'contains'
  UNION SELECT 'import', e.target FROM nodes n JOIN edges e ON e.source = 'file:' || n.file_path AND e.kind = 'imports' WHERE n.id = '{HUB}'""",
    f"up(id, dist) AS (SELECT '{HUB}', 0 UNION SELECT p.source, dist + 1 FROM up JOIN (SELECT target, min(source) AS source FROM edges WHERE kind = 'contains' GROUP BY target) p ON p.target = up.id)",
)(lambda g: analytics.context(g, traversal.roots_of(g, [HUB])).select("role", "id"))
DEPS = "deps AS (SELECT DISTINCT substr(source, 6) AS path, substr(target, 6) AS depends_on FROM edges WHERE kind = 'imports')"
_on_graph("file_dependencies", "SELECT * FROM deps", DEPS)(lambda g: analytics.file_dependencies(g))
_on_graph("file_dependents", "SELECT path FROM deps WHERE depends_on = (SELECT path FROM nat WHERE n_nationkey = 3)", DEPS)(lambda g: analytics.file_dependents(g, g.nodes.filter("id = 'class:3'").select("file_path").first()[0]))
_on_graph("module_structure", "SELECT 'src/' || r_name AS directory, string_agg(path, ';' ORDER BY path) AS files FROM nat GROUP BY r_name")(lambda g: analytics.module_structure(g).select("directory", F.array_join("files", ";").alias("files")))
_on_graph(
    "import_cycles",
    "SELECT a.a AS path, least(a.a, min(a.b)) AS component FROM closure a JOIN closure b ON a.a = b.b AND a.b = b.a WHERE a.a <> a.b GROUP BY a.a",
    DEPS + ", closure(a, b) AS (SELECT path, depends_on FROM deps UNION SELECT a, depends_on FROM closure JOIN deps ON b = path)",
)(analytics.cycles)
_on_graph(
    "node_metrics",
    """SELECT n.id AS root, (SELECT count(*) FROM edges WHERE target = n.id) AS incoming, (SELECT count(*) FROM edges WHERE target = n.id AND kind = 'calls') AS callers,
  (SELECT count(*) FROM edges WHERE source = n.id) AS outgoing, (SELECT count(*) FROM edges WHERE source = n.id AND kind = 'calls') AS calls, (SELECT count(*) FROM edges WHERE source = n.id AND kind = 'contains') AS children,
  CASE kind WHEN 'function' THEN 2 WHEN 'class' THEN 1 ELSE 0 END AS depth FROM nodes n WHERE kind IN ('function', 'class', 'module')""",
)(lambda g: analytics.metrics(g, g.nodes.filter("kind in ('function', 'class', 'module')").select(F.col("id").alias("root"), "id")))
_on_graph("dead_code", "SELECT id FROM nodes n WHERE kind IN ('function', 'method', 'class') AND NOT is_exported AND NOT EXISTS (SELECT 1 FROM edges WHERE target = n.id AND kind <> 'contains')")(lambda g: analytics.dead_code(g).select("id"))
_on_graph("unused_symbols", "SELECT id FROM nodes n WHERE kind NOT IN ('file', 'module') AND NOT EXISTS (SELECT 1 FROM edges WHERE target = n.id AND kind IN ('calls', 'references', 'imports'))")(lambda g: analytics.unused(g).select("id"))
_on_graph("unreferenced_symbols", "SELECT id FROM nodes n WHERE kind NOT IN ('file', 'module') AND NOT is_exported AND NOT EXISTS (SELECT 1 FROM e2 WHERE target = n.id)", "e2 AS (SELECT * FROM edges WHERE kind <> 'contains' OR source LIKE 'file%')")(
    lambda g: analytics.unreferenced(g.linked(lambda links: links.where("kind <> 'contains' or source like 'file%'"))).select("id")
)
_on_graph("orphan_files", "SELECT id FROM nodes n WHERE kind = 'file' AND NOT EXISTS (SELECT 1 FROM edges WHERE kind = 'imports' AND (target = n.id OR source = n.id))")(lambda g: analytics.orphan_files(g).select("id"))
_on_graph("dead_routes", "SELECT replace(id, 'function', 'route') AS id FROM nodes n WHERE kind = 'function' AND NOT EXISTS (SELECT 1 FROM edges WHERE target = n.id AND kind = 'calls')")(
    lambda g: analytics.dead_routes(
        Graph(
            g.nodes.filter("kind = 'function'").withColumns({"kind": F.lit("route"), "id": F.regexp_replace("id", "function", "route")}),
            g.edges.filter("kind = 'calls'").withColumn("target", F.regexp_replace("target", "function", "route")),
        )
    ).select("id")
)
_on_graph(
    "affected_files",
    "SELECT DISTINCT id AS path, false AS is_test FROM walk",
    DEPS + ", walk(id, dist) AS (SELECT path, 0 FROM nat WHERE n_nationkey = 3 UNION SELECT path, dist + 1 FROM walk JOIN deps ON depends_on = id WHERE dist < 5)",
)(lambda g: analytics.affected(g, g.nodes.filter("id = 'class:3'").select(F.col("file_path").alias("path"))))
_on_graph(
    "statistics",
    """SELECT 'nodes_by_kind' AS measure, kind AS value, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges_by_kind', kind, count(*) FROM edges GROUP BY kind
  UNION ALL SELECT 'files_by_language', 'typescript', count(*) FROM nat UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges UNION ALL SELECT 'total', 'files', count(*) FROM nat""",
)(analytics.statistics)


def type_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = driver_tables.hierarchy(spark, sf_dir)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    root = edges.filter("kind = 'implements'").agg(F.min("target")).first()[0]
    return traversal.hierarchy(Graph(nodes, edges), nodes.filter(F.col("id") == root).select(F.col("id").alias("root"), "id")).select("id", "dist", "role")


_register(
    "type_hierarchy",
    type_hierarchy,
    "SELECT id, min(dist) AS dist, CASE min(dist) WHEN 0 THEN 'focal' ELSE 'ancestor' END AS role FROM up GROUP BY id UNION ALL SELECT id, min(dist), 'descendant' FROM down WHERE dist > 0 GROUP BY id",
    "r AS (SELECT min(target) AS id FROM edges WHERE kind = 'implements'), up(id, dist) AS (SELECT id, 0 FROM r UNION SELECT target, dist + 1 FROM up JOIN edges ON source = id), down(id, dist) AS (SELECT id, 0 FROM r UNION SELECT source, dist + 1 FROM down JOIN edges ON target = id)",
    HIERARCHY_SQL,
)


def path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test-file, affected-test and language columns over the paths of pages, with made-up file names."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ends = F.array(*map(F.lit, ("Test.kt", "_test.go", ".spec.ts", "latest.kt", "/tests/a.py", "/demo/b.rs", ".test.jsx")))
    path = F.concat(F.regexp_extract("url", r"://[^/]+/([^?#]*)", 1), ends[F.pmod("page_id", F.lit(7)).cast("int")])
    return pages.select("page_id", path.alias("path")).select("page_id", is_test_file(F.col("path")).alias("is_test"), is_affected_test(F.col("path")).alias("is_affected"), language_of(F.col("path")).alias("language"))


_register(
    "path_flags",
    path_flags,
    r"""SELECT page_id, page_id % 7 IN (0, 1, 2, 4, 5, 6) AS is_test, page_id % 7 IN (2, 4, 6) AS is_affected,
  ['kotlin', 'go', 'typescript', 'kotlin', 'python', 'rust', 'jsx'][page_id % 7 + 1] AS language FROM pages""",
    base="none_ AS (SELECT 1)",
)
