"""Registered queries of references, many roots, frameworks, languages, imports and paths with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave import project
from symweave.catalog_context import CLUSTERS, _refs
from symweave.catalog_graph import CALL_KINDS, DEPS, GRAPH_SQL
from symweave.extract import frame
from symweave.functions.externals import internal, is_external_module
from symweave.functions.paths import included, inside
from symweave.graph import Graph
from symweave.operators import analytics, lookups, resolve, traversal
from symweave.schema import NODES, REFS, conform
from symweave.sources import driver_tables
from symweave.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, body: str | None = None, more: str = "", base: str | None = GRAPH_SQL):
    """Registers a function of (spark, sf_dir); body is its SQL over the graph's tables, or over the driver's with base=None."""

    def put(f):
        QUERIES[name] = f
        if body:
            parts = ",".join(p for p in (base, more) if p)
            SQL[name] = f"WITH RECURSIVE {parts}\n{body}" if parts else body
        return f

    return put


# --- references ------------------------------------------------------------------------------------------------------

REFS_SQL = """
refs AS (
  SELECT c_custkey AS ref_id, 'method:' || c_custkey AS from_node_id, path AS file_path, CASE c_custkey % 6 WHEN 0 THEN s_name WHEN 1 THEN r_name || '::' || n_name
    WHEN 2 THEN path WHEN 3 THEN r_name || '/' || n_name || '.ts' WHEN 4 THEN lower(s_name) ELSE 'no_such_thing' END AS reference_name
  FROM customer JOIN nat ON c_nationkey = n_nationkey JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey
)"""


def _with_refs(spark: SparkSession, sf_dir: str) -> Graph:
    graph = driver_tables.graph(spark, sf_dir)
    return Graph.of(graph.nodes, graph.links(), graph.files, _refs(spark, sf_dir))


@_add("refs_named", "SELECT ref_id, from_node_id FROM refs WHERE reference_name = 'no_such_thing'", REFS_SQL)
def refs_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.refs_named(_with_refs(spark, sf_dir), "no_such_thing").select("ref_id", "from_node_id")


@_add("refs_page", "SELECT ref_id, reference_name FROM refs ORDER BY ref_id LIMIT 50 OFFSET 20", REFS_SQL)
def refs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.refs_page(_with_refs(spark, sf_dir), 50, 20).select("ref_id", "reference_name")


@_add("refs_in_files", "SELECT ref_id FROM refs WHERE file_path LIKE 'src/A%'", REFS_SQL)
def refs_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _with_refs(spark, sf_dir)
    return lookups.refs_in(graph, graph.files.filter("path like 'src/A%'")).select("ref_id")


@_add("refs_without_ids", "SELECT ref_id FROM refs WHERE ref_id % 5 <> 0", REFS_SQL)
def refs_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _with_refs(spark, sf_dir)
    return lookups.without_refs(graph, graph.refs.filter("ref_id % 5 = 0")).select("ref_id")


@_add("refs_without_places", "SELECT ref_id FROM refs WHERE reference_name <> 'no_such_thing'", REFS_SQL)
def refs_without_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _with_refs(spark, sf_dir)
    return lookups.without_refs(graph, graph.refs.filter("reference_name = 'no_such_thing'"), ("from_node_id", "reference_name", "reference_kind")).select("ref_id")


@_add(
    "symbol_best",
    "SELECT id, name FROM nodes WHERE name = 'NATION_7' OR kind = 'file' AND name = 'NATION_7.ts' ORDER BY name <> 'NATION_7', qualified_name <> 'NATION_7', NOT suffix(qualified_name, 'NATION_7'), start_line, id LIMIT 1",
)
def symbol_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = driver_tables.nodes(spark, sf_dir).filter(lookups.matches_symbol("NATION_7"))
    return lookups.best_match(found, "NATION_7").select("id", "name")


CALLED = ("Svc{k}.run", "svc{k}.run", "svc{k}_box.run", "zzz.run")


@_add(
    "refs_method_calls",
    """SELECT s_suppkey AS ref_id, 'method:' || s_suppkey AS target, CASE s_suppkey % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.8 ELSE 0.65 END::DOUBLE AS confidence,
  CASE s_suppkey % 4 WHEN 0 THEN 'qualified-name' ELSE 'instance-method' END AS resolved_by FROM supplier WHERE s_suppkey % 4 < 3""",
    base=None,
)
def refs_method_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class Svc<k> with a method run for each supplier, called by class, by an instance of its name, by a name that shares a word, and by a stranger."""
    k = F.col("s_suppkey").cast("string")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.concat(F.lit("src/"), k, F.lit(".py")).alias("file_path"), F.concat(F.lit("Svc"), k).alias("holder"), F.lit("python").alias("language"))
    classes = rows.select(F.concat(F.lit("class:"), k).alias("id"), F.lit("class").alias("kind"), F.col("holder").alias("name"), F.col("holder").alias("qualified_name"), "file_path", "language")
    methods = rows.select(F.concat(F.lit("method:"), k).alias("id"), F.lit("method").alias("kind"), F.lit("run").alias("name"), F.concat("holder", F.lit("::run")).alias("qualified_name"), "file_path", "language")
    name = F.replace(F.array(*map(F.lit, CALLED))[F.pmod("s_suppkey", F.lit(4)).cast("int")], F.lit("{k}"), k)
    refs = rows.select(F.col("s_suppkey").alias("ref_id"), name.alias("reference_name"), F.lit("calls").alias("reference_kind"), F.lit("main.py").alias("file_path"), "language")
    return resolve.by_method_call(conform(refs, REFS), conform(classes.unionByName(methods), NODES))


@_add(
    "refs_with_colons",
    """SELECT p.p_partkey AS ref_id, min('n:' || q.p_partkey) AS target, 0.85::DOUBLE AS confidence, 'qualified-name' AS resolved_by
FROM (SELECT p_partkey, ('r' || p_size || '.ts::GET:/' || lower(p_brand) || '.set:to:') AS name FROM part) p
JOIN (SELECT p_partkey, ('src/a' || p_partkey % 3 || '/r' || p_size || '.ts::GET:/' || lower(p_brand) || '.set:to:') AS name FROM part) q ON ends_with(q.name, p.name)
GROUP BY p.p_partkey""",
    base=None,
)
def refs_with_colons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes and selectors of parts, whose single colons are part of a name: a reference names the end of the way that leads to it."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    end = F.concat(F.lit("r"), F.col("p_size").cast("string"), F.lit(".ts::GET:/"), F.lower("p_brand"), F.lit(".set:to:"))
    folder = F.concat(F.lit("src/a"), F.pmod("p_partkey", F.lit(3)).cast("string"), F.lit("/"))
    nodes = part.select(F.concat(F.lit("n:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("method").alias("kind"), F.lit("set:to:").alias("name"), F.concat(folder, end).alias("qualified_name"), F.lit("r.ts").alias("file_path"))
    refs = part.select(F.col("p_partkey").alias("ref_id"), end.alias("reference_name"))
    return resolve.by_qualified_name(conform(refs, REFS), conform(nodes, NODES))


NAMES = (
    ("typescript", "console.log", False), ("typescript", "useState", False), ("tsx", "useThing", True), ("javascript", "fetch", False), ("typescript", "Mathy.max", True),
    ("python", "len", False), ("python", "rows.append", False), ("python", "known.append", True), ("python", "list.thing", False), ("python", "thing.do", True),
    ("go", "fmt.Println", False), ("go", "make", False), ("go", "store.Get", True), ("pascal", "System.Types", False), ("pascal", "TList", False), ("pascal", "TMine", True), ("rust", "len", True),
)


def _values(rows: tuple, key: str) -> str:
    return ", ".join("(" + ", ".join([str(k), *("'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() for x in row)]) + ")" for k, row in enumerate(rows))


def _at(column: str, table: tuple, field: int) -> Column:
    """The field of the row of table that column, modulo its length, points at."""
    return F.array(*[F.lit(row[field]) for row in table])[F.pmod(column, F.lit(len(table))).cast("int")]


@_add("refs_internal", f"SELECT p_partkey AS ref_id FROM part JOIN (VALUES {_values(NAMES, 'k')}) t(k, language, name, stays) ON p_partkey % {len(NAMES)} = k WHERE stays", base=None)
def refs_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    refs = part.select(F.col("p_partkey").alias("ref_id"), _at("p_partkey", NAMES, 0).alias("language"), _at("p_partkey", NAMES, 1).alias("reference_name"))
    return internal(refs, spark.createDataFrame([("Known",)], "name string")).select("ref_id")


MODULES = (
    ("typescript", "./a", False), ("typescript", "react", True), ("typescript", "node:fs", True), ("typescript", "fs/promises", True), ("typescript", "@org/pkg", True), ("typescript", "@/lib/a", False), ("typescript", "lib/deep/a", False),
    ("python", "os.path", True), ("python", "mine.os", False), ("go", "github.com/x/y", True), ("java", "java.util.List", True), ("java", "com.mine.A", False), ("csharp", "System.Text", True),
    ("ruby", "json", True), ("ruby", "lib/a", False), ("c", "stdio.h", True), ("php", "a.php", False),
)


@_add("modules_external", f"SELECT p_partkey, away FROM part JOIN (VALUES {_values(MODULES, 'k')}) t(k, language, module, away) ON p_partkey % {len(MODULES)} = k", base=None)
def modules_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", is_external_module(_at("p_partkey", MODULES, 1), _at("p_partkey", MODULES, 0)).alias("away"))


# --- walks -----------------------------------------------------------------------------------------------------------


def _roots(graph: Graph, kind: str) -> DataFrame:
    return graph.nodes.filter(F.col("kind") == kind).select(F.col("id").alias("root"), "id")


@_add(
    "bfs_many_roots",
    "SELECT root, id, min(dist) AS dist FROM ball GROUP BY root, id",
    "ball(root, id, dist) AS (SELECT id, id, 0 FROM nodes WHERE kind IN ('class') UNION SELECT root, target, dist + 1 FROM ball JOIN edges ON source = ball.id JOIN nodes n ON n.id = target WHERE dist < 2)",
)
def bfs_many_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return traversal.bfs(graph, _roots(graph, "class"), 2)[0]


@_add(
    "bfs_many_roots_edges",
    "SELECT DISTINCT a.root, source, target, kind, line FROM near a JOIN edges ON a.id = source JOIN near b ON b.root = a.root AND b.id = target",
    "near(root, id) AS (SELECT id, id FROM nodes WHERE kind = 'class' UNION SELECT source, target FROM edges WHERE source LIKE 'class:%' AND target IN (SELECT id FROM nodes))",
)
def bfs_many_roots_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    ball, _ = traversal.bfs(graph, _roots(graph, "class"), 1)
    return graph.links().distinct("source", "target", "kind", "line").within(ball)


@_add(
    "callers_many_roots",
    f"SELECT root, source, target, kind, line, min(dist) + 1 AS depth FROM up JOIN edges ON target = up.id WHERE {CALL_KINDS} AND source <> target GROUP BY ALL",
    f"up(root, id, dist) AS (SELECT id, id, 0 FROM nodes WHERE kind = 'function' UNION SELECT root, source, dist + 1 FROM up JOIN edges ON target = up.id WHERE {CALL_KINDS} AND dist < 1 AND source <> target)",
)
def callers_many_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return traversal.callers(graph.linked(lambda links: links.distinct("source", "target", "kind", "line")), _roots(graph, "function"), 2)


@_add(
    "impact_many_roots",
    "SELECT root, id, min(dist) AS dist FROM walk GROUP BY root, id",
    """
walk(root, id, dist) AS (
  SELECT id, id, 0 FROM nodes WHERE kind = 'module'
  UNION SELECT s.root, n.id, s.dist + s.cost FROM (
    SELECT root, source AS next, dist, 1 AS cost FROM walk JOIN edges ON target = walk.id WHERE dist < 1
    UNION ALL SELECT root, target, dist, 0 FROM walk JOIN nodes c ON c.id = walk.id JOIN edges ON source = walk.id AND edges.kind = 'contains'
      WHERE dist < 1 AND c.kind IN ('class', 'interface', 'struct', 'trait', 'protocol', 'module', 'enum')
  ) s JOIN nodes n ON n.id = s.next
)""",
)
def impact_many_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return traversal.impact(graph, _roots(graph, "module"), 1)[0]


@_add(
    "dfs_order",
    "SELECT way[1] AS root, id, len(way)::INTEGER - 1 AS dist, (row_number() OVER (PARTITION BY way[1] ORDER BY way))::INTEGER AS place FROM walk",
    "walk(id, way) AS (SELECT id, [id] FROM nodes WHERE kind = 'class' UNION ALL SELECT target, list_append(way, target) FROM walk JOIN edges ON source = walk.id AND edges.kind = 'contains' WHERE len(way) < 3)",
)
def dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return traversal.dfs(graph, _roots(graph, "class"), 2, ("contains",), limit=100_000)


@_add(
    "cycle_lists",
    "SELECT root AS component, string_agg(x, ';' ORDER BY i) AS files FROM (SELECT root, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM best) GROUP BY root",
    DEPS
    + """,
closure(a, b) AS (SELECT path, depends_on FROM deps UNION SELECT a, depends_on FROM closure JOIN deps ON b = path),
roots AS (SELECT DISTINCT least(a.a, min(a.b)) AS root FROM closure a JOIN closure b ON a.a = b.b AND a.b = b.a WHERE a.a <> a.b GROUP BY a.a),
ways(root, here, p) AS (SELECT root, root, [root] FROM roots UNION ALL SELECT root, depends_on, list_append(p, depends_on) FROM ways JOIN deps ON path = here
  WHERE (depends_on = root OR NOT list_contains(p, depends_on)) AND (len(p) = 1 OR here <> root) AND len(p) < 7),
best AS (SELECT root, p[1 : len(p) - 1] AS p FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY len(p), p) AS place FROM ways WHERE here = root AND len(p) > 1) WHERE place = 1)""",
)
def cycle_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.cycle_lists(driver_tables.graph(spark, sf_dir)).select("component", F.array_join("files", ";").alias("files"))


@_add(
    "affected_tests",
    "SELECT DISTINCT id AS path, regexp_matches(id, 'src/A[^/]*/.+') AS is_test FROM walk",
    DEPS
    + """,
walk(id, dist) AS (SELECT path, 0 FROM nat WHERE n_nationkey IN (0, 3, 4)
  UNION SELECT path, dist + 1 FROM walk JOIN deps ON depends_on = id WHERE dist < 5 AND NOT regexp_matches(id, 'src/A[^/]*/.+'))""",
)
def affected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose directories start with A count as tests: they are reported and not gone on from, changed ones too."""
    graph = driver_tables.graph(spark, sf_dir)
    return analytics.affected(graph, graph.nodes.filter("id in ('class:0', 'class:3', 'class:4')").select(F.col("file_path").alias("path")), pattern="src/A*/**")


@_add(
    "clusters_packed",
    'SELECT file_path, s AS start, e AS "end", place, taken FROM fit JOIN ranked USING (file_path, place)',
    CLUSTERS
    + """,
ranked AS (SELECT file_path, s, e, ((e - s + 1) * 40)::BIGINT AS size, (row_number() OVER (PARTITION BY file_path ORDER BY weight >= 10 DESC, round(n / (e - s + 1), 9) DESC, weight DESC, e - s, s))::INTEGER AS place FROM clusters),
fit(file_path, place, room, taken) AS (
  SELECT file_path, place, 3800 - CASE WHEN size <= 3800 THEN size ELSE 0 END, size <= 3800 FROM ranked WHERE place = 1
  UNION ALL SELECT r.file_path, r.place, room - CASE WHEN size <= room THEN size ELSE 0 END, size <= room FROM fit JOIN ranked r ON r.file_path = fit.file_path AND r.place = fit.place + 1
)""",
)
def clusters_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from symweave.catalog_context import clusters_packed as run

    return run(spark, sf_dir)


# --- files and changes -----------------------------------------------------------------------------------------------

CHANGED = "turned AS (SELECT path, CASE n_nationkey % 3 WHEN 0 THEN 'modified' WHEN 1 THEN 'removed' END AS change FROM nat)"


def _synced(spark: SparkSession, sf_dir: str) -> Graph:
    graph = driver_tables.graph(spark, sf_dir)
    fresh = Graph.of(graph.nodes.withColumn("name", F.concat("name", F.lit("!"))), graph.links(), graph.files)
    turn = F.pmod(F.substring_index("id", ":", -1).cast("int"), F.lit(3))
    found = graph.nodes.filter("kind = 'class'").select(F.col("file_path").alias("path"), F.when(turn == 0, "modified").when(turn == 1, "removed").alias("change")).filter("change is not null")
    return changes.synced(graph, fresh, found)


@_add("sync_nodes", "SELECT id, CASE change WHEN 'modified' THEN name || '!' ELSE name END AS name FROM nodes LEFT JOIN turned ON file_path = path WHERE change IS NULL OR change <> 'removed'", CHANGED)
def sync_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).nodes.select("id", "name")


@_add(
    "sync_edges",
    "SELECT source, target, kind, line FROM edges JOIN state a ON a.id = source JOIN state b ON b.id = target WHERE a.change IS DISTINCT FROM 'removed' AND (a.change = 'modified' OR b.change IS DISTINCT FROM 'removed')",
    CHANGED + ", state AS (SELECT id, change FROM nodes LEFT JOIN turned ON file_path = path)",
)
def sync_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).edges.select("source", "target", "kind", "line")


@_add("paths_included", r"SELECT page_id FROM (SELECT page_id, regexp_extract(url, '://[^/]+/([^?#]*)', 1) || CASE WHEN page_id % 2 = 1 THEN '.html' ELSE '' END AS p FROM pages) WHERE p NOT LIKE 'fr/%' AND p NOT LIKE '%9.html' AND (p LIKE '%.html' OR p LIKE 'en/%')", base=None)
def paths_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(F.regexp_extract("url", r"://[^/]+/([^?#]*)", 1), F.when(F.col("page_id") % 2 == 1, ".html").otherwise(""))
    return pages.filter(included(path, ["**/*.html", "en/**"], ["fr/**", "**/*9.html"])).select("page_id")


PLACES = (("a/b.ts", True), ("a/../b.ts", True), ("../b.ts", False), ("a/../../b.ts", False), ("/p/q/b.ts", True), ("/p/b.ts", False), ("/p/q/../b.ts", False), ("./a/./b.ts", True))


@_add("paths_inside", f"SELECT page_id, within FROM pages JOIN (VALUES {_values(PLACES, 'k')}) t(k, place, within) ON page_id % {len(PLACES)} = k", base=None)
def paths_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", inside(_at("page_id", PLACES, 0), "/p/q").alias("within"))


# --- sources ---------------------------------------------------------------------------------------------------------

#: (ending, source, route, handler) of a file in each framework; {k} is the key of a row.
ROUTES = (
    ("ts", "app.get('/r{k}', auth, h{k});", "GET /r{k}", "h{k}"),
    ("ts", "@Controller('c{k}')\nexport class C {\n  @Get('x')\n  f{k}(id) { }\n}", "GET /c{k}/x", "f{k}"),
    ("tsx", '<Route path="/r{k}" element={<H{k} />} />', "PAGE /r{k}", "H{k}"),
    ("py", "@app.route('/r{k}', methods=['POST'])\ndef v{k}():\n    pass\n", "POST /r{k}", "v{k}"),
    ("py", "@router.get('/i{k}')\nasync def i{k}(): ...\n", "GET /i{k}", "i{k}"),
    ("py", "urlpatterns = [path('r{k}/', V{k}.as_view(), name='x')]\n", "ROUTE r{k}/", "V{k}"),
    ("rb", "get '/r{k}', to: 'posts#a{k}'\n", "GET /r{k}", "a{k}"),
    ("java", '@RequestMapping("/api")\npublic class C {\n  @GetMapping("/r{k}")\n  public List<String> m{k}(String q) { }\n}', "GET /api/r{k}", "m{k}"),
    ("go", 'r.GET("/r{k}", h{k})\n', "GET /r{k}", "h{k}"),
    ("rs", '#[get("/r{k}")]\npub async fn i{k}() {}\n', "GET /r{k}", "i{k}"),
    ("rs", 'let a = Router::new().route("/r{k}", post(handlers::m{k}));\n', "POST /r{k}", "m{k}"),
    ("cs", '[HttpGet("r{k}")]\npublic async Task<T> O{k}(int id) { }\n', "GET r{k}", "O{k}"),
    ("cs", 'app.MapPost("/r{k}", M{k});\n', "POST /r{k}", "M{k}"),
    ("php", "Route::get('/r{k}', [UserController::class, 'i{k}']);\n", "GET /r{k}", "i{k}"),
    ("swift", 'app.get("r{k}", use: g{k})\n', "GET r{k}", "g{k}"),
)


def _files(spark: SparkSession, sf_dir: str, table: tuple) -> DataFrame:
    """(path, content): a file for each part, its ending and text by turn."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey").cast("string")
    return part.select(F.concat(F.lit("w/"), key, F.lit("."), _at("p_partkey", table, 0)).alias("path"), F.replace(_at("p_partkey", table, 1), F.lit("{k}"), key).alias("content"))


def _expected(table: tuple, *fields: str) -> str:
    listed = ", ".join(f"replace({f}, '{{k}}', p_partkey::VARCHAR) AS {f}" for f in fields)
    return f"SELECT 'w/' || p_partkey || '.' || ending AS path, {listed} FROM part JOIN t ON p_partkey % {len(table)} = k"


@_add("routes_of_frameworks", _expected(ROUTES, "name", "handler"), f"t(k, ending, source, name, handler) AS (VALUES {_values(ROUTES, 'k')})", base=None)
def routes_of_frameworks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.routed(frame.extracted(_files(spark, sf_dir, ROUTES))).select("path", "name", "handler")


#: (ending, source, symbols, references) of a file in each language: kind and qualified name, kind and name.
SOURCES = (
    ("ts", "export class A{k} extends B{k} implements C {\n  async go(x: string): Promise<void> { this.help{k}(x); new D(1); }\n}\nexport enum E { X, Y }\n", "class A{k};method A{k}::go;enum E;enum_member E::X;enum_member E::Y", "extends B{k};implements C;calls help{k};instantiates D;references Promise"),
    ("py", "import os\nclass A{k}(B):\n    @dec\n    def m(self, x: T{k}) -> int:\n        return self.n(x)\n", "class A{k};method A{k}::m;import os", "extends B;decorates dec;references T{k};calls n;imports os"),
    ("go", 'package m\nimport "fmt"\ntype S{k} struct { x int }\nfunc (s *S{k}) Run(q Foo) { fmt.Println(1) }\nfunc help() {}\n', "struct S{k};method S{k}::Run;function help;import fmt", "calls fmt.Println;imports fmt;references Foo"),
    ("rs", "use std::io;\npub struct P{k} { a: i32 }\nimpl Show for P{k} { fn show(&self) { help{k}(1); } }\npub trait T: U { }\nenum E { A, B(u8) }\n", "struct P{k};method P{k}::show;trait T;enum E;enum_member E::A;enum_member E::B;import std", "implements Show;calls help{k};extends U;imports std"),
    ("java", "import a.B;\n@Service\npublic class A{k} extends B implements I {\n  private int n = 1;\n  public int go(String q) { return svc.find{k}(q); }\n}\n", "class A{k};method A{k}::go;field A{k}::n;import a.B", "extends B;implements I;decorates Service;calls svc.find{k};imports a.B;references String"),
    ("cs", "using System.Text;\npublic class A{k} : B, ICan {\n  public Foo Bar { get; set; }\n  private int Go(string q) { return Find{k}(q); }\n}\n", "class A{k};method A{k}::Go;property A{k}::Bar;import System.Text", "extends B;implements ICan;calls Find{k};imports System.Text;references Foo"),
    ("c", "#include <stdio.h>\nstruct s{k} { int a; };\nenum e { RED };\nstatic int go(int x) {\n  return help{k}(x);\n}\n", "struct s{k};enum e;enum_member e::RED;function go;import stdio.h", "calls help{k};imports stdio.h"),
    ("cpp", "class A{k} : public B {\n public:\n  void go();\n};\nvoid A{k}::go() { help(); }\n", "class A{k};method A{k}::go", "extends B;calls help"),
    ("php", "<?php\nuse App\\M;\nclass A{k} extends B implements I {\n  private $f;\n  public function go($x) { return help{k}($x); }\n}\n", "class A{k};method A{k}::go;field A{k}::f;import App\\M", "extends B;implements I;calls help{k};imports App\\M"),
    ("rb", "require 'json'\nmodule M\n  class A{k} < B\n    def go(x)\n      if x\n        run{k}(x)\n      end\n    end\n  end\nend\n", "module M;class M::A{k};method M::A{k}::go;import json", "extends B;calls run{k};imports json"),
    ("kt", "import a.b\nclass A{k} : B() {\n  fun go(x: Int): Int { return help{k}(x) }\n}\n", "class A{k};method A{k}::go;import a.b", "extends B;calls help{k};imports a.b;references Int"),
    ("swift", "import UIKit\nclass A{k}: B {\n  func go(x: Int) -> Int { return help{k}(x) }\n}\nenum E { case a, b }\n", "class A{k};method A{k}::go;enum E;enum_member E::a;enum_member E::b;import UIKit", "extends B;calls help{k};imports UIKit;references Int"),
    ("scala", "import a.b\nclass A{k} extends B with C {\n  def go(x: Int): Int = { help{k}(x) }\n}\n", "class A{k};method A{k}::go;import a.b", "extends B;extends C;calls help{k};imports a.b"),
    ("dart", "import 'x.dart';\nclass A{k} extends B {\n  int go(int x) { return help{k}(x); }\n}\n", "class A{k};method A{k}::go;import x.dart", "extends B;calls help{k};imports x.dart"),
    ("lua", 'local j = require("json")\nfunction M.foo{k}(a)\n  if a then\n    bar{k}(a)\n  end\nend\n', "method M::foo{k};import json", "calls bar{k};imports json;calls require"),
    ("pas", "unit U{k};\ninterface\nuses SysUtils, Classes;\ntype\n  TA = class(TB)\n  end;\nimplementation\nprocedure TA.Go(x: Integer);\nbegin\n  Help{k}(x);\nend;\nend.\n", "module U{k};class U{k}::TA;method TA::Go;import SysUtils;import Classes", "extends TB;calls Help{k};imports SysUtils;imports Classes"),
    ("svelte", "<script lang=\"ts\">\n  import X from './X{k}.svelte';\n  function go() { help{k}(); }\n</script>\n<X on:click={go()} />\n", "component {k};function go;import ./X{k}.svelte", "calls help{k};calls go;references X;imports ./X{k}.svelte"),
    ("liquid", "{% render 'card{k}' %}\n{% assign n = 1 %}\n", "import card{k};component card{k};variable n", "references snippets/card{k}.liquid"),
)
SOURCES_SQL = f"t(k, ending, source, symbols, refs) AS (VALUES {_values(SOURCES, 'k')})"


@_add("symbols_of_languages", f"SELECT path, unnest(string_split(symbols, ';')) AS symbol FROM ({_expected(SOURCES, 'symbols')})", SOURCES_SQL, base=None)
def symbols_of_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame.extracted(_files(spark, sf_dir, SOURCES)).select("path", F.explode("nodes").alias("n")).filter("n.kind <> 'file'")
    return found.select("path", F.concat_ws(" ", "n.kind", "n.qualified_name").alias("symbol")).distinct()


@_add("references_of_languages", f"SELECT path, unnest(string_split(refs, ';')) AS reference FROM ({_expected(SOURCES, 'refs')})", SOURCES_SQL, base=None)
def references_of_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame.extracted(_files(spark, sf_dir, SOURCES)).select("path", F.explode("refs").alias("r"))
    return found.select("path", F.concat_ws(" ", "r.reference_kind", "r.reference_name").alias("reference")).distinct()


@_add("imports_resolved", "SELECT 'go_' || s_suppkey AS source_name, 'signIn_' || s_suppkey AS target_name, 0.9::DOUBLE AS confidence, 'import' AS resolved_by FROM supplier", base=None)
def imports_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files a supplier: a function, a file that passes it on under another name, one that passes on everything, and one that calls it."""
    k = F.col("s_suppkey").cast("string")
    parts = (
        ("auth.ts", "export function signIn_{k}() {}\n"),
        ("index.ts", "export { signIn_{k} as login_{k} } from './auth';\n"),
        ("all.ts", "export * from './index';\n"),
        ("main.ts", "import { login_{k} } from './all';\nexport function go_{k}() { login_{k}(); }\n"),
    )
    rows = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(text).alias("text")) for name, text in parts])
    sources = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.explode(rows).alias("x")).select(F.concat(F.lit("src/"), k, F.lit("/"), F.col("x.name")).alias("path"), F.replace("x.text", F.lit("{k}"), k).alias("content"))
    graph = project.build(sources)
    at = graph.nodes.select("id", "name")
    calls = graph.of_kind("calls").join(at.toDF("source", "source_name"), "source").join(at.toDF("target", "target_name"), "target")
    return calls.select("source_name", "target_name", F.col("metadata.confidence").alias("confidence"), F.col("metadata.resolved_by").alias("resolved_by"))
