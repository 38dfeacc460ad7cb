"""Registered queries of retrieval, exploration, resolution and change detection with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.catalog_graph import GRAPH_SQL
from symweave.graph import Links
from symweave.operators import context, explore, resolve, textindex
from symweave.schema import NODES, REFS, conform
from symweave.sources import driver_tables
from symweave.streaming import changes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _with(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{',' + more if more else ''} {body}"


CLUSTERS = """
r AS (SELECT file_path, start_line AS s, end_line AS e, 1 AS w FROM nodes WHERE kind IN ('method', 'function') AND start_line % 3 = 0),
m AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY file_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 8 THEN 1 ELSE 0 END AS o FROM r),
c AS (SELECT *, sum(o) OVER (PARTITION BY file_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
clusters AS (SELECT file_path, min(s) AS s, max(e) AS e, count(*) AS n, sum(w)::BIGINT AS weight FROM c GROUP BY file_path, k)
"""


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = driver_tables.nodes(spark, sf_dir).filter("kind in ('method', 'function') and start_line % 3 = 0")
    return explore.clusters(nodes.select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.lit(1).alias("weight")), 8)


@_add("interval_clusters", _with("SELECT file_path, s AS start, e AS \"end\", n, weight FROM clusters", CLUSTERS))
def interval_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir)


@_add("clusters_ranked", _with("SELECT file_path, s AS start, row_number() OVER (PARTITION BY file_path ORDER BY weight >= 10 DESC, round(n / (e - s + 1), 9) DESC, weight DESC, e - s, s) AS place FROM clusters", CLUSTERS))
def clusters_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.ranked_clusters(_clusters(spark, sf_dir)).select("file_path", "start", F.col("place").cast("long").alias("place"))


@_add("clusters_packed")
def clusters_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explore.ranked_clusters(_clusters(spark, sf_dir)).withColumn("size", (F.col("end") - F.col("start") + 1) * 40)
    return explore.packed(found, 3800).select("file_path", "start", "end", "place", "taken")


@_add("names_colocated", _with("SELECT id, 1.0 + (count(DISTINCT lower(name)) OVER (PARTITION BY file_path) - 1) * 20 AS score FROM nodes WHERE kind IN ('function', 'class')").replace("count(DISTINCT lower(name)) OVER (PARTITION BY file_path)", "(SELECT count(DISTINCT lower(m.name)) FROM nodes m WHERE m.file_path = nodes.file_path AND m.kind IN ('function', 'class'))"))
def names_colocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = driver_tables.nodes(spark, sf_dir).filter("kind in ('function', 'class')").withColumn("score", F.lit(1.0))
    return context.colocated(nodes).select("id", "score")


@_add("nodes_capped_by_file", _with("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY start_line DESC, id) AS place FROM nodes WHERE kind = 'method') WHERE place <= 5"))
def nodes_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = driver_tables.nodes(spark, sf_dir).filter("kind = 'method'")
    return context._capped(nodes, F.col("file_path"), 5, [F.desc("start_line"), F.asc("id")]).select("id")


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Links]:
    graph = driver_tables.graph(spark, sf_dir)
    kept = graph.nodes.filter("kind in ('function', 'method', 'class')").withColumn("is_root", F.expr("kind = 'function' and id like '%7'"))
    return kept, graph.links("calls", "references")


KEPT = "kept AS (SELECT *, kind = 'function' AND id LIKE '%7' AS is_root FROM nodes WHERE kind IN ('function', 'method', 'class')), used AS (SELECT * FROM edges WHERE kind IN ('calls', 'references')), near AS (SELECT source AS id FROM used WHERE target IN (SELECT id FROM kept WHERE is_root) UNION SELECT target FROM used WHERE source IN (SELECT id FROM kept WHERE is_root))"


@_add("file_scores", _with("SELECT file_path, sum(CASE WHEN is_root THEN 10 WHEN id IN (SELECT id FROM near) THEN 3 ELSE 1 END)::BIGINT AS score, count(*) AS n FROM kept GROUP BY file_path HAVING score >= 3", KEPT))
def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.file_scores(*_kept(spark, sf_dir))


@_add(
    "relationships",
    _with(
        "SELECT kind, source_name, target_name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY source_name, target_name, source, target) AS place FROM (SELECT DISTINCT e.kind, e.source, e.target, a.name AS source_name, b.name AS target_name FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.kind <> 'contains')) WHERE place <= 12"
    ),
)
def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return explore.relationships(graph.links(), graph.nodes, 12).select("kind", "source_name", "target_name")


@_add("code_slices", "SELECT 'doc:' || doc_id AS id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS code FROM documents")
def code_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat(F.lit("doc:"), "doc_id")
    nodes = docs.select(path.alias("id"), path.alias("file_path"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return context.code(nodes, docs.select(path.alias("path"), F.col("text").alias("content")))


@_add("numbered_lines", "SELECT doc_id::VARCHAR AS path, i::INTEGER AS line, list_extract(string_split(text, chr(10)), i) AS text FROM documents, range(1, 9) t(i) WHERE i BETWEEN 2 AND 8 AND i <= len(string_split(text, chr(10)))")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return explore.numbered_lines(docs, docs.select(F.col("path").alias("file_path"), F.lit(5).alias("start"), F.lit(5).alias("end")))


@_add("entry_points")
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return context.entry_points(graph, textindex.build(graph.nodes.select("id", "name", "qualified_name")), "How does NATION_7 in Asia reach supplier NATION_12")


@_add("relevant_context")
def relevant_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = driver_tables.graph(spark, sf_dir)
    return context.relevant(graph, textindex.build(graph.nodes.select("id", "name", "qualified_name")), "How does NATION_7 in Asia reach supplier NATION_12")[0]


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every customer, in six writings by turn."""
    nation = driver_tables._nations(spark, sf_dir)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    n = suppliers.count()
    both = customer.join(suppliers, F.pmod("c_custkey", F.lit(n)) == F.col("s_suppkey"))
    turn = F.pmod("c_custkey", F.lit(6))
    name = (
        F.when(turn == 0, F.col("s_name")).when(turn == 1, F.concat_ws("::", "r_name", "n_name")).when(turn == 2, F.col("path"))
        .when(turn == 3, F.concat(F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".ts"))).when(turn == 4, F.lower("s_name")).otherwise("no_such_thing")
    )
    found = both.select(
        F.col("c_custkey").alias("ref_id"), F.concat(F.lit("method:"), "c_custkey").alias("from_node_id"), name.alias("reference_name"), F.lit("calls").alias("reference_kind"),
        F.lit(3).alias("line"), F.lit(1).alias("col"), F.col("path").alias("file_path"), F.lit("typescript").alias("language"),
    )
    return conform(found, REFS)


REFS_SQL = """
found AS (
  SELECT c_custkey AS ref_id, CASE c_custkey % 6 WHEN 0 THEN 'function:' || s_suppkey WHEN 1 THEN 'class:' || c_nationkey WHEN 2 THEN 'file:' || path WHEN 3 THEN 'file:' || path WHEN 4 THEN 'function:' || s_suppkey END AS target,
    CASE c_custkey % 6 WHEN 0 THEN 0.9 WHEN 1 THEN 0.95 WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.5 END::DOUBLE AS confidence,
    CASE c_custkey % 6 WHEN 0 THEN 'exact-match' WHEN 1 THEN 'qualified-name' WHEN 2 THEN 'file-path' WHEN 3 THEN 'file-path' WHEN 4 THEN 'fuzzy' ELSE 'unresolved' END AS resolved_by
  FROM customer JOIN nat ON c_nationkey = n_nationkey JOIN supplier ON c_custkey % (SELECT count(*) FROM supplier) = s_suppkey
)
"""


@_add("refs_resolved", _with("SELECT ref_id, target, confidence, resolved_by FROM found WHERE target IS NOT NULL", REFS_SQL))
def refs_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolved(_refs(spark, sf_dir), driver_tables.nodes(spark, sf_dir))


@_add("refs_edges", _with("SELECT 'method:' || ref_id AS source, target, CASE WHEN target LIKE 'class:%' THEN 'instantiates' ELSE 'calls' END AS kind, confidence FROM found WHERE target IS NOT NULL", REFS_SQL))
def refs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, nodes = _refs(spark, sf_dir), driver_tables.nodes(spark, sf_dir)
    return resolve.edges_of(resolve.resolved(refs, nodes), refs, nodes).select("source", "target", "kind", F.col("metadata.confidence").alias("confidence"))


@_add("refs_statistics", _with("SELECT resolved_by, count(*) AS n FROM found GROUP BY resolved_by", REFS_SQL))
def refs_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _refs(spark, sf_dir)
    return resolve.statistics(refs, resolve.resolved(refs, driver_tables.nodes(spark, sf_dir)))


@_add(
    "refs_best_of_many",
    """
WITH n AS (SELECT 'function:' || p_partkey AS id, p_name AS name, 'src/' || p_brand || '/' || p_type || '.ts' AS path, p_size AS line, p_partkey % 2 = 0 AS open, CASE WHEN p_partkey % 3 = 0 THEN 'class' ELSE 'function' END AS kind FROM part),
r AS (SELECT p_partkey AS ref_id, p_name AS name, 'src/' || p_brand || '/' || p_type || '.ts' AS path, p_size AS line FROM part WHERE p_partkey % 7 = 0),
c AS (SELECT ref_id, id, CASE WHEN split_part(r.path, '/', 2) = split_part(n.path, '/', 2) THEN 30 ELSE 15 END AS near, 50 + near + CASE WHEN kind = 'function' THEN 25 ELSE 0 END + CASE WHEN open THEN 10 ELSE 0 END
  + CASE WHEN r.path = n.path THEN 100 + CASE WHEN n.line > 0 THEN greatest(0.0, 20 - abs(n.line - r.line) / 10.0) ELSE 0.0 END ELSE 0 END AS score FROM r JOIN n USING (name)),
b AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY score DESC, near DESC, id) AS place FROM c)
SELECT ref_id, id AS target, CASE WHEN near >= 30 THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM b WHERE place = 1
""",
)
def refs_best_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_type", F.lit(".ts"))
    nodes = part.select(
        F.concat(F.lit("function:"), "p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "class").otherwise("function").alias("kind"), F.col("p_name").alias("name"), F.col("p_name").alias("qualified_name"),
        path.alias("file_path"), F.lit("typescript").alias("language"), F.col("p_size").alias("start_line"), (F.col("p_partkey") % 2 == 0).alias("is_exported"),
    )
    refs = part.filter("p_partkey % 7 = 0").select(
        F.col("p_partkey").alias("ref_id"), F.col("p_name").alias("reference_name"), F.lit("calls").alias("reference_kind"), F.col("p_size").alias("line"), path.alias("file_path"), F.lit("typescript").alias("language")
    )
    return resolve.by_exact_name(conform(refs, REFS), conform(nodes, NODES)).select("ref_id", "target", "confidence")


@_add("files_changed", "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'new/' ELSE '' END || p_partkey AS path, CASE p_partkey % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' END AS change FROM part WHERE p_partkey % 5 IN (0, 1) UNION ALL SELECT p_partkey::VARCHAR, 'removed' FROM part WHERE p_partkey % 5 = 0")
def files_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    key, turn = F.col("p_partkey").cast("string"), F.col("p_partkey") % 5
    tracked = part.select(key.alias("path"), F.sha2("p_name", 256).alias("content_hash"))
    current = part.select(F.when(turn == 0, F.concat(F.lit("new/"), key)).otherwise(key).alias("path"), F.sha2(F.when(turn == 1, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("content_hash"))
    return changes.changed(tracked, current)


@_add(
    "events_debounced",
    """
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS o FROM events),
k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM m)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS last_us FROM k GROUP BY user_id, b
""",
)
def events_debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = changes.debounced(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "user_id")
    return found.select("user_id", "n", F.unix_micros("start").alias("start_us"), (F.unix_micros("end") - 3_600_000_000).alias("last_us"))
