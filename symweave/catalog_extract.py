"""Registered extraction queries: sources made from the driver's tables, with the symbols that must come out as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.extract import frame
from symweave.functions.paths import language_of
from symweave.operators import resolve
from symweave.sources import driver_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A TypeScript and a Python file a nation: a function a supplier, three lines each; the TypeScript ones call the next supplier's.

    Files grow with the suppliers, so queries over all functions read them without a limit of size.
    """
    nation = driver_tables._nations(spark, sf_dir)
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    key = F.col("s_suppkey").cast("string")
    ts = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "export ").otherwise(""), F.lit("function s_"), key, F.lit("(a: number) { // calls none()\n  return s_"), (F.col("s_suppkey") + 1).cast("string"), F.lit("(a);\n}\n"))
    py = F.concat(F.lit("@app.get('/s/"), key, F.lit("')\ndef s_"), key, F.lit("(a):\n    return a\n"))

    def joined(part, path) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("s_suppkey", part.alias("part"))))
        return supplier.groupBy("path").agg(F.array_join(F.transform(rows, lambda r: r["part"]), "").alias("content")).select(path.alias("path"), "content")

    return joined(ts, F.col("path")).unionByName(joined(py, F.regexp_replace("path", r"\.ts$", ".py")))


PLACED = "WITH nat AS (SELECT *, 'src/' || r_name || '/' || n_name AS stem FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier JOIN nat ON s_nationkey = n_nationkey)"


@_add(
    "symbols_extracted",
    PLACED
    + " SELECT stem || '.ts' AS file_path, 's_' || s_suppkey AS name, 'function' AS kind, (3 * k - 2)::INTEGER AS start_line, (3 * k)::INTEGER AS end_line, s_suppkey % 2 = 0 AS is_exported FROM s UNION ALL SELECT stem || '.py', 's_' || s_suppkey, 'function', (3 * k - 1)::INTEGER, (3 * k)::INTEGER, true FROM s",
)
def symbols_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frame.extracted(_sources(spark, sf_dir), most=None).select("path", F.explode("nodes").alias("n")).filter("n.kind = 'function'")
    return found.select(F.col("path").alias("file_path"), "n.name", "n.kind", "n.start_line", "n.end_line", "n.is_exported")


@_add("routes_extracted", PLACED + " SELECT stem || '.py' AS file_path, 'GET /s/' || s_suppkey AS name, 's_' || s_suppkey AS handler, (3 * k - 2)::INTEGER AS line FROM s")
def routes_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.routed(frame.extracted(_sources(spark, sf_dir), most=None)).withColumnRenamed("path", "file_path")


@_add(
    "calls_resolved",
    PLACED
    + " SELECT a.stem || '.ts' AS source_file, 's_' || a.s_suppkey AS source_name, b.stem || '.ts' AS target_file, 's_' || b.s_suppkey AS target_name, CASE WHEN a.r_name = b.r_name THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence FROM s a JOIN s b ON b.s_suppkey = a.s_suppkey + 1",
)
def calls_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, resolve, join: TypeScript calls find the TypeScript function, though a Python one has its name."""
    graph = frame.indexed(_sources(spark, sf_dir), most=None)
    refs = graph.refs.filter("reference_kind = 'calls' and language = 'typescript'")
    edges = resolve.edges_of(resolve.resolved(refs, graph.nodes), refs, graph.nodes)
    at = graph.nodes.select("id", "file_path", "name")
    both = edges.join(at.toDF("source", "source_file", "source_name"), "source").join(at.toDF("target", "target_file", "target_name"), "target")
    return both.select("source_file", "source_name", "target_file", "target_name", F.col("metadata.confidence").alias("confidence"))


@_add(
    "page_links",
    r"""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages""",
)
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@_add("files_by_language", PLACED + " SELECT l AS language, count(DISTINCT stem) AS n FROM s, (VALUES ('typescript'), ('python')) t(l) GROUP BY l")
def files_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).groupBy(language_of(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
