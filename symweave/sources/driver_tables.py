"""The star-schema tables read as a code graph: regions are modules, nations classes with a file each, customers methods, suppliers functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from symweave.graph import Graph, Links
from symweave.schema import EDGES, FILES, NODES, conform

IMPORT_EVERY = 199


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), F.col("r_name"), F.lit("/"), F.col("n_name"), F.lit(".ts"))
    return _read(spark, sf_dir, "nation").join(F.broadcast(_read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("path", path)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _nations(spark, sf_dir)
    region = _read(spark, sf_dir, "region")
    customer = _read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    supplier = _read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))

    def rows(df: DataFrame, kind: str, ident: Column, name: Column, qualified: Column, path: Column, start: Column, end: Column, exported: Column) -> DataFrame:
        return df.select(
            ident.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), qualified.alias("qualified_name"), path.alias("file_path"), F.lit("typescript").alias("language"),
            start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), exported.alias("is_exported"),
        )

    one, path = F.lit(1), F.col("path")
    under = lambda name: F.concat_ws("::", "r_name", "n_name", name)
    parts = [
        rows(region, "module", _id("module", "r_regionkey"), F.col("r_name"), F.col("r_name"), F.concat(F.lit("src/"), F.col("r_name")), one, F.lit(1000), F.lit(True)),
        rows(nation, "class", _id("class", "n_nationkey"), F.col("n_name"), F.concat_ws("::", "r_name", "n_name"), path, one, F.lit(500), F.lit(True)),
        rows(nation, "file", F.concat(F.lit("file:"), path), F.concat(F.col("n_name"), F.lit(".ts")), path, path, one, F.lit(500), F.lit(False)),
        rows(customer, "method", _id("method", "c_custkey"), F.col("c_name"), under("c_name"), path, F.pmod("c_custkey", F.lit(400)) + 2, F.pmod("c_custkey", F.lit(400)) + 9, F.lit(False)),
        rows(supplier, "function", _id("function", "s_suppkey"), F.col("s_name"), under("s_name"), path, F.pmod("s_suppkey", F.lit(90)) + 405, F.pmod("s_suppkey", F.lit(90)) + 409, F.pmod("s_suppkey", F.lit(2)) == 0),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return conform(out, NODES)


def links(spark: SparkSession, sf_dir: str, import_every: int = IMPORT_EVERY) -> Links:
    """The edges.  Suppliers refer to the customers of their nation whose key ends in the same digit: a bundle for each nation and digit, not a row for each pair."""
    nation, region = _nations(spark, sf_dir), _read(spark, sf_dir, "region")
    customer, supplier, orders = (_read(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    lines = _read(spark, sf_dir, "lineitem").filter("l_linenumber = 1")

    def rows(df: DataFrame, kind: str, source: Column, target: Column, line: Column | None = None) -> DataFrame:
        return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (F.lit(0) if line is None else line).cast("int").alias("line"))

    file = F.concat(F.lit("file:"), F.col("path"))
    placed = nation.select("n_nationkey", "path")
    ends = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    imports = (
        ends.filter(F.pmod("o_orderkey", F.lit(import_every)) == 0)
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(placed.withColumnsRenamed({"n_nationkey": "k1", "path": "p1"})), F.col("c_nationkey") == F.col("k1"))
        .join(F.broadcast(placed.withColumnsRenamed({"n_nationkey": "k2", "path": "p2"})), F.col("s_nationkey") == F.col("k2"))
        .filter("p1 <> p2")
    )

    def bundle(nationkey: str, key: str) -> Column:
        return (F.col(nationkey).cast("long") * 10 + F.pmod(key, F.lit(10))).alias("bundle")

    heads = supplier.select(bundle("s_nationkey", "s_suppkey"), _id("function", "s_suppkey").alias("source"), F.lit("references").alias("kind"), F.lit(0).alias("line"))
    tails = customer.select(bundle("c_nationkey", "c_custkey"), _id("method", "c_custkey").alias("target")).filter("bundle is not null")
    parts = [
        rows(nation.join(region.select("r_regionkey"), "r_regionkey"), "contains", _id("module", "r_regionkey"), _id("class", "n_nationkey")),
        rows(nation, "contains", file, _id("class", "n_nationkey")),
        rows(customer, "contains", _id("class", "c_nationkey"), _id("method", "c_custkey")),
        rows(supplier, "contains", _id("class", "s_nationkey"), _id("function", "s_suppkey")),
        rows(ends.filter("l_quantity >= 50"), "calls", _id("method", "o_custkey"), _id("function", "l_suppkey"), F.col("l_linenumber")),
        rows(imports, "imports", F.concat(F.lit("file:"), F.col("p1")), F.concat(F.lit("file:"), F.col("p2"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    heads = conform(heads.filter("bundle is not null"), StructType([StructField("bundle", LongType()), *(f for f in EDGES.fields if f.name != "target")]))
    return Links(conform(out, EDGES), heads, tails, ("references",))


def edges(spark: SparkSession, sf_dir: str, import_every: int = IMPORT_EVERY) -> DataFrame:
    return links(spark, sf_dir, import_every).rows()


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind): brands extend types, types extend their last word: two levels."""
    part = _read(spark, sf_dir, "part")
    low = part.select(_id("class", "p_brand").alias("source"), _id("interface", "p_type").alias("target"), F.lit("implements").alias("kind")).distinct()
    top = part.select(_id("interface", "p_type").alias("source"), F.concat(F.lit("interface:"), F.substring_index("p_type", " ", -1)).alias("target"), F.lit("extends").alias("kind")).distinct().filter("source <> target")
    return low.unionAll(top)


def graph(spark: SparkSession, sf_dir: str, import_every: int = IMPORT_EVERY) -> Graph:
    found = nodes(spark, sf_dir)
    files = found.filter("kind = 'file'").select(F.col("file_path").alias("path"), F.sha2("file_path", 256).alias("content_hash"), "language", F.length("file_path").cast("long").alias("size"))
    return Graph.of(found, links(spark, sf_dir, import_every), conform(files, FILES))
