"""Registered search and ranking queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.catalog_graph import GRAPH_SQL
from symweave.functions.words import edit_distance, kind_points, name_points, path_points
from symweave.operators import search, textindex
from symweave.plans.staging import shared_folder
from symweave.sources import driver_tables, textstore

QUERIES: dict = {}
SQL: dict[str, str] = {}
BM25 = """
toks AS (SELECT id, 20.0 AS w, unnest(regexp_split_to_array(lower(name), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM nodes UNION ALL SELECT id, 5.0, unnest(regexp_split_to_array(lower(qualified_name), '[^\\p{{L}}\\p{{N}}]+')) FROM nodes),
tok AS (SELECT * FROM toks WHERE t <> ''),
len AS (SELECT id, count(*) AS d FROM tok GROUP BY id),
stat AS (SELECT count(*) AS n, avg(d) AS mean FROM len),
hit AS (SELECT id, q, sum(w) AS f FROM tok JOIN (SELECT unnest([{terms}]) AS q) ON starts_with(t, q) GROUP BY id, q),
idf AS (SELECT q, greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hit, stat GROUP BY q),
fts AS (SELECT id, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))) AS score FROM hit JOIN idf USING (q) JOIN len USING (id), stat GROUP BY id)
"""
#: BM25 of the one phrase of "nation_1": a prefix after a word, in the same column.
PHRASE = r"""
lists AS (SELECT id, 20.0 AS w, 'n' AS col, regexp_split_to_array(lower(name), '[^\p{L}\p{N}]+') AS l FROM nodes UNION ALL SELECT id, 5.0, 'q', regexp_split_to_array(lower(qualified_name), '[^\p{L}\p{N}]+') FROM nodes),
tok AS (SELECT * FROM (SELECT id, w, col, unnest(l) AS t, unnest(range(len(l))) AS pos FROM lists) WHERE t <> ''),
len AS (SELECT id, count(*) AS d FROM tok GROUP BY id),
stat AS (SELECT count(*) AS n, avg(d) AS mean FROM len),
hit AS (SELECT b.id, sum(b.w) AS f FROM tok a JOIN tok b ON a.id = b.id AND a.col = b.col AND b.pos = a.pos + 1 AND a.t = 'nation' AND starts_with(b.t, '1') GROUP BY b.id),
idf AS (SELECT greatest(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf FROM hit, stat),
fts AS (SELECT id, idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean)) AS score FROM hit JOIN len USING (id), idf, stat)
"""
#: What the nodes are after the edits of search_after_syncs.
EDITED = """
edited AS (SELECT id, CASE WHEN starts_with(file_path, 'src/EUROPE/') AND kind = 'function' THEN 'asia ' || name ELSE name END AS name, qualified_name FROM nodes
  WHERE kind <> 'method' OR NOT (starts_with(file_path, 'src/AFRICA/') OR starts_with(file_path, 'src/ASIA/')))
"""
KIND_SQL = "CASE kind WHEN 'function' THEN 10 WHEN 'method' THEN 10 WHEN 'class' THEN 8 WHEN 'module' THEN 4 ELSE 0 END"


def _add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_tables.nodes(spark, sf_dir)


def _with(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {GRAPH_SQL}{',' + more if more else ''} {body}"


@_add("search_full_text", _with("SELECT id, round(score, 6) AS score FROM fts", BM25.format(terms="'asia', 'america', 'supplier'")))
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).select("id", "name", "qualified_name")
    return textindex.ranked(textindex.build(rows), "Asia AMERICA supplier").select("id", F.round("score", 6).alias("score"))


@_add("search_phrase", _with("SELECT id, round(score, 6) AS score FROM fts", PHRASE))
def phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _nodes(spark, sf_dir).select("id", "name", "qualified_name")
    return textindex.ranked(textindex.build(rows), "nation_1").select("id", F.round("score", 6).alias("score"))


@_add("search_after_syncs", _with("SELECT id, round(score, 6) AS score FROM fts", EDITED + "," + BM25.replace("FROM nodes", "FROM edited").format(terms="'asia', 'supplier', 'renamed'")))
def after_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index of all nodes after four edits of whole directories: names that come, names that go again, files that lose their methods."""
    rows, at = _nodes(spark, sf_dir).select("id", "kind", "file_path", "name", "qualified_name"), shared_folder(spark, "text")
    below = lambda region: rows.filter(F.col("file_path").startswith(f"src/{region}/"))
    asia, africa, europe = map(below, ("ASIA", "AFRICA", "EUROPE"))
    renamed = asia.withColumn("name", F.concat(F.lit("renamed "), "name"))
    named = europe.withColumn("name", F.when(F.col("kind") == "function", F.concat(F.lit("asia "), "name")).otherwise(F.col("name")))
    text = textstore.written(rows, at)
    for before, now in ((asia, renamed), (africa, africa.filter("kind <> 'method'")), (europe, named), (renamed, asia.filter("kind <> 'method'"))):
        text = textstore.updated(text, before, now, at)
    return textindex.ranked(textstore.opened(spark, text, at), "Asia supplier renamed").select("id", F.round("score", 6).alias("score"))


@_add("search_by_part", _with("SELECT id, CASE WHEN lower(name) = 'nation_1' THEN 1.0 WHEN starts_with(lower(name), 'nation_1') THEN 0.9 WHEN contains(lower(name), 'nation_1') THEN 0.8 ELSE 0.7 END AS score FROM nodes WHERE contains(lower(name), 'nation_1') OR contains(lower(qualified_name), 'nation_1')"))
def part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_part(_nodes(spark, sf_dir), "Nation_1").select("id", "score")


@_add(
    "search_by_spelling",
    _with(
        "SELECT id, 1.0 / (1 + d) AS score FROM (SELECT n.id, near.d, row_number() OVER (PARTITION BY n.name ORDER BY file_path, start_line, n.id) AS place FROM nodes n JOIN near USING (name)) WHERE place <= 5",
        "near AS (SELECT name, levenshtein(lower(name), 'natiom_7') AS d FROM (SELECT DISTINCT name FROM nodes) WHERE levenshtein(lower(name), 'natiom_7') <= 2 ORDER BY d, name LIMIT 50)",
    ),
)
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_spelling(_nodes(spark, sf_dir), "natiom_7").select("id", "score")


@_add("search_filters", _with("SELECT id, name FROM nodes WHERE kind IN ('function', 'class') AND contains(lower(file_path), 'asia') AND contains(lower(name), 'a') ORDER BY name, id LIMIT 20"))
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    return search.search(nodes, textindex.build(nodes.select("id", "name").limit(0)), "kind:function kind:class path:Asia name:a", 20).select("id", "name")


@_add(
    "search_ranked",
    _with(
        f"SELECT id, round(score + {KIND_SQL} + CASE WHEN contains(lower(regexp_extract(file_path, '[^/]*$')), 'africa') THEN 10 ELSE 0 END + CASE WHEN lower(name) = 'africa' THEN 80 WHEN starts_with(lower(name), 'africa') THEN floor(10 + 30 * 6 / length(name) + 0.5) WHEN contains(lower(name), 'africa') THEN 10 ELSE 0 END + CASE WHEN contains(lower(regexp_replace(file_path, '/[^/]*$', '')), 'africa') THEN 5 WHEN contains(lower(file_path), 'africa') THEN 3 ELSE 0 END, 6) AS score FROM fts JOIN nodes USING (id) ORDER BY 2 DESC, id LIMIT 15",
        BM25.format(terms="'africa'"),
    ),
)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    index = textindex.build(nodes.select("id", "name", "qualified_name"))
    return search.search(nodes, index, "Africa", 15).select("id", F.round("score", 6).alias("score"))


@_add(
    "search_exact_names",
    _with(
        "SELECT id, score FROM (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY score DESC, id) AS place FROM found) WHERE place <= 25 ORDER BY score DESC, id LIMIT 50",
        "named AS (SELECT * FROM nodes WHERE lower(name) IN ('asia', 'nation_12')), few AS (SELECT lower(name) AS low FROM named GROUP BY 1 HAVING count(DISTINCT file_path) < 10), "
        "found AS (SELECT id, name, 1.0 + CASE WHEN file_path IN (SELECT file_path FROM named WHERE lower(name) IN (SELECT low FROM few)) THEN 20 ELSE 0 END AS score FROM named)",
    ),
)
def exact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_exact_names(_nodes(spark, sf_dir), ["Asia", "Nation_12"]).select("id", "score")


@_add("search_name_part", _with("SELECT id, name FROM nodes WHERE contains(lower(name), 'ation_1') AND NOT starts_with(lower(name), 'ation_1') ORDER BY length(name), name, id LIMIT 30"))
def name_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.by_name_part(_nodes(spark, sf_dir), "ATION_1", 30, not_prefix=True).select("id", "name")


@_add("part_name_distances", "SELECT DISTINCT p_name, least(levenshtein(lower(p_name), 'blue ring'), 4) AS distance FROM part")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select("p_name", edit_distance(F.lower("p_name"), F.lit("blue ring"), 3).alias("distance")).distinct()


@_add(
    "symbol_points",
    _with(
        f"SELECT id, {KIND_SQL} AS kind_points, CASE WHEN lower(name) = 'asianation_2' THEN 80 WHEN lower(name) IN ('asia', 'nation_2') THEN 60 WHEN starts_with(lower(name), 'asianation_2') THEN floor(10 + 30 * 12 / length(name) + 0.5)::INTEGER WHEN contains(lower(name), 'asia') AND contains(lower(name), 'nation') THEN 15 WHEN contains(lower(name), 'asianation_2') THEN 10 ELSE 0 END AS name_points, "
        + "+".join(
            f"CASE WHEN contains(lower(regexp_extract(file_path, '[^/]*$')), '{t}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(regexp_replace(file_path, '/?[^/]*$', '')), '{t}') THEN 5 WHEN contains(lower(file_path), '{t}') THEN 3 ELSE 0 END"
            for t in ("nation_2", "asia", "nation")
        )
        + " AS path_points FROM nodes"
    ),
)
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = "Asia NATION_2"
    return _nodes(spark, sf_dir).select("id", kind_points(F.col("kind")).alias("kind_points"), name_points(F.col("name"), line).alias("name_points"), path_points(F.col("file_path"), line).alias("path_points"))
