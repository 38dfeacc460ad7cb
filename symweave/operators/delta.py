"""Resolution after a change: only references that the change can concern are resolved again.

A reference finds symbols by keys: its name, what follows its last separator or slash, and its receiver.  A symbol that came or went concerns the references
that share one of its keys.  Imports are followed backwards: from changed files over re-exports to the files that import them, each by all
candidate paths that a module name stands for, so that a file which comes or goes where another was found before is seen too.  References whose edge led
into a changed file, and those at the same place as one of these, are resolved as well.  What is looked at again beyond need gets the edge it had, so the result
equals a full build; the joins are as large as the keys that changed, not as the graph.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.extract.imports import export_table, import_table
from symweave.functions.paths import basename
from symweave.graph import Graph
from symweave.operators import conventions, imports, resolve
from symweave.plans.staging import staged


@dataclass(frozen=True)
class Facts:
    """What resolution knows of files beside the graph: imports, exports (see extract.imports) and marks (path, framework)."""

    imports: DataFrame
    exports: DataFrame
    marks: DataFrame

    def frameworks(self) -> list[str]:
        found = {r["framework"] for r in self.marks.select("framework").distinct().collect()}  # names of a fixed list
        return [name for name in conventions.FRAMEWORKS if name in found]


def facts_of(sources: DataFrame) -> Facts:
    """The facts of sources (path, content)."""
    marks = F.array(*[F.when(F.col("content").rlike(mark), F.lit(name)) for name, (_, mark) in conventions.FRAMEWORKS.items()])
    held = sources.filter("path is not null").select("path", F.explode(F.array_compact(marks)).alias("framework"))
    return Facts(staged(import_table(sources), "imports"), staged(export_table(sources), "exports"), staged(held, "marks"))


def replaced(old: Facts, fresh: Facts, paths: DataFrame) -> Facts:
    """old with the facts of paths (path) taken from fresh."""
    both = (getattr(old, t).join(paths.select("path"), "path", "left_anti").select(getattr(fresh, t).columns).unionByName(getattr(fresh, t)) for t in ("imports", "exports", "marks"))
    return Facts(*(staged(df, "facts") for df in both))


def ref_keys(name: Column) -> Column:
    """The keys by which strategies look for a reference's name."""
    return F.array_distinct(F.transform(F.array(name, resolve.last_part(name), basename(name), F.substring_index(name, ".", 1), F.regexp_extract(name, r"^(\w+)(?:\.|::)", 1)), F.lower))


def node_keys() -> Column:
    """The keys by which a symbol is found."""
    return F.array_distinct(F.array(F.lower("name"), F.lower("qualified_name"), F.lower(resolve.last_part(F.col("qualified_name")))))


def importing(changed: DataFrame, facts: tuple[Facts, ...], aliases=()) -> DataFrame:
    """(path, local): imports that may lead to a changed file (path), directly or along re-exports."""

    def tried(table: str) -> DataFrame:
        both = getattr(facts[0], table).select("path", "language", "source", *(["local"] if table == "imports" else []))
        for f in facts[1:]:
            both = both.unionByName(getattr(f, table).select(both.columns))
        both = both.distinct()
        return both.withColumn("target", F.explode(imports.candidates(F.col("path"), F.col("source"), F.col("language"), aliases)))

    passing = staged(tried("exports").select("path", "target").distinct(), "passing")
    reached = frontier = staged(changed.select(F.col("path").alias("target")).distinct(), "reached")
    for _ in range(imports.CHAIN + 1):
        frontier = staged(passing.join(frontier, "target", "left_semi").select(F.col("path").alias("target")).distinct().join(reached, "target", "left_anti"), "reached")
        if frontier.isEmpty():
            break
        reached = reached.unionAll(frontier)
    return tried("imports").join(reached, "target", "left_semi").select("path", "local").distinct()


def concerned(refs: DataFrame, touched: DataFrame, led: DataFrame, imported: DataFrame, fresh: DataFrame) -> DataFrame:
    """The refs to resolve again.  touched: (key) of symbols that came or went; led: (source, line, col) of edges into changed files; imported: see importing; fresh: (path), changed files."""
    keyed = refs.select("ref_id", F.explode(ref_keys(F.col("reference_name"))).alias("key")).join(touched, "key", "left_semi").select("ref_id")
    by_import = refs.select("ref_id", F.col("file_path").alias("path"), F.substring_index("reference_name", ".", 1).alias("local")).join(imported, ["path", "local"], "left_semi").select("ref_id")
    own = refs.join(fresh, refs["file_path"] == fresh["path"], "left_semi").select("ref_id")
    ids = staged(keyed.unionAll(by_import).unionAll(own).distinct(), "concerned")
    # Edges do not name their reference, so references at one place go together.
    place = refs.join(ids, "ref_id", "left_semi").select(F.col("from_node_id").alias("source"), "line", "col").unionAll(led.select("source", "line", "col")).distinct()
    return staged(refs.join(place, _at(refs["from_node_id"], refs, place), "left_semi"), "again")


def _at(node: Column, left: DataFrame, place: DataFrame) -> Column:
    return node.eqNullSafe(place["source"]) & left["line"].eqNullSafe(place["line"]) & left["col"].eqNullSafe(place["col"])


def relevant(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that strategies by name can look at for refs."""
    keys = refs.select(F.explode(ref_keys(F.col("reference_name"))).alias("key")).distinct()
    ids = nodes.select("id", F.explode(node_keys()).alias("key")).join(keys, "key", "left_semi").select("id").distinct()
    return staged(nodes.join(ids, "id", "left_semi"), "relevant")


def resolved_edges(refs: DataFrame, nodes: DataFrame, files: DataFrame, facts: Facts, aliases=(), frameworks: list[str] | None = None) -> DataFrame:
    """Edges of refs, which may be all or some of a graph's; nodes, files and facts are the whole graph's."""
    near = relevant(refs, nodes)
    by_rule = conventions.by_convention(refs, near, facts.frameworks() if frameworks is None else frameworks)
    asked = refs.select(F.col("file_path").alias("path")).distinct()
    named = facts.imports.join(asked, "path", "left_semi").select(facts.imports.columns)
    ends = imports.located(named, files, aliases).select(F.col("target").alias("file_path")).unionAll(imports.located(facts.exports, files, aliases).select(F.col("target").alias("file_path"))).distinct()
    exported = staged(nodes.filter("is_exported").join(ends, "file_path", "left_semi").select(nodes.columns), "exported")
    found = imports.by_import(refs, exported, named, facts.exports, files, aliases)
    won = staged(resolve.resolved(refs, near, by_rule, found), "won")
    # Both ends of the edges, for their kinds.
    ids = won.select(F.col("target").alias("id")).unionAll(refs.select(F.col("from_node_id").alias("id"))).distinct()
    return resolve.edges_of(won, refs, nodes.join(ids, "id", "left_semi"))


def updated(old: Graph, kept: Graph, fresh: Graph, paths: DataFrame, before: Facts, now: Facts, aliases=()) -> Graph:
    """The graph after a change of paths (path): kept is old without them (its edges too), fresh what stands in them now."""
    gone = old.nodes.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    keys = staged(gone.select("name", "qualified_name").unionAll(fresh.nodes.select("name", "qualified_name")).select(F.explode(node_keys()).alias("key")).distinct(), "touched")
    found = old.edges.filter("provenance = 'resolution'")
    led = found.join(gone.select(F.col("id").alias("target")), "target", "left_semi").select("source", "line", "col")
    refs = staged(kept.refs.unionByName(fresh.refs).withColumn("ref_id", F.monotonically_increasing_id()), "refs")
    again = concerned(refs, keys, led, importing(paths, (before, now), aliases), paths.select("path"))
    nodes, files = kept.nodes.unionByName(fresh.nodes), kept.files.unionByName(fresh.files)
    place = again.select(F.col("from_node_id").alias("source"), "line", "col").distinct()
    own = kept.edges.filter("provenance = 'resolution'")
    stay = kept.edges.filter("provenance is null or provenance <> 'resolution'").unionByName(own.join(place, _at(own["source"], own, place), "left_anti"))
    edges = resolved_edges(again, nodes, files, now, aliases).withColumn("edge_id", F.monotonically_increasing_id())
    return Graph(nodes, stay.unionByName(fresh.edges, allowMissingColumns=True).unionByName(edges, allowMissingColumns=True).select(old.edges.columns), files, refs)
