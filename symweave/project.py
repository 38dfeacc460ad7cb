"""One source tree and its graph: index, sync, search, walk, explore."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.extract import frame
from symweave.graph import Graph
from symweave import config, render
from symweave.functions.paths import language_of
from symweave.operators import analytics, context, delta, explore, imports, lookups, search, symbols, textindex, traversal
from symweave.plans.staging import staged
from symweave.schema import CONTAINERS
from symweave.sources import store, textstore, tree
from symweave.streaming import changes


def linked(graph: Graph, facts: delta.Facts, aliases=()) -> Graph:
    """graph (as extracted) with an edge for each reference that resolves: by framework convention, by import, by name."""
    edges = delta.resolved_edges(graph.refs, graph.nodes, graph.files, facts, aliases).withColumn("edge_id", F.monotonically_increasing_id())
    return Graph(graph.nodes, graph.edges.unionByName(edges, allowMissingColumns=True), graph.files, graph.refs)


def build(sources: DataFrame, aliases=()) -> Graph:
    """The full graph of sources (path, content)."""
    return linked(frame.indexed(sources), delta.facts_of(sources), aliases)


def rebuilt(graph: Graph, sources: DataFrame, found: DataFrame, before: delta.Facts, aliases=()) -> tuple[Graph, delta.Facts]:
    """graph and its facts brought up to sources: only changed files (found: path, change) are read, and only the references that they can concern are resolved
    again, unless the project's frameworks are others now.  The result equals a full build."""
    paths = found.select("path").distinct()
    changed = sources.join(found.filter("change <> 'removed'").select("path"), "path", "left_semi")
    fresh = frame.indexed(changed)
    facts = delta.replaced(before, delta.facts_of(changed), paths)
    kept = lookups.without_files(graph, paths)
    if before.frameworks() == facts.frameworks():
        return delta.updated(graph, kept, fresh, paths, before, facts, aliases), facts
    refs = staged(kept.refs.unionByName(fresh.refs).withColumn("ref_id", F.monotonically_increasing_id()), "refs")
    own = kept.edges.filter("provenance is null or provenance <> 'resolution'")
    return linked(Graph(kept.nodes.unionByName(fresh.nodes), own.unionByName(fresh.edges), kept.files.unionByName(fresh.files), refs), facts, aliases), facts


def searched(nodes: DataFrame) -> DataFrame:
    """What the text index holds of nodes."""
    return nodes.filter("kind <> 'file'").select("id", *textindex.WEIGHTS)


#: Files that name a project's path aliases, the first that is there.
ALIAS_FILES = ("tsconfig.json", "jsconfig.json")


class Project:
    """A graph kept at `at` for the tree at `root`; settings come from the tree's own file where it has one (see config)."""

    def __init__(self, spark: SparkSession, root: str, at: str, settings: config.Config | None = None):
        self.spark, self.root, self.at = spark, root, at
        self.settings = settings or config.load(root)
        self._graph: Graph | None = None
        self._index: textindex.TextIndex | None = None

    def sources(self) -> DataFrame:
        """The files that belong to the project."""
        found = tree.read(self.spark, self.root, self.settings.include, self.settings.exclude, self.settings.most)
        if self.settings.languages:
            found = found.filter(language_of(F.col("path"), F.col("content")).isin(*self.settings.languages))
        return found

    def aliases(self) -> list:
        """Path aliases of the project's own settings for its compiler."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(ALIAS_FILES) + "}").load(self.root.rstrip("/"))
        found = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in raw.filter(~F.col("path").contains("/node_modules/")).select("path", F.length("path").alias("n"), F.decode("content", "UTF-8").alias("text")).orderBy(F.desc("n")).limit(64).collect()}
        return next((imports.aliases_of(found[name]) for name in ALIAS_FILES if name in found), [])

    def _saved(self, graph: Graph, facts: delta.Facts, aliases: list, text) -> None:
        store.save(graph, self.at, {t: getattr(facts, t) for t in store.FACTS}, {"aliases": aliases}, text)
        self._graph = self._index = None

    def index(self) -> Graph:
        sources, aliases = self.sources(), self.aliases()
        facts = delta.facts_of(sources)
        self._saved(linked(frame.indexed(sources), facts, aliases), facts, aliases, lambda nodes, at: textstore.written(searched(nodes), at))
        return self.graph

    def sync(self) -> DataFrame:
        """Brings the graph up to date; returns the changes (path, change). The result equals a full index.

        Only changed files are read; a graph without facts (of an earlier version), or of other path aliases, is indexed anew.
        """
        sources = self.sources()
        now = tree.hashed(sources)
        found = staged(changes.changed(self.graph.files, now), "changes")
        held, aliases = store.facts(self.spark, self.at, *store.FACTS), self.aliases()
        same = held is not None and json.dumps(store.told(self.spark, self.at).get("aliases")) == json.dumps(aliases)
        if not same:
            self.index()
        elif not found.isEmpty():
            self._saved(*rebuilt(self.graph, sources, found, delta.Facts(*held), aliases), aliases, self._retexted(found))
        return found

    def _retexted(self, found: DataFrame):
        """What brings the stored text index up to the nodes of the changed files; the whole index where none is stored."""
        text, old = textstore.held(store.told(self.spark, self.at), textindex.WEIGHTS), self.graph.nodes
        paths = found.select(F.col("path").alias("file_path")).distinct()

        def run(nodes: DataFrame, at: str) -> dict:
            if text is None:
                return textstore.written(searched(nodes), at)
            return textstore.updated(text, searched(old.join(paths, "file_path", "left_semi")), searched(nodes.join(paths, "file_path", "left_semi")), at)

        return run

    @property
    def graph(self) -> Graph:
        self._graph = self._graph or store.load(self.spark, self.at)
        return self._graph

    @property
    def text(self) -> textindex.TextIndex:
        """The stored index; graphs of an earlier version are indexed for the session."""
        if self._index is None:
            text = textstore.held(store.told(self.spark, self.at), textindex.WEIGHTS)
            self._index = textindex.build(searched(self.graph.nodes)) if text is None else textstore.opened(self.spark, text, self.at)
        return self._index

    def search(self, line: str, limit: int = 10) -> DataFrame:
        return search.search(self.graph.nodes, self.text, line, limit)

    def symbols(self, symbol: str) -> DataFrame:
        """(root, id) of every node that a symbol may mean."""
        return self.graph.nodes.filter(lookups.matches_symbol(symbol)).select(F.col("id").alias("root"), "id")

    def callers(self, symbol: str, depth: int = 1) -> DataFrame:
        return traversal.callers(self.graph, self.symbols(symbol), depth)

    def callees(self, symbol: str, depth: int = 1) -> DataFrame:
        return traversal.callees(self.graph, self.symbols(symbol), depth)

    def impact(self, symbol: str, depth: int = 3) -> tuple[DataFrame, DataFrame]:
        return traversal.merged_impact(self.graph, self.symbols(symbol), depth)

    def context(self, question: str, budget: context.Budget = context.Budget()) -> tuple[DataFrame, DataFrame]:
        return context.relevant(self.graph, self.text, question, budget)

    def affected(self, paths: list[str], depth: int = 5, pattern: str | None = None) -> DataFrame:
        return analytics.affected(self.graph, self.spark.createDataFrame([(p,) for p in paths], "path string"), depth, pattern)

    def status(self) -> DataFrame:
        return analytics.statistics(self.graph)

    def find(self, symbol: str):
        """(node, note): the one node that a symbol means; see symbols.find."""
        return symbols.find(self.graph.nodes, self.text, symbol)

    def find_all(self, symbol: str):
        return symbols.find_all(self.graph.nodes, self.text, symbol)

    def details(self, symbol: str) -> str:
        """What is known of a symbol; a container with its members."""
        found, note = self.find(symbol)
        if found is None:
            return f'no symbol "{symbol}"'
        node = lookups.node(self.graph, found["id"])
        text = render.node_details(node)
        if found["kind"] in CONTAINERS:
            held = traversal.children(self.graph, node.select(F.col("id").alias("root"), "id")).select("id")
            text = render.outline(node.first(), self.graph.nodes.join(held, "id", "left_semi"))
        return text + (f"\n\n{note}" if note else "")

    def explore(self, question: str) -> str:
        """What a question is about, as text within the budget of the project's size: a summary, relationships, numbered lines of the files that matter
        most, clustered and packed, and what was left out."""
        count = self.graph.files.count()
        allowed = explore.budget_for(count)
        kept, edges = context.relevant(self.graph, self.text, question, context.Budget(8, 3, 200, 0.2))
        kept = staged(kept.join(self.graph.nodes.select("id", "start_line", "end_line"), "id"), "kept")
        scores = explore.file_scores(kept, edges).limit(allowed.files + 10).collect()
        shown, others = scores[: allowed.files], scores[allowed.files :]
        wanted = self.spark.createDataFrame([(r["file_path"],) for r in shown], "file_path string")
        sources = self.sources().join(F.broadcast(wanted), F.col("path") == F.col("file_path"), "left_semi").select("path", "content")
        lines = sources.select(F.col("path").alias("file_path"), F.size(F.split("content", "\n")).alias("lines"), F.length("content").alias("letters"))
        at = self.graph.edges.select("source", "target", "kind", "line").join(edges.select("source", "target", "kind"), ["source", "target", "kind"], "left_semi")
        clusters = explore.ranked_clusters(explore.clusters(explore.line_ranges(kept, at, lines), allowed.gap))
        sized = clusters.join(lines, "file_path").withColumn("size", F.ceil((F.col("end") - F.col("start") + 7) * (F.col("letters") / F.col("lines") + 6)))
        packed = staged(explore.packed(sized, allowed.per_file), "packed")
        numbered = explore.numbered_lines(sources, packed.filter("taken")).orderBy("path", "line").limit(allowed.characters).collect()
        facts = kept.orderBy("file_path", "start_line").collect()
        trimmed = {r["file_path"] for r in packed.filter("not taken").select("file_path").distinct().collect()}
        related = explore.relationships(edges, self.graph.nodes, allowed.per_kind).collect()
        parts = [context.summary(kept, edges)]
        if related:
            parts.append("Relationships\n" + "\n".join(f"  {r['source_name']} {r['kind']} {r['target_name']}" for r in related))
        for r in shown:
            path = r["file_path"]
            head = f"{path} ({r['score']})\n" + explore.listing([x for x in facts if x["file_path"] == path][: allowed.symbols])
            parts.append("\n".join([head, *explore.numbered_text([x for x in numbered if x["path"] == path])]))
        return explore.truncated("\n\n".join(parts + explore.notes(count, len(shown), others, facts, trimmed)), allowed.characters)
