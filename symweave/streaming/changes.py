"""What changed in a source tree, and when to act on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from symweave.graph import Graph
from symweave.operators.lookups import without_files

QUIET = "2 seconds"


def changed(tracked: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): added, modified or removed; both sides have path and content_hash."""
    a, b = tracked.select("path", F.col("content_hash").alias("old")), current.select("path", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def synced(graph: Graph, fresh: Graph, changes: DataFrame) -> Graph:
    """graph with the changed files taken from fresh: what stood in changed and removed files goes, what fresh has in added and modified ones comes.

    References stay, so every reference whose candidates changed can be resolved again; the result equals a full rebuild.
    """
    kept = without_files(graph, changes.select("path"))
    now = changes.filter("change <> 'removed'").select("path")
    here = now.select(F.col("path").alias("file_path"))
    nodes = fresh.nodes.join(here, "file_path", "left_semi").select(graph.nodes.columns)
    edges = fresh.links().among(nodes, "source")
    # Edges from untouched files into rebuilt ones come from fresh too: their sources stand, their targets were replaced.
    into = fresh.links().among(kept.nodes, "source").among(nodes, "target")
    files = graph.files and kept.files.unionByName(fresh.files.join(now, "path", "left_semi").select(graph.files.columns))
    refs = graph.refs and kept.refs.unionByName(fresh.refs.join(here, "file_path", "left_semi").select(graph.refs.columns))
    return Graph(kept.nodes.unionByName(nodes), kept.edges.unionByName(edges.rows()).unionByName(into.rows()).select(graph.edges.columns), files, refs)


def debounced(events: DataFrame, quiet: str = QUIET, by: str | None = None) -> DataFrame:
    """(start, end, n): bursts of events (ts) that no quiet stretch parts: each event puts the end off. by: a column that keeps bursts apart."""
    keys = [F.session_window("ts", quiet).alias("burst"), *([F.col(by)] if by else [])]
    found = events.groupBy(*keys).agg(F.count("*").alias("n"))
    return found.select(*([by] if by else []), F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "n")


def watch(events: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, quiet: str = QUIET, late: str = "10 seconds") -> StreamingQuery:
    """Runs `act` on the closed bursts of a stream of events (ts, path). Bursts close once the watermark has passed them."""
    # A stream's sessions need a key; this one has a single value and is no constant to the optimizer.
    keyed = events.withColumn("tree", F.when(F.col("ts").isNotNull(), 0)).withWatermark("ts", late)
    bursts = debounced(keyed, quiet, "tree").drop("tree")
    return bursts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(act).start()
