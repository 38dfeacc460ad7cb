"""Graphs on disk: Parquet tables in a directory, written as a whole and swapped in by one rename.

The graph that a save replaces stays until the next save, for those who read it; one writer at a time holds the lock,
which ends a while after the last sign of a writer that is gone.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.errors import StoreError, log
from symweave.graph import Graph
from symweave.schema import EDGES, FILES, NODES, REFS, conform
from symweave.sources import textstore

VERSION = 6
#: Tables beside the graph that a sync needs, see operators.delta.
FACTS = ("imports", "exports", "marks")
TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "refs": REFS}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(fs, at, text: str, over: bool) -> None:
    out = fs.create(at, over)
    out.write(bytearray(text.encode()))
    out.close()


def _got(fs, at) -> str | None:
    """What a small file holds; None where there is none."""
    try:
        stream = fs.open(at)
    except Py4JJavaError:
        if fs.exists(at):
            raise
        return None
    text = bytes(stream.readAllBytes()).decode()
    stream.close()
    return text


#: Seconds after which a lock whose holder gave no sign is no longer held.
LEASE = 120.0


def _signed(fs, path) -> int:
    """When a file was last written, in milliseconds; 0 where there is none."""
    try:
        return fs.getFileStatus(path).getModificationTime()
    except Py4JJavaError:
        return 0


@contextlib.contextmanager
def locked(spark: SparkSession, root: str, lease: float = LEASE) -> Iterator[Callable[[], None]]:
    """Holds the root's lock and gives a sign four times a lease; raises StoreError where another writer has it.

    A lock without a sign for a whole lease, by the clock of the file system, is taken over: one rename decides between several who try.  Gives a
    function that raises StoreError where the lock is no longer one's own, to be called before anything is made current.
    """
    root = root.rstrip("/")
    path_of, fs = _fs(spark, root)
    at, mine = path_of(f"{root}/lock"), uuid.uuid4().hex
    sign = path_of(f"{root}/sign-{mine}")

    def holder(path=at) -> str | None:
        try:
            return _got(fs, path)
        except Py4JJavaError:  # just being written
            return None

    def own() -> None:
        if holder() != mine:
            raise StoreError("the lock was taken over by another writer", root=root)

    def take() -> bool:
        try:
            _put(fs, at, mine, False)
        except Py4JJavaError:
            if not fs.exists(at):
                raise
            return False
        return True

    def free() -> None:
        """Removes the lock where its holder is gone."""
        of = holder()
        _put(fs, sign, "", True)
        seen = _signed(fs, at)
        if of is None or not seen or _signed(fs, sign) - max(seen, _signed(fs, path_of(f"{root}/sign-{of}"))) <= lease * 1000:
            return
        aside = path_of(f"{root}/lock-{mine}")
        if fs.rename(at, aside):
            if holder(aside) != of:  # another took it over first: it gets its lock back
                fs.rename(aside, at)
            else:
                fs.delete(aside, False)
                fs.delete(path_of(f"{root}/sign-{of}"), False)

    if not take():
        try:
            free()
            if not take():
                raise StoreError(f"another writer holds {at.toString()}; its lock ends {lease:g} seconds after its last sign", root=root)
        except BaseException:
            fs.delete(sign, False)
            raise
    done = threading.Event()

    def renew() -> None:
        while not done.wait(lease / 4):
            try:
                _put(fs, sign, "", True)
            except Exception as why:  # noqa: BLE001 the next turn tries again; own() decides
                log.warning("the lock at %s was not renewed: %s", root, why)

    beat = threading.Thread(target=renew, daemon=True)
    beat.start()
    try:
        yield own
    finally:
        done.set()
        beat.join()
        fs.delete(sign, False)
        if holder() == mine:
            fs.delete(at, False)


def save(graph: Graph, root: str, facts: dict[str, DataFrame] | None = None, told: dict | None = None, text: Callable[[DataFrame, str], dict] | None = None) -> None:
    """Writes all tables under a new name, then makes it the current one: readers see the old graph or the new one.

    facts: further tables that stand beside the graph, read by facts(); told: what told() gives of this version, as JSON.
    text: writes what a search needs of the written nodes below the root, see textstore; told() gives its answer as "text".

    Nodes are sorted by name within language directories and edges by source, so lookups read few row groups.
    """
    spark, root = graph.nodes.sparkSession, root.rstrip("/")
    with locked(spark, root) as own:
        name = f"v-{uuid.uuid4().hex}"
        base = f"{root}/{name}"
        conform(graph.nodes, NODES).repartitionByRange("language", "name").sortWithinPartitions("language", "name").write.partitionBy("language").parquet(f"{base}/nodes")
        conform(graph.edges, EDGES).repartitionByRange("source").sortWithinPartitions("source").write.parquet(f"{base}/edges")
        for table in ("files", "refs"):
            df = getattr(graph, table)
            (conform(df, TABLES[table]) if df is not None else spark.createDataFrame([], TABLES[table])).write.parquet(f"{base}/{table}")
        for table, df in (facts or {}).items():
            df.write.parquet(f"{base}/facts/{table}")
        told = dict(told or {})
        if text:
            told["text"] = text(conform(spark.read.parquet(f"{base}/nodes"), NODES), root)
        was = _current(spark, root) or {}
        before = was.get("name")
        own()
        _swap(spark, root, json.dumps({"name": name, "version": VERSION, "told": told}))
        path_of, fs = _fs(spark, root)
        for old in fs.listStatus(path_of(root)):
            found = old.getPath().getName()
            if found.startswith("v-") and found not in (name, before):
                fs.delete(old.getPath(), True)
        textstore.swept(spark, root, told.get("text"), (was.get("told") or {}).get("text"))


def _swap(spark: SparkSession, root: str, content: str) -> None:
    """Puts content in the file `current`, by one rename."""
    path_of, fs = _fs(spark, root)
    fresh = path_of(f"{root}/current-{uuid.uuid4().hex}")
    _put(fs, fresh, content, False)
    sc, to = spark.sparkContext, path_of(f"{root}/current")
    if fs.exists(to) and fs.getFileStatus(to).isDirectory():
        fs.delete(to, True)
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fresh = fs.makeQualified(fresh)
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), sc._jsc.hadoopConfiguration())
    files.rename(fresh, fs.makeQualified(to), how)


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the current version."""
    row = _current(spark, root)
    return row and row["name"]


def told(spark: SparkSession, root: str) -> dict:
    """What was saved with the current version beside its tables; empty for graphs of version 5 and before."""
    return (_current(spark, root) or {}).get("told") or {}


def facts(spark: SparkSession, root: str, *tables: str) -> list[DataFrame] | None:
    """Tables that were saved beside the current graph; None where it has none, as graphs of version 5 and before."""
    row = _current(spark, root)
    if not row or row["version"] < 6:
        return None
    base = f"{root.rstrip('/')}/{row['name']}/facts"
    path_of, fs = _fs(spark, base)
    return [spark.read.parquet(f"{base}/{t}") for t in tables] if all(fs.exists(path_of(f"{base}/{t}")) for t in tables) else None


def _current(spark: SparkSession, root: str) -> dict | None:
    path_of, fs = _fs(spark, root)
    at = path_of(f"{root.rstrip('/')}/current")
    if not fs.exists(at):
        return None
    if fs.getFileStatus(at).isDirectory():  # as versions up to 4 wrote it
        row = spark.read.schema("name string, version int").json(at.toString()).first().asDict()
    else:
        row = json.loads(_got(fs, at))
    if row["version"] > VERSION:
        raise ValueError(f"the graph at {root} has version {row['version']}, newer than {VERSION}")
    return row


def cleared(spark: SparkSession, root: str) -> None:
    """Removes the graph and all versions at root."""
    drop(spark, root)


def optimized(spark: SparkSession, root: str) -> None:
    """Writes the current graph anew, in sorted files of an even size."""
    held = facts(spark, root, *FACTS)
    save(load(spark, root), root, dict(zip(FACTS, held, strict=True)) if held else None, told(spark, root))


def load(spark: SparkSession, root: str) -> Graph:
    name = current(spark, root)
    if not name:
        raise FileNotFoundError(f"no graph at {root}")
    return Graph(*(conform(spark.read.parquet(f"{root.rstrip('/')}/{name}/{t}"), TABLES[t]) for t in ("nodes", "edges", "files", "refs")))


def drop(spark: SparkSession, path: str) -> None:
    path_of, fs = _fs(spark, path)
    fs.delete(path_of(path), True)


def stored(graph: Graph, fresh: Graph) -> tuple[Graph, DataFrame]:
    """graph with the files of fresh whose hash is new; and those files (path)."""
    old = graph.files.select("path", F.col("content_hash").alias("old"))
    new = fresh.files.join(old, "path", "left").filter(F.col("old").isNull() | (F.col("old") != F.col("content_hash"))).select("path")
    from symweave.streaming.changes import synced

    changes = new.withColumn("change", F.lit("modified"))
    return synced(graph, fresh, changes), new
