"""Extraction over a DataFrame of files: one row in, one row of symbols, edges, references and issues out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import language_of
from symweave.extract import blocks, markup, python_source, routes
from symweave.extract.model import Found
from symweave.graph import Graph
from symweave.plans.staging import staged
from symweave.sources.tree import hashed
from symweave.schema import EDGES, FILES, NODES, REFS, conform

MOST = 1 << 20
#: Characters of text whose symbols are handed on at once, about; a longer file goes alone.
TOGETHER = 1 << 18
_NODE = "id:string,kind:string,name:string,qualified_name:string,start_line:int,end_line:int,start_column:int,docstring:string,signature:string,visibility:string,is_exported:boolean,is_async:boolean,is_static:boolean"
_EDGE = "source:string,target:string,kind:string,line:int"
_REF = "from_node_id:string,reference_name:string,reference_kind:string,line:int,col:int"
_ERROR = "message:string,file_path:string,line:int,column:int,severity:string,code:string"
SHAPE = f"path string, language string, nodes array<struct<{_NODE}>>, edges array<struct<{_EDGE}>>, refs array<struct<{_REF}>>, errors array<struct<{_ERROR}>>"
_COMPONENTS = {"svelte": markup.component, "vue": markup.component, "liquid": markup.liquid}


def one(path: str, language: str, text: str | None, most: int | None = MOST) -> Found:
    """All of one file.  A file that cannot be read in full, or of over `most` bytes (None: no limit), gives what was found and an issue."""
    found = Found(path, language)
    if text is None:
        found.error("no content", "read_error")
    elif most is not None and len(text.encode("utf-8", "surrogatepass")) > most:
        found.error(f"over {most} bytes", "size_exceeded", severity="warning")
    else:
        try:
            if path.lower().endswith((".dfm", ".fmx")):
                markup.form(found, text)
            elif language == "python":
                python_source.extract(found, text)
            elif language in _COMPONENTS:
                _COMPONENTS[language](found, text)
            elif language in blocks.TABLES:
                blocks.extract(found, text)
            else:
                found.error(language, "unsupported_language", severity="warning")
            routes.extract(found, text)
        except RecursionError as why:
            found.error(str(why), "parse_error")
    return found


def _rows(most: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    fields = {name: [x.split(":")[0] for x in spec.split(",")] for name, spec in (("nodes", _NODE), ("edges", _EDGE), ("refs", _REF), ("errors", _ERROR))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, held = [], 0
            for path, language, text in zip(pdf["path"], pdf["language"], pdf["content"]):
                # A batch may be all files of a task: their symbols, many times the text, are not held at once.
                if out and held + len(text or "") > TOGETHER:
                    yield pd.DataFrame(out, columns=["path", "language", *fields])
                    out, held = [], 0
                f = one(path, language, text, most)
                out.append((path, language, *([{k: row.get(k) for k in keys} for row in getattr(f, name)] for name, keys in fields.items())))
                held += len(text or "")
            yield pd.DataFrame(out, columns=["path", "language", *fields])

    return run


def extracted(sources: DataFrame, most: int | None = MOST) -> DataFrame:
    """sources (path, content) to one row a file; see SHAPE.  Null paths are left out.  most: see one()."""
    known = sources.filter("path is not null").select("path", language_of(F.col("path"), F.col("content")).alias("language"), "content")
    return known.mapInPandas(_rows(most), SHAPE)


def routed(found: DataFrame) -> DataFrame:
    """path, name, handler, line: the handlers of each route in extracted files."""
    # Routes and handlers of a file meet by their ids; a reference does not carry all nodes of its file along.
    routes = F.transform(F.filter("nodes", lambda n: n["kind"] == "route"), lambda n: F.struct(n["id"].alias("id"), n["name"].alias("name"), F.lit(None).cast("string").alias("handler"), F.lit(None).cast("int").alias("line")))
    refs = F.filter("refs", lambda r: r["from_node_id"].startswith("route:"))
    handlers = F.transform(refs, lambda r: F.struct(r["from_node_id"].alias("id"), F.lit(None).cast("string").alias("name"), r["reference_name"].alias("handler"), r["line"].alias("line")))
    both = found.select("path", F.explode(F.concat(routes, handlers)).alias("r")).select("path", "r.*")
    met = both.groupBy("path", "id").agg(F.max("name").alias("name"), F.collect_list(F.when(F.col("line").isNotNull(), F.struct("handler", "line"))).alias("to"))
    return met.select("path", "name", F.explode("to").alias("to")).select("path", "name", "to.handler", "to.line")


def indexed(sources: DataFrame, most: int | None = MOST) -> Graph:
    """The graph of a source tree, with references still to be resolved."""
    found = staged(extracted(sources, most), "extracted")
    now = F.unix_millis(F.current_timestamp())
    nodes = found.select("path", "language", F.explode("nodes").alias("n")).select(F.col("path").alias("file_path"), "language", "n.*").withColumn("updated_at", now)
    edges = found.select(F.explode("edges").alias("e")).select("e.*").withColumn("edge_id", F.monotonically_increasing_id())
    refs = found.select("path", "language", F.explode("refs").alias("r")).select(F.col("path").alias("file_path"), "language", "r.*").withColumn("ref_id", F.monotonically_increasing_id())
    facts = hashed(sources)
    files = found.select("path", "language", F.size("nodes").alias("node_count"), "errors").join(facts, "path").withColumn("indexed_at", now)
    return Graph(conform(nodes, NODES), conform(edges, EDGES), conform(files, FILES), staged(conform(refs, REFS), "refs"))
