"""python -m symweave VERB ...: index, sync, status, query, files, node, callers, callees, impact, context, explore, affected, scan."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from symweave import render
from symweave.project import Project
from symweave.sources import tree


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="symweave", description=__doc__)
    parser.add_argument("verb", choices="index sync status query files node callers callees impact context explore affected scan".split())
    parser.add_argument("words", nargs="*")
    parser.add_argument("--root", default=".")
    parser.add_argument("--graph", default=".symweave")
    parser.add_argument("--depth", type=int)
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--style", default="markdown")
    parser.add_argument("--filter")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    project, text = Project(spark, a.root, a.graph), " ".join(a.words)
    if a.verb == "index":
        project.index()
        project.status().orderBy("measure", "value").show(100, False)
    elif a.verb == "scan":
        tree.summary(tree.listed(spark, a.root)).orderBy(F.desc("n")).show(100, False)
    elif a.verb == "sync":
        project.sync().orderBy("path").show(100, False)
    elif a.verb == "status":
        project.status().orderBy("measure", "value").show(100, False)
    elif a.verb == "query":
        project.search(text, a.limit).select("kind", "name", "file_path", "start_line", "score").show(a.limit, False)
    elif a.verb == "files":
        print(render.files_view(project.graph.files, a.style if a.style in ("flat", "grouped") else "tree", text, a.filter, a.depth))
    elif a.verb == "node":
        print(render.node_details(project.graph.nodes.join(project.symbols(text).select("id"), "id", "left_semi")))
    elif a.verb in ("callers", "callees"):
        getattr(project, a.verb)(text, a.depth or 1).show(100, False)
    elif a.verb == "impact":
        nodes, _ = project.impact(text, a.depth or 3)
        nodes.join(project.graph.nodes.select("id", "kind", "name", "file_path"), "id").orderBy("dist", "file_path", "name").show(100, False)
    elif a.verb == "context":
        print(render.context(*project.context(text), a.style))
    elif a.verb == "explore":
        print(project.explore(text))
    elif a.verb == "affected":
        found = project.affected(a.words or sys.stdin.read().split(), a.depth or 5, a.filter)
        print("\n".join(r["path"] for r in found.filter("is_test").orderBy("path").collect()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
