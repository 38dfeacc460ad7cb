"""Exploration under an output budget: scoring files, clustering lines, ranking clusters, packing them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.graph import Links, as_links, met


@dataclass(frozen=True)
class OutputBudget:
    """How much an exploration may print."""

    characters: int
    files: int
    per_file: int
    gap: int
    symbols: int
    per_kind: int


# Budgets by the number of tracked files.
TIERS = (
    (500, OutputBudget(18000, 5, 3800, 8, 6, 6)),
    (5000, OutputBudget(13000, 6, 2500, 10, 8, 8)),
    (15000, OutputBudget(35000, 12, 7000, 15, 15, 15)),
    (None, OutputBudget(38000, 14, 7000, 15, 15, 15)),
)
#: Projects under so many files get no closing notes.
SMALL = 500
CALLS = ((500, 1), (5000, 2), (15000, 3), (25000, 4), (None, 5))


def _tier(table: tuple, files: int):
    return next(value for under, value in table if under is None or files < under)


def budget_for(files: int) -> OutputBudget:
    return _tier(TIERS, files)


def calls_for(files: int) -> int:
    return _tier(CALLS, files)


def file_scores(kept: DataFrame, edges: DataFrame | Links) -> DataFrame:
    """(file_path, score, n): 10 for a root, 3 for a neighbour of a root, 1 for anything else; only files of 3 points or more."""
    roots, links = kept.filter("is_root").select("id"), as_links(edges)
    near = links.among(roots, "target").ends("source").unionAll(links.among(roots, "source").ends("target")).distinct().withColumn("near", F.lit(True))
    points = F.when(F.col("is_root"), 10).when(F.col("near"), 3).otherwise(1)
    found = kept.join(near, "id", "left").groupBy("file_path").agg(F.sum(points).alias("score"), F.count("*").alias("n"))
    return found.filter("score >= 3").orderBy(F.desc("score"), F.desc("n"), "file_path")


def clusters(ranges: DataFrame, gap: int | Column, key: str = "file_path") -> DataFrame:
    """(key, start, end, n, weight): ranges (key, start, end, weight) that lie within `gap` lines of each other as one.

    The largest end so far, over the ranges before, tells where a new cluster starts; a running sum numbers the clusters.
    """
    order = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.lit(gap) if isinstance(gap, int) else gap
    marked = ranges.withColumn("opens", F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0))
    numbered = marked.withColumn("cluster", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "cluster").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sum("weight").alias("weight")).drop("cluster")


def line_ranges(nodes: DataFrame, edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """(file_path, start, end, weight): symbols' lines and the lines where edges start; symbols over half of their file are left out.

    lengths: (file_path, lines).
    """
    own = nodes.join(lengths, "file_path").filter("kind not in ('file', 'import') and (end_line - start_line + 1) * 2 <= lines or is_root")
    own = own.select("file_path", F.col("start_line").alias("start"), F.col("end_line").alias("end"), F.when(F.col("is_root"), 10).otherwise(1).alias("weight"))
    at = edges.filter("line > 0").join(nodes.select(F.col("id").alias("source"), "file_path"), "source").select("file_path", F.col("line").alias("start"), F.col("line").alias("end"), F.lit(1).alias("weight"))
    return own.unionAll(at)


def ranked_clusters(found: DataFrame, key: str = "file_path") -> DataFrame:
    """Clusters with their place in the file: by importance, then density, then score, then the shorter span."""
    span = F.col("end") - F.col("start") + 1
    order = Window.partitionBy(key).orderBy(F.desc(F.col("weight") >= 10), F.desc(F.round(F.col("n") / span, 9)), F.desc("weight"), span, "start")
    return found.withColumn("place", F.row_number().over(order))


def packed(found: DataFrame, most: int, size: str = "size", key: str = "file_path") -> DataFrame:
    """found with taken: clusters in order of place as long as they fit; one that does not is passed over.  The clusters of a file are folded in one expression."""
    rows = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("place"), F.col(size).cast("long").alias("size"), F.struct(*found.columns).alias("row")))).alias("rows"))
    none = F.array().cast("array<boolean>")

    def fold(state: Column, row: Column) -> Column:
        fits = row["size"] <= state["left"]
        return F.struct((state["left"] - F.when(fits, row["size"]).otherwise(0)).alias("left"), F.concat(state["taken"], F.array(fits)).alias("taken"))

    folded = F.aggregate("rows", F.struct(F.lit(most).cast("long").alias("left"), none.alias("taken")), fold, lambda state: state["taken"])
    return rows.select(F.explode(F.arrays_zip("rows", folded.alias("taken"))).alias("x")).select("x.rows.row.*", "x.taken")


def relationships(edges: DataFrame | Links, nodes: DataFrame, cap: int) -> DataFrame:
    """(kind, source_name, target_name, place): edges by kind, `cap` of each.

    The first edges of a bundle lie among its first `cap` heads of a kind and its first `cap` tails: any later end has as many earlier edges before it.
    """
    names, links = nodes.select("id", "name"), as_links(edges).where("kind <> 'contains'")
    sources, targets, columns = names.toDF("source", "source_name"), names.toDF("target", "target_name"), ["kind", "source", "target", "source_name", "target_name"]
    both = links.single.join(sources, "source").join(targets, "target").select(columns)

    def first(df: DataFrame, by: list[str], *order: str) -> DataFrame:
        return df.distinct().withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("at") <= cap).drop("at")

    if links.heads is not None:
        heads = first(links.heads.join(sources, "source").select("bundle", "kind", "source", "source_name"), ["bundle", "kind"], "source_name", "source")
        tails = first(links.tails.join(targets, "target").select("bundle", "target", "target_name"), ["bundle"], "target_name", "target")
        both = both.unionAll(met(heads, tails).select(columns))
    place = F.row_number().over(Window.partitionBy("kind").orderBy("source_name", "target_name", "source", "target"))
    return both.distinct().withColumn("place", place).filter(F.col("place") <= cap).select("kind", "source_name", "target_name", "place")


def numbered_lines(sources: DataFrame, found: DataFrame, padding: int = 3) -> DataFrame:
    """(path, line, text): lines of the clusters (file_path, start, end) with padding around them, each line once."""
    lines = sources.select("path", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line", F.col("at") + 1)
    spans = found.select(F.col("file_path").alias("path"), (F.col("start") - padding).alias("a"), (F.col("end") + padding).alias("b"))
    return lines.join(spans, "path").filter("line between a and b").select("path", "line", "text").distinct()


def numbered_text(rows: list) -> list[str]:
    """Collected lines (line, text) with their numbers; a gap is marked."""
    out, before = [], None
    for r in rows:
        if before is not None and r["line"] > before + 1:
            out.append("   ...")
        out.append(f"{r['line']:>5} {r['text']}")
        before = r["line"]
    return out


def notes(files: int, shown: int, others: list, facts: list, trimmed: set[str]) -> list[str]:
    """What an exploration left out, and how many more the project's size allows; small projects get only what was cut."""
    out = []
    if files >= SMALL:
        if others:
            names = {r["file_path"]: ", ".join(f"{x['name']}:{x['start_line']}" for x in facts if x["file_path"] == r["file_path"]) for r in others}
            out.append("Further files\n" + "\n".join(f"  {path}: {listed}" for path, listed in names.items()))
        out.append(f"The relevant parts of {shown} files are shown above. At most {calls_for(files)} explorations are advised for {files} files.")
    elif trimmed:
        out.append("Parts of these files were left out: " + ", ".join(sorted(trimmed)))
    return out


def truncated(text: str, most: int = 15000) -> str:
    """The text up to a line's end, if one lies in the last fifth of what is allowed."""
    if len(text) <= most:
        return text
    cut = text.rfind("\n", 0, most)
    return text[: cut if cut > 0.8 * most else most] + "\n\n... (output truncated)"


def listing(rows: Iterator) -> str:
    """A small collected result as lines: kind, name, place."""
    return "\n".join(f"{r['kind']} {r['name']} ({r['file_path']}:{r['start_line']})" for r in rows)
