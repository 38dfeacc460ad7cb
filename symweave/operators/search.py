"""Symbol search: full text, then parts of names, then near spellings; ranked by several signals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.words import Query, edit_distance, kind_points, name_points, parse_query, path_points
from symweave.operators.textindex import TextIndex, ranked, ranked_each
from symweave.plans.staging import staged


def wanted(query: Query, kinds: Iterable[str] = (), languages: Iterable[str] = ()) -> Column:
    """Kinds and languages, of the call and of the query line together; path and name parts."""
    kinds, languages = [*kinds, *query.kinds], [*languages, *query.languages]
    keep = F.lit(True)
    if kinds:
        keep &= F.col("kind").isin(kinds)
    if languages:
        keep &= F.col("language").isin(languages)
    for column, parts in (("file_path", query.paths), ("name", query.names)):
        if parts:
            any_of = F.lit(False)
            for p in parts:
                any_of |= F.lower(column).contains(p.lower())
            keep &= any_of
    return keep


def filter_only(nodes: DataFrame, keep: Column, limit: int) -> DataFrame:
    return nodes.filter(keep).orderBy("name", "id").limit(limit).withColumn("score", F.lit(1.0))


def by_part(nodes: DataFrame, text: str) -> DataFrame:
    """Names or qualified names that hold the text: 1 for the name itself, .9 for a prefix, .8 inside, .7 in the qualified name."""
    low, name = text.lower(), F.lower("name")
    held = name.contains(low) | F.lower("qualified_name").contains(low)
    score = F.when(name == low, 1.0).when(name.startswith(low), 0.9).when(name.contains(low), 0.8).when(F.lower("qualified_name").contains(low), 0.7).otherwise(0.5)
    return nodes.filter(held).withColumn("score", score)


def by_spelling(nodes: DataFrame, text: str, names: int = 50, each: int = 5) -> DataFrame:
    """Names at one edit (two for words over four letters): at most `names` of them, nearest first, with at most `each` rows a name."""
    low = text.lower()
    most = 1 if len(low) <= 4 else 2
    word = F.lower("name")
    near = nodes.filter(F.length("name").between(len(low) - most, len(low) + most)).select("name").distinct().withColumn("d", edit_distance(word, F.lit(low), most)).filter(F.col("d") <= most)
    near = near.orderBy("d", "name").limit(names)
    place = F.row_number().over(Window.partitionBy("name").orderBy("file_path", "start_line", "id"))
    return nodes.join(near, "name").withColumn("place", place).filter(F.col("place") <= each).withColumn("score", 1.0 / (1 + F.col("d"))).select(*nodes.columns, "score")


def rescored(found: DataFrame, text: str) -> DataFrame:
    """Adds points of kind, path and name to the score."""
    return found.withColumn("score", F.col("score") + kind_points(F.col("kind")) + path_points(F.col("file_path"), text) + name_points(F.col("name"), text))


def search(nodes: DataFrame, index: TextIndex, line: str, limit: int = 10, kinds: Iterable[str] = (), languages: Iterable[str] = ()) -> DataFrame:
    """The `limit` best symbols for a query line, with score; ties by id.

    Full-text hits; where there are none, names that hold the text; where there are none, near spellings.  Symbols named like a word of the
    query join the hits with the best score so far.  Path and name filters hold before the cut.
    """
    query = parse_query(line)
    keep = wanted(query, kinds, languages)
    if not query.text:
        return filter_only(nodes, keep, limit)
    own = nodes.filter(keep)
    found = staged(own.join(ranked(index, query.text), "id"), "found")
    if found.isEmpty() and len(query.text) > 1:
        found = staged(by_part(own, query.text), "found")
    if found.isEmpty() and len(query.text) > 2:
        found = staged(by_spelling(own, query.text, max(2 * limit, 50)), "found")
    best = found.agg(F.max("score")).first()[0]
    words = [w.lower() for w in query.text.split() if len(w) > 1]
    if best is not None and words:
        place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy("id"))
        same = own.filter(F.lower("name").isin(words)).withColumn("place", place).filter("place <= 20").drop("place").withColumn("score", F.lit(best))
        found = found.unionByName(same.join(found.select("id"), "id", "left_anti").select(found.columns))
    return rescored(found, query.text).orderBy(F.desc("score"), "id").limit(limit)


def search_each(nodes: DataFrame, index: TextIndex, words: list[str], limit: int, kinds: Iterable[str] = ()) -> DataFrame:
    """search() for many single words at once: their rows with a column `asked`.  A word goes on to the next channel where the one before found nothing."""
    words = list(dict.fromkeys(w for w in words if w))
    own = nodes.filter(F.col("kind").isin(list(kinds))) if (kinds := list(kinds)) else nodes
    asked = nodes.sparkSession.createDataFrame([(w,) for w in words], "asked string")
    hits = ranked_each(index, words)
    found = staged(own.join(hits, "id").select(*own.columns, "score", "asked"), "found")

    def open_words(done: DataFrame) -> list[str]:
        return [r[0] for r in asked.join(done.select("asked").distinct(), "asked", "left_anti").collect()]  # words of one question

    left = open_words(found)
    for channel, least in ((by_part, 2), (by_spelling, 3)):
        more = None
        for w in left:
            if len(w) >= least:
                part = (channel(own, w) if channel is by_part else channel(own, w, max(2 * limit, 50))).withColumn("asked", F.lit(w))
                more = part if more is None else more.unionByName(part)
        if more is not None:
            more = staged(more, "found")
            found = found.unionByName(more)
            left = [w for w in open_words(found) if w in left]
    best = found.groupBy("asked").agg(F.max("score").alias("score")).filter(F.length("asked") > 1)
    place = F.row_number().over(Window.partitionBy("asked").orderBy("id"))
    same = own.join(best, F.lower("name") == F.lower("asked")).withColumn("place", place).filter("place <= 20").drop("place")
    found = found.unionByName(same.join(found.select("id", "asked"), ["id", "asked"], "left_anti").select(found.columns))
    points = F.lit(0)
    for w in words:
        points = F.when(F.col("asked") == w, path_points(F.col("file_path"), w) + name_points(F.col("name"), w)).otherwise(points)
    scored = found.withColumn("score", F.col("score") + kind_points(F.col("kind")) + points)
    place = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= limit).drop("place")


def by_exact_names(nodes: DataFrame, names: list[str], limit: int = 50) -> DataFrame:
    """Symbols of the given names; those in a file of a distinctive name (one that stands in under ten files) score 20 more; each name
    gets its share of the limit, eight at least."""
    rows = nodes.filter(F.lower("name").isin([n.lower() for n in names])).withColumn("low", F.lower("name"))
    spread = rows.groupBy("low").agg(F.countDistinct("file_path").alias("files")).filter("files < 10").select("low")
    special = rows.join(spread, "low", "left_semi").select("file_path").distinct().withColumn("special", F.lit(20.0))
    scored = rows.join(special, "file_path", "left").withColumn("score", 1.0 + F.coalesce("special", F.lit(0.0)))
    cap = max(8, -(-limit // max(1, len(names))))
    place = F.row_number().over(Window.partitionBy("low").orderBy(F.desc("score"), "id"))
    return scored.withColumn("place", place).filter(F.col("place") <= cap).orderBy(F.desc("score"), "id").limit(limit).select(*nodes.columns, "score")


def by_name_part(nodes: DataFrame, part: str, limit: int = 50, not_prefix: bool = False) -> DataFrame:
    """Names that hold the part, shortest first; with not_prefix, not at their start."""
    low = F.lower("name")
    found = nodes.filter(low.contains(part.lower()))
    if not_prefix:
        found = found.filter(~low.startswith(part.lower()))
    return found.orderBy(F.length("name"), "name", "id").limit(limit)
