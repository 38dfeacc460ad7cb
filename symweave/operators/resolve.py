"""Resolution of symbolic references: strategies propose candidates, ranks pick one of each reference.

Names such as `get` have many references and many bearers.  Bearers are first reduced to the best one of each combination of what the score
looks at (name, leading directories, language, kind, exported), so a reference meets a bounded number of candidates,
however often its name occurs.  Ends of paths and of qualified names are looked up by key: what follows a separator, and what stands before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.functions.externals import internal
from symweave.functions.paths import basename, dirname, proximity

CLASSES, CALLABLE = ("class", "struct", "interface"), ("function", "method", "class")
#: Shared directories count up to the cap of proximity points: 15 each, 80 at most.
LEVELS, NEAR, CAP = 6, 15, 80
STRATEGIES = ("file-path", "qualified-name", "instance-method", "exact-match", "fuzzy")

def _first(found: DataFrame, *order: Column) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("ref_id").orderBy(*order))
    return found.withColumn("place", place).filter("place = 1").select("ref_id", "target", "confidence", "resolved_by")


def _rows(found: DataFrame, confidence: Column | float, by: str) -> DataFrame:
    return found.select("ref_id", "target", (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), F.lit(by).alias("resolved_by"))


def _cut(c: Column, separator: str, plain: str) -> tuple[Column, Column]:
    """What stands before the first separator, and the rest with it."""
    head = F.regexp_extract(c, f"^{plain}*", 0)
    return head, F.substring(c, F.length(head) + 1, F.length(c))


def _by_end(wanted: DataFrame, bearers: DataFrame, of: str, separator: str, plain: str, also: str) -> DataFrame:
    """(ref_id, target): the smallest target whose `of` is longer than the reference name and ends with it, both having the same `also`.

    A name is cut at its first separator; a bearer at each of its separators.  Equal rests meet, and there the ends of the part before
    the separator are looked up, so the result is as large as the references, however many bearers end alike.
    """
    head, rest = _cut(F.col("reference_name"), separator, plain)
    wanted = wanted.select("ref_id", also, head.alias("head"), rest.alias("rest"))
    tails = F.regexp_extract_all(of, F.lit(f"(?:{separator}){plain}*"), 0)
    first = F.regexp_extract(of, f"^{plain}*", 0)
    places = F.transform(
        tails, lambda t, i: F.struct(F.when(i == 0, first).otherwise(F.regexp_replace(F.get(tails, i - 1), f"^(?:{separator})", "")).alias("part"), F.array_join(F.slice(tails, i + 1, F.size(tails)), "").alias("rest"), (i > 0).alias("more"))
    )
    cut = bearers.select("target", also, F.explode(places).alias("x")).select("target", also, "x.*").join(wanted.select("rest", also).distinct(), ["rest", also], "left_semi")
    cut = cut.groupBy("rest", also, "part", "more").agg(F.min("target").alias("target"))
    # A proper end of the part, or the whole of it where something stands before.
    ends = F.transform(F.sequence(F.when(F.col("more"), 1).otherwise(2), F.length("part") + 1), lambda k: F.substring("part", k, F.length("part")))
    ends = F.when(F.col("more") | (F.length("part") > 0), ends)
    keys = cut.withColumn("head", F.explode(ends)).groupBy("rest", also, "head").agg(F.min("target").alias("target"))
    return wanted.join(keys, ["rest", also, "head"]).select("ref_id", "target")


def by_file_path(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths: the same path .95, a longer path with that end .85, the only file of that name .7."""
    wanted = refs.filter(F.col("reference_name").contains("/")).select("ref_id", "reference_name", basename(F.col("reference_name")).alias("file"))
    files = nodes.filter("kind = 'file'").select(F.col("id").alias("target"), F.col("name").alias("file"), "file_path", "qualified_name")
    both = files.select("target", "file", F.explode(F.array_distinct(F.array("file_path", "qualified_name"))).alias("path")).filter(basename(F.col("path")) == F.col("file"))
    whole = both.groupBy(F.col("path").alias("reference_name")).agg(F.min("target").alias("target"))
    sole = files.groupBy("file").agg(F.min("target").alias("target"), F.count("*").alias("n")).filter("n = 1")
    found = _rows(wanted.join(whole, "reference_name"), 0.95, "file-path").unionAll(_rows(_by_end(wanted, both, "path", "/", "[^/]", "file"), 0.85, "file-path")).unionAll(_rows(wanted.join(sole, "file"), 0.7, "file-path"))
    return _first(found, F.desc("confidence"), F.asc("target"))


def last_part(name: Column) -> Column:
    """What follows the last :: or dot; single colons, as in routes and selectors, are part of a name."""
    return F.substring_index(F.replace(name, F.lit("::"), F.lit(".")), ".", -1)


def by_qualified_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Qualified names: the only bearer .95; else a qualified name with that end .85."""
    name = F.col("reference_name")
    wanted = refs.filter(name.contains("::") | name.contains(".")).select("ref_id", "reference_name", last_part(name).alias("last"))
    bearers = nodes.select("qualified_name", F.col("id").alias("target"), "name")
    whole = bearers.groupBy(F.col("qualified_name").alias("reference_name")).agg(F.min("target").alias("target"), F.count("*").alias("n"), F.min(F.when(F.col("name") == last_part(F.col("qualified_name")), F.col("target"))).alias("own"))
    met = wanted.join(whole, "reference_name")
    full = _rows(met.filter("n = 1"), 0.95, "qualified-name").unionAll(_rows(met.filter("n > 1 and last <> '' and own is not null").withColumn("target", F.col("own")), 0.85, "qualified-name"))
    # Only bearers of a name that is asked for; cutting at each colon and dot tells ends of names apart to the letter.
    named = bearers.filter((F.col("name") != "") & (F.col("name") == last_part(F.col("qualified_name")))).withColumnRenamed("name", "last").join(wanted.select("last").distinct(), "last", "left_semi")
    part = _rows(_by_end(wanted.filter("last <> ''"), named, "qualified_name", "[:.]", "[^:.]", "last"), 0.85, "qualified-name")
    return _first(full.unionAll(part), F.desc("confidence"), F.asc("target"))


def _words(c: Column) -> Column:
    """Lower-case words of camel case and other separators."""
    cut = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(cut), "[^a-z0-9]+"), lambda w: w != ""))


def by_method_call(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """a.b and a::b: method b of class a .85, of class A .8, the only b of the language .7, the b whose class shares most words with a .65."""
    shape = r"^(\w+)(?:\.|::)(\w+)$"
    name = F.col("reference_name")
    wanted = refs.filter(name.rlike(shape)).select("ref_id", "language", F.regexp_extract(name, shape, 1).alias("receiver"), F.regexp_extract(name, shape, 2).alias("method"))
    methods = nodes.filter("kind = 'method'").select(F.col("id").alias("target"), F.col("name").alias("method"), "qualified_name", "file_path", F.col("language").alias("spoken"))
    classes = nodes.filter(F.col("kind").isin(*CLASSES)).select(F.col("name").alias("receiver"), "file_path", "language").distinct()
    members = methods.join(classes, "file_path").filter(F.col("qualified_name").contains(F.col("receiver"))).groupBy("receiver", "language", "method").agg(F.min("target").alias("target"))
    keys = ["receiver", "language", "method"]
    own = _rows(wanted.join(members, keys), 0.85, "qualified-name")
    capital = F.concat(F.upper(F.substring("receiver", 1, 1)), F.expr("substring(receiver, 2)"))
    typed = _rows(wanted.filter(capital != F.col("receiver")).withColumn("receiver", capital).join(members, keys), 0.8, "instance-method")
    spoken = methods.groupBy("method", F.col("spoken").alias("language")).agg(F.min("target").alias("target"), F.count("*").alias("n"))
    sole = _rows(wanted.join(spoken.filter("n = 1"), ["method", "language"]), 0.7, "instance-method")
    # Several methods of the name: those of the language, or all where it has none.  Equal questions and equal bearers count once, and only those
    # that share a word meet.
    held = wanted.join(spoken.select("method", "language", "n"), ["method", "language"], "left").filter("n is null or n > 1").withColumn("asked", F.array_sort(_words(F.col("receiver"))))
    asks = held.select("method", "language", "n", "asked").distinct().withColumn("word", F.explode("asked"))
    bearers = methods.groupBy("method", "spoken", F.array_sort(_words(F.col("qualified_name"))).alias("words")).agg(F.min("target").alias("target")).withColumn("word", F.explode("words"))
    met = asks.join(bearers, ["method", "word"]).filter("n is null or spoken = language").groupBy("method", "language", "asked", "target", "spoken").agg(F.count("*").alias("shared"))
    met = met.withColumn("score", F.col("shared") + F.when(F.col("spoken") == F.col("language"), 1).otherwise(0)).filter("score >= 2")
    place = F.row_number().over(Window.partitionBy("method", "language", "asked").orderBy(F.desc("score"), "target"))
    best = met.withColumn("place", place).filter("place = 1").select("method", "language", "asked", "target")
    alike = _rows(held.join(best, ["method", "language", "asked"]), 0.65, "instance-method")
    return _first(own.unionAll(typed).unionAll(sole).unionAll(alike), F.desc("confidence"), F.asc("target"))


def _prefixes(path: Column) -> Column:
    """(level, folder): the leading directories of a file, none to LEVELS of them."""
    parts = F.when(dirname(path) == ".", F.array().cast("array<string>")).otherwise(F.split(dirname(path), "/"))
    levels = F.sequence(F.lit(0), F.least(F.size(parts), F.lit(LEVELS)))
    return F.transform(levels, lambda k: F.struct(k.alias("level"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))


def _kind_points(wanted: Column, kind: Column) -> Column:
    calls, makes = kind.isin("function", "method"), kind.isin(*CLASSES)
    return F.when((wanted == "calls") & calls, 25).when((wanted == "instantiates") & makes, 25).when((wanted == "decorates") & calls, 25).when((wanted == "decorates") & kind.isin("class", "interface"), 15).otherwise(0)


def by_exact_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only bearer .9 (.5 in another language); of several the best by place, language, kind: .7 if it is near, else .4."""
    bearers = nodes.select(F.col("name").alias("reference_name"), F.col("id").alias("target"), "file_path", F.col("language").alias("spoken"), "kind", F.coalesce("is_exported", F.lit(False)).alias("open"), "start_line")
    count = bearers.groupBy("reference_name").agg(F.count("*").alias("n"), F.min("target").alias("target"), F.min("spoken").alias("spoken"))
    wanted = refs.select("ref_id", "reference_name", "reference_kind", F.col("file_path").alias("at"), "language", F.col("line").alias("ref_line"))
    sole = _rows(wanted.join(count.filter("n = 1"), "reference_name"), F.when(F.col("spoken") == F.col("language"), 0.9).otherwise(0.5), "exact-match")
    several = wanted.join(count.filter("n > 1").select("reference_name"), "reference_name", "left_semi")
    tongue = F.when(F.col("spoken") == F.col("language"), 50).otherwise(-80)
    rest = tongue + _kind_points(F.col("reference_kind"), F.col("kind")) + F.when(F.col("open"), 10).otherwise(0)
    placed = bearers.withColumn("x", F.explode(_prefixes(F.col("file_path")))).groupBy("reference_name", "x", "spoken", "kind", "open").agg(F.min("target").alias("target"))
    far = several.withColumn("x", F.explode(_prefixes(F.col("at")))).join(placed, ["reference_name", "x"]).withColumn("near", F.least(F.col("x.level") * NEAR, F.lit(CAP)))
    far = far.select("ref_id", "target", "near", (rest + F.col("near")).cast("double").alias("score"))
    nearness = F.when(F.coalesce("start_line", F.lit(0)) > 0, F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.col("ref_line")) / 10)).otherwise(0.0)
    own = several.join(bearers.withColumnRenamed("file_path", "at"), ["reference_name", "at"]).withColumn("near", proximity(F.col("at"), F.col("at")))
    own = own.select("ref_id", "target", "near", (100 + rest + F.col("near") + nearness).cast("double").alias("score"))
    best = F.row_number().over(Window.partitionBy("ref_id").orderBy(F.desc("score"), F.desc("near"), "target"))
    chosen = far.unionAll(own).filter("score > -1").withColumn("place", best).filter("place = 1")
    return sole.unionAll(_rows(chosen, F.when(F.col("near") >= 30, 0.7).otherwise(0.4), "exact-match"))


def by_fuzzy_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Case aside, the only callable of the language .5, or the only one at all where the language has none .3."""
    bearers = nodes.filter(F.col("kind").isin(*CALLABLE)).groupBy(F.lower("name").alias("low"), F.col("language").alias("spoken")).agg(F.min("id").alias("target"), F.count("*").alias("n"))
    wanted = refs.select("ref_id", F.lower("reference_name").alias("low"), "language")
    same = wanted.join(bearers.withColumnRenamed("spoken", "language"), ["low", "language"])
    others = bearers.groupBy("low").agg(F.sum("n").alias("n"), F.min("target").alias("target")).filter("n = 1")
    other = wanted.join(same.select("ref_id"), "ref_id", "left_anti").join(others, "low")
    return _rows(same.filter("n = 1"), 0.5, "fuzzy").unionAll(_rows(other, 0.3, "fuzzy"))


def by_name(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first strategy that finds something, in the order of the functions above."""
    parts = [f(refs, nodes).withColumn("turn", F.lit(k)) for k, f in enumerate((by_file_path, by_qualified_name, by_method_call, by_exact_name, by_fuzzy_name))]
    return _first(reduce(DataFrame.unionAll, parts), F.asc("turn"), F.asc("target"))


def resolved(refs: DataFrame, nodes: DataFrame, *stronger: DataFrame) -> DataFrame:
    """(ref_id, target, confidence, resolved_by), one row a resolved reference.

    stronger: candidates of frameworks and imports in order.  The first of at least .9 wins; else the most confident, the earlier of equals.
    """
    refs = internal(refs, nodes)
    parts = [c.select("ref_id", "target", "confidence", "resolved_by").withColumn("turn", F.lit(k)) for k, c in enumerate((*stronger, by_name(refs, nodes)))]
    sure = F.when((F.col("confidence") >= 0.9) & (F.col("turn") < len(stronger)), F.col("turn"))
    return _first(reduce(DataFrame.unionAll, parts), F.asc_nulls_last(sure), F.desc("confidence"), F.asc("turn"), F.asc("target"))


def edges_of(found: DataFrame, refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with metadata: extends becomes implements where a class meets an interface, calls become instantiates where they meet a class."""
    kinds = nodes.select("id", "kind")
    both = found.join(refs, "ref_id").join(kinds.toDF("target", "target_kind"), "target").join(kinds.toDF("from_node_id", "source_kind"), "from_node_id", "left")
    contract = ("interface", "protocol")
    kind = (
        F.when((F.col("reference_kind") == "extends") & F.col("target_kind").isin(*contract) & F.col("source_kind").isNotNull() & ~F.col("source_kind").isin(*contract), "implements")
        .when((F.col("reference_kind") == "calls") & F.col("target_kind").isin("class", "struct"), "instantiates")
        .otherwise(F.col("reference_kind"))
    )
    return both.select(F.col("from_node_id").alias("source"), "target", kind.alias("kind"), F.struct("confidence", "resolved_by").alias("metadata"), "line", "col", F.lit("resolution").alias("provenance"))


def statistics(refs: DataFrame, found: DataFrame) -> DataFrame:
    """(resolved_by, n): by strategy; 'unresolved' for the rest."""
    return refs.join(found.select("ref_id", "resolved_by"), "ref_id", "left").groupBy(F.coalesce("resolved_by", F.lit("unresolved")).alias("resolved_by")).agg(F.count("*").alias("n"))
