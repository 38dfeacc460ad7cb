"""The graph: four tables that every operator takes, and its edges as bundles where they are products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the tails of a bundle are dealt where its edges are written out.
DEAL = 16


@dataclass(frozen=True)
class Links:
    """Edges: single ones, and bundles, each of which joins all its heads to all its tails.

    single: edges.  heads: (bundle, an edge's columns but for target).  tails: (bundle, target).  No node is a head and a tail of one bundle, and no
    pair of nodes is in two bundles.  kinds: all that heads may have.  Walks and counts go through bundles in as many steps as these have ends.
    """

    single: DataFrame
    heads: DataFrame | None = None
    tails: DataFrame | None = None
    kinds: tuple[str, ...] = ()

    def rows(self) -> DataFrame:
        """Every edge as a row."""
        if self.heads is None:
            return self.single
        return self.single.unionByName(met(self.heads, self.tails, wide=True).select(self.single.columns))

    def of_kind(self, *kinds: str) -> Links:
        """Edges of some kinds; of all kinds without arguments."""
        return self._only(F.col("kind").isin(*kinds), tuple(k for k in self.kinds if k in kinds)) if kinds else self

    def where(self, condition: Column | str) -> Links:
        """Edges that a condition holds for, which must not look at target."""
        return self._only(F.expr(condition) if isinstance(condition, str) else condition, self.kinds)

    def _only(self, condition: Column, kinds: tuple[str, ...]) -> Links:
        single = self.single.filter(condition)
        return Links(single) if self.heads is None or not kinds else Links(single, self.heads.filter(condition), self.tails, kinds)

    def among(self, ids: DataFrame, *ends: str, how: str = "left_semi") -> Links:
        """Edges whose given ends are among ids (column id), or with left_anti are not."""

        def kept(df: DataFrame, end: str) -> DataFrame:
            return df.join(ids.select(F.col("id").alias(end)), end, how).select(df.columns)

        single, heads, tails = self.single, self.heads, self.tails
        for end in ends:
            single = kept(single, end)
        if heads is not None:
            heads, tails = kept(heads, "source") if "source" in ends else heads, kept(tails, "target") if "target" in ends else tails
        return Links(single, heads, tails, self.kinds)

    def touching(self, ids: DataFrame, end: str) -> DataFrame:
        """The edges that have one end in ids (column id), with the columns of ids."""
        found = ids.join(self.single, ids["id"] == self.single[end])
        if self.heads is None:
            return found
        if end == "source":
            through = met(ids.join(self.heads, F.col("id") == F.col(end)), self.tails)
        else:
            through = met(self.heads, ids.join(self.tails, F.col("id") == F.col(end)))
        return found.unionByName(through.select(found.columns))

    def within(self, ids: DataFrame) -> DataFrame:
        """(root, an edge's columns): the edges that have both ends among the ids (root, id) of one root."""
        ends = ids.select("root", "id")
        sources, targets = ends.withColumnRenamed("id", "source"), ends.withColumnRenamed("id", "target")
        found = self.single.join(sources, "source").join(targets, ["root", "target"]).select("root", *self.single.columns)
        if self.heads is None:
            return found
        through = met(self.heads.join(sources, "source"), self.tails.join(targets, "target"), "root", "bundle", wide=True)
        return found.unionByName(through.select(found.columns))

    def ends(self, end: str) -> DataFrame:
        """(id): the sources or the targets of all edges, some of them repeated."""
        found = self.single.select(F.col(end).alias("id"))
        if self.heads is None:
            return found
        near, far = (self.heads, self.tails) if end == "source" else (self.tails, self.heads)
        return found.unionAll(near.join(far.select("bundle").distinct(), "bundle", "left_semi").select(F.col(end).alias("id")))

    def degrees(self, end: str) -> DataFrame:
        """(id, kind, n): how many edges of a kind each node is the given end of."""
        counted = self.single.groupBy(F.col(end).alias("id"), "kind").agg(F.count("*").alias("n"))
        if self.heads is not None:
            if end == "source":
                through = self.heads.join(self.tails.groupBy("bundle").agg(F.count("*").alias("n")), "bundle")
            else:
                through = self.tails.join(self.heads.groupBy("bundle", "kind").agg(F.count("*").alias("n")), "bundle")
            counted = counted.unionAll(through.select(F.col(end).alias("id"), "kind", "n"))
        return counted.groupBy("id", "kind").agg(F.sum("n").alias("n"))

    def union(self, other: Links) -> Links:
        """The edges of both, those of other written out."""
        return Links(self.single.unionByName(other.rows()), self.heads, self.tails, self.kinds)

    def distinct(self, *columns: str) -> Links:
        """These columns of the edges, source and target among them, each combination once."""
        if self.heads is None:
            return Links(self.single.select(*columns).distinct())
        own = [c for c in columns if c != "target"]
        heads, tails, single = self.heads.select("bundle", *own).distinct(), self.tails.select("bundle", "target").distinct(), self.single.select(*columns).distinct()
        # A single edge that a bundle has too is left to the bundle.
        as_head = heads.toDF("bundle", *[f"head_{c}" for c in own])
        same = [F.col(c).eqNullSafe(F.col(f"head_{c}")) for c in own if c != "source"]
        again = single.join(as_head, [F.col("source") == F.col("head_source"), *same]).join(tails, ["bundle", "target"]).select(*columns)
        return Links(single.subtract(again), heads, tails, self.kinds)


def met(heads: DataFrame, tails: DataFrame, *keys: str, wide: bool = False) -> DataFrame:
    """Every row of heads with every row of tails of its bundle (or keys).  Tails are dealt out, heads go to each part, so a large bundle is many tasks' work.

    wide: the result is far larger than both sides, so the partitions are kept as many as the session's setting says, whatever the sides' sizes.
    """
    on = [*(keys or ("bundle",)), "part"]
    dealt = tails.withColumn("part", F.pmod(F.xxhash64(*tails.columns), F.lit(DEAL)).cast("int"))
    spread = heads.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    if wide:
        n = int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread, dealt = spread.repartition(n, *on), dealt.repartition(n, *on)
    return spread.join(dealt, on).drop("part")


def as_links(edges: DataFrame | Links) -> Links:
    return edges if isinstance(edges, Links) else Links(edges)


@dataclass(frozen=True)
class Graph:
    """nodes and edges (a bag: repeats, loops and dangling ids are legal), tracked files and symbolic references.

    bundled: the same edges as edges, where some of them are known as bundles.
    """

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None
    refs: DataFrame | None = None
    bundled: Links | None = None

    @staticmethod
    def of(nodes: DataFrame, links: Links, files: DataFrame | None = None, refs: DataFrame | None = None) -> Graph:
        return Graph(nodes, links.rows(), files, refs, links)

    def of_kind(self, *kinds: str) -> DataFrame:
        """Edges of some kinds; of all kinds without arguments."""
        return self.edges.filter(self.edges["kind"].isin(*kinds)) if kinds else self.edges

    def links(self, *kinds: str) -> Links:
        """The edges of some kinds, bundles as such."""
        return (self.bundled or Links(self.edges)).of_kind(*kinds)

    def linked(self, change: Callable[[Links], Links]) -> Graph:
        """The graph with other edges."""
        return Graph.of(self.nodes, change(self.links()), self.files, self.refs)
