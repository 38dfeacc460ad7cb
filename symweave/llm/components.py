"""Connected components of a link table by alternating star contractions, all in distributed tables; the hubs of large
components are broadcast, so their links stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm.shared import meet, staged


def _around(links: DataFrame) -> DataFrame:
    """Each link from both of its ends."""
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


#: Links from which on hubs are looked for; below, one task can hold any hub.
MANY = 1 << 20


def _beside(links: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """links with what least says of their end a."""
    return meet(links, least, ["a"], "n") if many else links.join(least.drop("n"), "a")


def _large_star(links: DataFrame, many: bool) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest node next to it; links have a > b."""
    both = _around(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _beside(both.filter("b > a"), least, many).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()


def _small_star(links: DataFrame, many: bool) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _beside(links, least, many).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a > b").union(least.select("a", F.col("m").alias("b"))).distinct()


def _sign(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every linked node: root is the smallest node of its component.

    links: columns a and b, of one orderable type, without nulls; loops and repeats are allowed.  The number of
    rounds grows with the logarithm of the longest chain; every round is written to the shared folder.
    """
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links")
    before = _sign(links)
    while before[0]:
        links = staged(_small_star(_large_star(links, before[0] > MANY), before[0] > MANY), "links", replaces=(links,))
        now = _sign(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
