"""Exact de-duplication with a heavy-hitter split, in DataFrame and SQL functions only.

A Misra-Gries summary (Spark's mergeable frequent-items sketch behind ``approx_top_k``) proposes at most
``k`` frequent digests.  An exact count keeps those that really are frequent; these at most ``k`` winners,
with their smallest doc_id, are broadcast, so rows of huge groups are settled where they are read.  Only the
remaining rows, whose groups are small, are shuffled by digest.

Defined cases: a null text equals the empty text; white-space runs equal one space (ends are not trimmed);
a null doc_id sorts last; of rows that repeat the smallest doc_id one row stays; an empty table gives an
empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.shared import staged

K, TRACKED = 256, 8192


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(normalised(text).cast("binary"), 256)


def winners(digests: DataFrame, least: int) -> DataFrame:
    """(text_sha256, keep_id, group_size) of digests that the summary proposes and that have at least `least` rows; K rows at most."""
    proposed = digests.agg(F.expr(f"approx_top_k(text_sha256, {K}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("text_sha256"))
    return digests.join(F.broadcast(proposed), "text_sha256").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter(F.col("group_size") >= least)


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(docs.select(docs[doc_id].alias("doc_id"), digest(docs[text]).alias("text_sha256")), "digests")
    heavy = staged(winners(rows, least), "heavy")
    known = rows.join(F.broadcast(heavy), "text_sha256")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = Window.partitionBy("text_sha256").orderBy("doc_id")
    settled = known.filter(~stays).withColumn("kept", F.lit(False))
    first = known.filter(stays).withColumn("kept", F.row_number().over(again) == 1)
    group = Window.partitionBy("text_sha256")
    rest = (
        rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
        .withColumn("keep_id", F.min("doc_id").over(group))
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("kept", F.row_number().over(group.orderBy(F.col("doc_id").asc_nulls_last())) == 1)
    )
    shape = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return rest.select(shape).unionAll(settled.select(shape)).unionAll(first.select(shape))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that tie on the smallest doc_id one stays."""
    # The whole row travels as one struct, so its columns may have any names.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[doc_id].alias("doc_id"), digest(docs[text]).alias("text_sha256"))
    heavy = staged(winners(staged(rows.drop("doc"), "digests"), least).select("text_sha256", "keep_id"), "heavy")
    pick = Window.partitionBy("text_sha256").orderBy(F.col("doc_id").asc_nulls_last())
    # Rows of a heavy group that do not stay are dropped before the shuffle; a heavy group whose doc_ids are all null has no keep_id.
    left = rows.join(F.broadcast(heavy), "text_sha256", "left").filter(F.col("keep_id").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return left.withColumn("place", F.row_number().over(pick)).filter("place = 1").select("doc.*")
