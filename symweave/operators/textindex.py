"""Full-text index over symbols: postings by term, ranked by BM25 with a weight for each column.

Postings are sorted by term when written, so a prefix reads the row groups that can hold it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.plans.staging import staged

# BM25's constants, the floor of a term's weight, and what a hit in each column counts.
K1, B, FLOOR = 1.2, 0.75, 1e-6
WEIGHTS = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
OPERATORS = ("AND", "OR", "NOT", "NEAR")


def tokens(column):
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass(frozen=True)
class TextIndex:
    """postings: (term, id, col, pos, d), d the tokens of the whole row.  rows and tokens: how many there are in all.  weights: by column."""

    postings: DataFrame
    rows: int
    tokens: int
    weights: dict[str, float]


def weights_of(rows: DataFrame) -> dict[str, float]:
    return {c: w for c, w in WEIGHTS.items() if c in rows.columns}


def length(columns) -> Column:
    """How many tokens some columns of a row hold."""
    return sum((F.size(tokens(F.col(c))) for c in columns), F.lit(0))


def postings_of(rows: DataFrame, columns) -> DataFrame:
    """The postings of some columns of rows."""
    cut = rows.select("id", length(columns).alias("d"), *[tokens(F.col(c)).alias(c) for c in columns])
    parts = [cut.select("id", "d", F.lit(c).alias("col"), F.posexplode(c).alias("pos", "term")) for c in columns]
    postings = parts[0]
    for p in parts[1:]:
        postings = postings.unionAll(p)
    return postings.select("term", "id", "col", "pos", "d")


def in_order(postings: DataFrame) -> DataFrame:
    """Sorted by term, as a prefix is read; the rows of a term that most symbols hold are spread by id."""
    return postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def extent(rows: DataFrame, columns) -> tuple[int, int]:
    """How many rows there are and how many tokens they hold."""
    return tuple(rows.agg(F.count("*"), F.coalesce(F.sum(length(columns)), F.lit(0))).first())


def build(rows: DataFrame, weights: dict[str, float] | None = None) -> TextIndex:
    """Indexes the weighted columns of rows (id and text columns)."""
    weights = weights or weights_of(rows)
    return TextIndex(staged(in_order(postings_of(rows, weights)), "postings"), *extent(rows, weights), weights)


def terms_of(text: str) -> list[list[str]]:
    """What a query asks for: phrases, the last word of each a prefix."""
    cleaned = re.sub(r"""['"*():^]""", "", text.replace("::", " "))
    return [p for p in (re.findall(r"[^\W_]+", w.lower()) for w in cleaned.split() if w not in OPERATORS) if p]


def _hits(index: TextIndex, phrases: list[tuple[int, list[str]]]) -> DataFrame | None:
    """(phrase, id, f, d): weighted hits of numbered phrases and the length of the row."""
    hits = None
    weight = F.create_map(*[F.lit(x) for pair in index.weights.items() for x in pair])
    for k, phrase in phrases:
        found = index.postings.filter(F.col("term").startswith(phrase[-1])).select("id", "col", "pos", "d")
        for back, word in enumerate(reversed(phrase[:-1]), 1):
            before = index.postings.filter(F.col("term") == word).select("id", "col", (F.col("pos") + back).alias("pos"))
            found = found.join(before, ["id", "col", "pos"], "left_semi")
        found = found.groupBy("id").agg(F.sum(weight[F.col("col")]).alias("f"), F.max("d").alias("d")).select("id", F.lit(k).alias("phrase"), "f", "d")
        hits = found if hits is None else hits.unionAll(found)
    return hits


def _scored(index: TextIndex, phrases: list[tuple[int, list[str]]]) -> DataFrame | None:
    """(phrase, id, part): each phrase's share of a row's score."""
    hits = _hits(index, phrases)
    if hits is None or not index.tokens:
        return None
    total, mean = index.rows, index.tokens / index.rows
    hits = staged(hits, "hits")
    rarity = hits.groupBy("phrase").agg(F.count("*").alias("n")).select("phrase", F.greatest(F.log((F.lit(total) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(FLOOR)).alias("idf"))
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("d") / mean))
    # rarity has one row a phrase of the query.
    return hits.join(F.broadcast(rarity), "phrase").select("phrase", "id", part.alias("part"))


def ranked(index: TextIndex, text: str) -> DataFrame:
    """(id, score): rows that hold any phrase of the query, by BM25."""
    parts = _scored(index, list(enumerate(terms_of(text))))
    if parts is None:
        return index.postings.sparkSession.createDataFrame([], "id string, score double")
    return parts.groupBy("id").agg(F.sum("part").alias("score"))


def ranked_each(index: TextIndex, words: list[str]) -> DataFrame:
    """(asked, id, score): ranked() for each of many queries, in one pass."""
    phrases, of = [], []
    for w in words:
        for phrase in terms_of(w):
            phrases.append((len(phrases), phrase))
            of.append(w)
    parts = _scored(index, phrases)
    if parts is None:
        return index.postings.sparkSession.createDataFrame([], "asked string, id string, score double")
    return parts.groupBy(F.get(F.array(*map(F.lit, of)), F.col("phrase")).alias("asked"), "id").agg(F.sum("part").alias("score"))
