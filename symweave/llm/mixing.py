"""Mixing sources to target weights by temperature, realised as block permutations under a budget.

A source's weight is its share of all tokens to the power of an exponent between 0 (all sources alike) and 1 (as they are).
Bisection finds the largest exponent, the mix nearest to the corpus, whose weights reach the target entropy (as a share of the
largest possible one); where the smallest source would then be repeated more often than the limit allows, it finds the smallest
exponent that keeps to the limit instead.  A limit below the budget's share of the corpus cannot be kept by any mix and raises ValueError.

A source of n rows is dealt into about sqrt(n) blocks by a hash of its rows, so neither the blocks of a source nor the rows of a block are many.
Of budget * weight tokens it gives whole passes over its rows and a part of a last pass.  Every pass has a permutation of its own, of the
blocks and of the rows within each; the last pass takes whole blocks in the order of its permutation, and of the block in which the
budget ends the first rows.  Each drawn copy has its pass, the block's place in it and its own position in the block.

Defined cases: a null source is a source of its own; a null or empty text has no tokens: it costs nothing and goes with
its place in the permutation; rows that repeat (same doc_id, same text) are rows of their own with equal keys, and any of them may be
the ones that an extra pass takes; sources without tokens give nothing; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.shared import meet, staged

ENTROPY, REPEATS, SEED = 0.9, 4.0, 20


def tokens(text: Column) -> Column:
    """White-space words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key(*parts: Column | str | int) -> Column:
    """60 bits of the MD5 of the parts, a null as a dash."""
    texts = [F.coalesce(p.cast("string"), F.lit("-")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *texts)), 1, 15), 16, 10).cast("long")


def _mixes(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: entropy of the mix, the largest of weight / share, and the sum of powers; one aggregation over the sources."""
    power = [F.pow("share", F.lit(a)) for a in exponents]
    sums = [x for p in power for x in (F.sum(p), F.sum(p * F.log(p)), F.max(p / F.col("share")))]
    found = shares.agg(*[x.alias(f"x{k}") for k, x in enumerate(sums)]).first()
    return [(math.log(total) - logs / total, most / total, total) for total, logs, most in (found[k : k + 3] for k in range(0, len(found), 3))]


def exponent(shares: DataFrame, entropy: float, repeats: float, budget_share: float) -> float:
    """Found over the table of shares (source, share), to 32 bits; four halvings of the interval are looked up at a time."""
    if repeats < budget_share:
        raise ValueError(f"a budget of {budget_share:g} times the corpus repeats some source more than {repeats:g} times in any mix")
    sources = shares.count()
    goal = entropy * math.log(sources) if sources > 1 else 0.0

    def bisect(holds, upper: bool) -> float:
        low, high = 0.0, 1.0
        for _ in range(8):
            inner = [low + (high - low) * k / 16 for k in range(1, 16)]
            answers = [holds(x) == upper for x in _mixes(shares, inner)]
            stop = answers.index(False) if False in answers else 15
            low, high = ([low, *inner])[stop], ([*inner, high])[stop]
        return low if upper else high

    found = 1.0 if _mixes(shares, [1.0])[0][0] >= goal - 1e-12 else bisect(lambda x: x[0] >= goal, True)
    if _mixes(shares, [found])[0][1] * budget_share > repeats * (1 + 1e-12):
        found = bisect(lambda x: x[1] * budget_share <= repeats, False)
    return found


def weights(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """One row a source with tokens (rows: source, n): its size (rows), total (tokens), weight, passes, rest (tokens of the last pass) and blocks."""
    totals = staged(rows.groupBy("source").agg(F.sum("n").alias("total"), F.count("*").alias("size")).filter("total > 0"), "totals")
    corpus = totals.agg(F.sum("total")).first()[0] or 1
    shares = totals.withColumn("share", F.col("total") / corpus).cache()
    budget = float(corpus) if budget is None else budget
    alpha, scale = 1.0, 1.0
    if not shares.isEmpty():
        alpha = exponent(shares, entropy, repeats, budget / corpus)
        scale = _mixes(shares, [alpha])[0][2]
    shares.unpersist()
    weight = F.pow("share", F.lit(alpha)) / scale
    # Rounded, so that a quota of whole passes is one.
    quota = F.round(weight * budget, 6)
    return shares.select("source", "total", "size", weight.alias("weight"), quota.alias("quota"), F.ceil(F.sqrt("size")).alias("blocks")).select(
        "source", "size", "weight", "blocks", F.floor(F.col("quota") / F.col("total")).cast("int").alias("passes"), (F.col("quota") - F.floor(F.col("quota") / F.col("total")) * F.col("total")).alias("rest")
    )


def _turn(number: Column | str, *what: Column | str) -> Column:
    """What orders blocks, or rows, in a pass."""
    return key(SEED, F.col(number) if isinstance(number, str) else number, *[F.col(x) if isinstance(x, str) else x for x in what])


def blocks(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """One row for each block of each source: passes, its place in every pass (list), and how its rows stand in the last one: `left` tokens of it are
    taken (null: all, 0: none).  rows: source, tie, n."""
    met = meet(rows.select("source", "tie", "n"), mix, ["source"], "size", rows=mix.count())
    sums = met.withColumn("block", F.pmod("tie", "blocks")).groupBy("source", "block", "passes", "rest").agg(F.sum("n").alias("held"))
    turns = sums.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).withColumn("turn", _turn("pass", "source", "block"))
    along = Window.partitionBy("source", "pass").orderBy("turn", "block")
    turns = turns.withColumn("place", F.row_number().over(along)).withColumn("before", F.coalesce(F.sum("held").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    open_ = F.col("rest") - F.col("before")
    left = F.when(F.col("pass") == F.col("passes"), F.when(open_ <= 0, 0.0).when(F.col("held") <= open_, None).otherwise(open_))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pass", "place"))), lambda x: x["place"])
    return turns.withColumn("left", left).groupBy("source", "block", "passes").agg(listed.alias("places"), F.max("left").alias("left"))


def plan(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """rows (any columns besides doc_id, source, tie, n) with weight, block, places and copies: how often each is taken; rows of no copies included."""
    found = staged(blocks(rows, mix), "blocks")
    named = mix.select(F.col("source").alias("of"), "weight", "blocks", "size")
    keyed = meet(rows, named.withColumnRenamed("of", "source"), ["source"], "size", how="left", rows=mix.count()).withColumn("block", F.coalesce(F.pmod("tie", "blocks"), F.lit(-1))).drop("blocks", "size")
    to = found.select(F.col("source").alias("s"), F.col("block").alias("b"), "passes", "places", "left")
    met = keyed.join(to, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    inside = Window.partitionBy("source", "block").orderBy(_turn("passes", "tie"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra = F.when(F.col("passes").isNull(), 0).when(F.col("left").isNull(), 1).when(F.col("left") <= 0, 0).when(F.sum("n").over(inside) <= F.col("left"), 1).otherwise(0)
    return met.withColumn("copies", (F.coalesce("passes", F.lit(0)) + extra).cast("int")).withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("passes", "left")


def _rows(docs: DataFrame, text: str, doc_id: str, source: str, whole: bool) -> DataFrame:
    kept = [F.struct(*[docs[c] for c in docs.columns]).alias("doc")] if whole else []
    return docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), tokens(docs[text]).alias("n"), key(docs[doc_id], F.coalesce(docs[text], F.lit(""))).alias("tie"), *kept)


def _copies(planned: DataFrame) -> DataFrame:
    """A row for each drawn copy, with pass and place (of its block); one with nulls for a row that is not drawn."""
    passes = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1))
    return planned.withColumn("pass", F.explode_outer(passes)).withColumn("place", F.get("places", F.col("pass"))).drop("places")


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """A row for each drawn copy of a row of docs: doc_id, source, n_tokens, weight of the source, copies, and where the copy stands: pass, block (its place
    in the pass) and position in the block, all from 1; a row that is not drawn comes once, with copies 0 and nulls."""
    rows = staged(_rows(docs, text, doc_id, source, False), "sources")
    drawn = _copies(plan(rows, staged(weights(rows, entropy, repeats, budget), "weights")))
    here = Window.partitionBy("source", "block", "pass").orderBy(_turn("pass", "tie"), "doc_id")
    position = F.when(F.col("pass").isNotNull(), F.row_number().over(here))
    return drawn.withColumn("position", position).select("doc_id", "source", F.col("n").alias("n_tokens"), F.round("weight", 9).alias("weight"), "copies", (F.col("pass") + 1).alias("pass"), F.col("place").alias("block"), "position")


def drawn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> DataFrame:
    """The rows of docs as often as the mix takes them, with their columns; rows without copies go.  Blocks stand together, in the order of each pass."""
    slim = staged(_rows(docs, text, doc_id, source, False), "sources")
    mix = staged(weights(slim, entropy, repeats, budget), "weights")
    taken = _copies(plan(_rows(docs, text, doc_id, source, True), mix).filter("copies > 0"))
    return taken.sortWithinPartitions("pass", "source", "place", _turn("pass", "tie")).select("doc.*")
