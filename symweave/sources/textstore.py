"""A text index on disk: a row of segments, oldest first, each with its postings and the ids that it takes out of all earlier ones.

An update writes one segment of the rows that differ and touches no other, unless segments have come to be of like sizes: then the newest ones are
written as one, so that each is at least FACTOR times as large as all that follow it.  There are therefore about log(rows) segments, the ids taken
out are less than a third of the index, and a posting is written again log(rows) times in its life.  Segments never change once written: the row of
them is part of what the graph's `current` file tells, so a reader sees the index of its version, and what neither the current version nor the one
before names is swept away.

Defined cases: rows that share an id stand or go together; without a difference nothing is written; an index of no rows has one empty segment.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import textindex
from symweave.plans.staging import staged

#: How much larger a segment is than all later ones together.
FACTOR = 4
POSTINGS, DEAD = "term string, id string, col string, pos int, d int", "dead string"


def held(told: dict, weights: dict[str, float]) -> dict | None:
    """The stored index that told() gives; None where there is none, or one of other columns."""
    text = told.get("text")
    return text if text and text["columns"] == list(weights) else None


def _read(spark: SparkSession, at: str, segment: dict, table: str) -> DataFrame:
    return spark.read.schema(POSTINGS if table == "postings" else DEAD).parquet(f"{at.rstrip('/')}/text/{segment['name']}/{table}")


def _write(postings: DataFrame, dead: DataFrame, at: str) -> dict:
    spark, segment = postings.sparkSession, {"name": f"s-{uuid.uuid4().hex}"}
    for table, df in (("postings", textindex.in_order(postings)), ("dead", dead)):
        df.write.parquet(f"{at.rstrip('/')}/text/{segment['name']}/{table}")
        segment[table] = _read(spark, at, segment, table).count()  # from the footers
    return segment


def _live(spark: SparkSession, at: str, segments: list[dict]) -> DataFrame:
    """The postings of segments without what later ones of them take out."""
    rows = reduce(DataFrame.unionAll, [_read(spark, at, s, "postings").withColumn("place", F.lit(k)) for k, s in enumerate(segments)])
    gone = [_read(spark, at, s, "dead").withColumn("before", F.lit(k)) for k, s in enumerate(segments) if k and s["dead"]]
    if gone:
        dead = reduce(DataFrame.unionAll, gone)
        rows = rows.join(dead, (F.col("id") == F.col("dead")) & (F.col("place") < F.col("before")), "left_anti")
    return rows.drop("place")


def _first(sizes: list[int]) -> int:
    """The segment from which on all become one, so that each is FACTOR times its followers."""
    first, tail = len(sizes) - 1, sizes[-1]
    for k in range(len(sizes) - 2, -1, -1):
        if sizes[k] < FACTOR * tail:
            first = k
        tail += sizes[k]
    return first


def _merged(spark: SparkSession, at: str, segments: list[dict]) -> list[dict]:
    first = _first([s["postings"] + s["dead"] for s in segments])
    late = segments[first:]
    if len(late) == 1:
        return segments
    gone = [_read(spark, at, s, "dead") for s in late if s["dead"]] if first else []
    dead = reduce(DataFrame.unionAll, gone).distinct() if gone else spark.createDataFrame([], DEAD)
    return [*segments[:first], _write(_live(spark, at, late), dead, at)]


def written(rows: DataFrame, at: str) -> dict:
    """Indexes all rows (id and text columns) below `at`; what it returns, as JSON, opens the index."""
    columns = list(textindex.weights_of(rows))
    segment = _write(textindex.postings_of(rows, columns), rows.sparkSession.createDataFrame([], DEAD), at)
    count, tokens = textindex.extent(rows, columns)
    return {"columns": columns, "rows": count, "tokens": tokens, "segments": [segment]}


def updated(text: dict, before: DataFrame, now: DataFrame, at: str) -> dict:
    """The index after the rows `before`, all that it holds of some files, became `now`; only these rows and merged segments are read."""
    spark, columns = before.sparkSession, text["columns"]
    rows = before.select("id", *columns, F.lit(-1).alias("sign")).unionAll(now.select("id", *columns, F.lit(1).alias("sign")))
    differ = rows.groupBy("id", *columns).agg(F.sum("sign").alias("more")).filter("more <> 0").select("id").distinct()
    rows = staged(rows.join(differ, "id", "left_semi"), "differing")
    all_of, more, tokens = rows.agg(F.count("*"), F.sum("sign"), F.sum(F.col("sign") * textindex.length(columns))).first()
    if not all_of:
        return text
    segment = _write(textindex.postings_of(rows.filter("sign = 1"), columns), rows.filter("sign = -1").select(F.col("id").alias("dead")).distinct(), at)
    return text | {"rows": text["rows"] + more, "tokens": text["tokens"] + tokens, "segments": _merged(spark, at, [*text["segments"], segment])}


def opened(spark: SparkSession, text: dict, at: str) -> textindex.TextIndex:
    """The index for search; a question reads the row groups of its terms in each segment, and the ids taken out."""
    return textindex.TextIndex(_live(spark, at, text["segments"]), text["rows"], text["tokens"], {c: textindex.WEIGHTS[c] for c in text["columns"]})


def swept(spark: SparkSession, at: str, *texts: dict | None) -> None:
    """Deletes segments that none of the given indexes names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/text")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = {s["name"] for text in texts if text for s in text["segments"]}
    for found in files.listStatus(path) if files.exists(path) else ():
        if found.getPath().getName() not in kept:
            files.delete(found.getPath(), True)
