"""What the two text classifiers share: a bounded sample of labelled rows and hashed terms of whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.shared import slices, text_bytes

#: Labelled rows that a classifier is fitted on at most; the rows with the smallest hashes of their doc_id.
SAMPLE = 8192

Terms = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the doc_id as text, modulo `by`; -1 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % by, F.lit(-1))


def sample(labels: DataFrame, label: str, usable: Column, most: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of at most `most` labelled rows; of several labels of a doc_id the largest counts, null labels do not."""
    known = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    one = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def training_rows(docs: DataFrame, chosen: DataFrame, terms: Terms, text: str = "text") -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and distinct terms of the chosen documents, in order of doc_id; of rows with one doc_id the least text counts, so the sample bounds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, offsets = text_bytes(batch.column(2))
                doc, bucket = terms(data, offsets)
                pairs = np.unique(doc.astype(np.int64) << 32 | bucket)
                cut = np.searchsorted(pairs, np.arange(batch.num_rows + 1, dtype=np.int64) << 32)
                found = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["doc_id", "y", "terms"])

    # The sample has `most` rows of two numbers at most, so it may be broadcast.
    rows = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy(F.col("doc_id").cast("long").alias("doc_id"), "y").agg(F.min("text").alias("text"))
    got = rows.mapInArrow(run, "doc_id bigint, y int, terms array<int>").toArrow().combine_chunks().sort_by("doc_id")
    if not got.num_rows:
        return np.zeros(0), []
    lists = got.column("terms").combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    return got.column("y").to_numpy().astype(float), [flat[a:b] for a, b in zip(at, at[1:])]


def scored(text: Column, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """The score of each text; score takes the bytes and offsets of some texts.  Only the texts go to Python."""

    def run(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        found = [score(*text_bytes(part.column(0))) for part in slices(batch, "text")]
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}  # not as strings, for Spark
    return F.arrow_udf(run, "double")(text)


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that best maps margins to labels (Newton steps, smoothed targets)."""
    if not len(y):
        return 1.0, 0.0
    up, n = y.sum(), len(y)
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (n - up + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1, 4 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
