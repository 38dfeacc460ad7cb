"""Helpers of the training-data operators: tables in the shared folder and vectorised text kernels."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.plans.staging import scratch, staged

__all__ = ["SPACE", "meet", "mix", "powers", "scratch", "slices", "span_hashes", "staged", "table", "text_bytes", "word_spans"]

#: ASCII white space of every contract: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that a join settles where the left rows are read, at most.
LARGEST = 1024


def meet(left: DataFrame, right: DataFrame, keys: list[str], size: str, how: str = "inner", most: int = LARGEST, rows: int | None = None) -> DataFrame:
    """left with the columns of right (but `size`) on equal keys, nulls being equal; right has one row a key, and in `size` about how many left rows it meets.

    The `most` keys of the largest size are broadcast, so their left rows, however many, are not shuffled; the rest has few rows a key.
    rows: how many rows right has, where that is known; if they are no more than `most`, all of them are broadcast.
    """
    named = {k: f"met_{k}" for k in keys}
    other = right.withColumnsRenamed(named)
    added = [c for c in other.columns if c != size and c not in named.values()]
    large = other.orderBy(F.desc(size), *named.values()).limit(most).select(*named.values(), F.struct(F.lit(True).alias("met"), *added).alias("met"))

    def same(a: DataFrame, b: DataFrame) -> Column:
        return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[m]) for k, m in named.items()])

    if rows is not None and rows <= most:
        return left.join(F.broadcast(other), same(left, other), how).select(*left.columns, *added)
    marked = left.join(F.broadcast(large), same(left, large), "left").select(*left.columns, "met")
    rest = marked.filter("met is null").drop("met")
    rest = rest.join(other, same(rest, other), how).select(*left.columns, *added)
    return marked.filter("met is not null").select(*left.columns, *[F.col("met")[c].alias(c) for c in added]).unionByName(rest)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string (or binary) array, end to end, and the n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string()).fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text (a longer text alone), which bounds working memory."""
    _, at = text_bytes(batch.column(batch.schema.get_field_index(column)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of `letters`, by default [^\\x20\\x09-\\x0D]+) in texts laid end to end, and each word's text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = letters[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^(n-1) and their inverses modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = _powers[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return have[0][:n], have[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in vector operations; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    own = (total[ends] - total[starts]) * down[starts]
    return mix(own ^ mix((ends - starts).astype(np.uint64) + np.uint64(seed)))
