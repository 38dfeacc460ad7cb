"""SimHash near-duplicates: pivot distance tables discard pairs, the survivors are verified.

A fingerprint is the bitwise majority of the XXH64 values of a document's word shingles.  Distinct fingerprints
that may link are brought together by 28 equal bits (two fingerprints that differ in at most three of four blocks of
16 bits agree in one of them, and again in one of four blocks of 12 bits of the rest: 16 keys).  Pivot tables alone
give no key to partition by.  Among the fingerprints of a key a table of Hamming distances to reference fingerprints
discards every pair with a coordinate difference over the limit (triangle inequality); the rest is verified by the
distance itself.  Each key gives a spanning forest of its links at most, never all pairs; keys with many
fingerprints are dealt out as pairs of tiles, so no task holds a hot group.

Defined cases: a null or wordless text has fingerprint zero and links like any other; equal texts have one
fingerprint; an empty table gives an empty result; a null doc_id is never the smallest; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.llm import near_copies
from symweave.llm.components import components
from symweave.llm.near_copies import named
from symweave.llm.shared import meet, mix, slices, staged

LIMIT, SEED, SHINGLE, PIVOTS, TILE = 3, 42, 3, 16, 4096
#: The reference fingerprints: evenly mixed words made by a rule.
REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Of a whole text, as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    of = xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    hashes = np.array([of(joined[i:j], SEED) for i, j in zip(starts, ends[shingle - 1 :])], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def _rotated(by: int):
    return F.col("fp") if not by else F.shiftrightunsigned("fp", by).bitwiseOR(F.shiftleft("fp", 64 - by))


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, fp): the 16 keys of each fingerprint."""
    keys = []
    for block in range(4):
        turned = _rotated(16 * block)
        for part in range(4):
            low = turned.bitwiseAND(F.lit(0xFFFF))
            sub = F.shiftrightunsigned(turned, 16 + 12 * part).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(F.lit(4 * block + part).cast("long"), 28).bitwiseOR(F.shiftleft(low, 12)).bitwiseOR(sub))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def forest(groups: np.ndarray, fps: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Links (as index pairs, a spanning forest) among rows of equal group; rows of a group stand together."""
    n = len(fps)
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    parent = np.arange(n)
    rows, apart = np.arange(n - 1), 1
    rows = rows[groups[rows] == groups[rows + 1]]
    while len(rows):
        i, j = rows, rows + apart
        open_ = parent[i] != parent[j]  # joined already: nothing to learn from the pair
        i, j = i[open_], j[open_]
        for p in range(PIVOTS):
            near = np.abs(table[i, p] - table[j, p]) <= limit
            i, j = i[near], j[near]
        linked = np.bitwise_count(fps[i] ^ fps[j]) <= limit
        i, j = i[linked], j[linked]
        while len(i):
            x, y = parent[i], parent[j]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != (up := parent[parent])).any():
                parent = up
            apart_still = parent[i] != parent[j]
            i, j = i[apart_still], j[apart_still]
        apart += 1
        rows = rows[rows + apart < n]
        rows = rows[groups[rows] == groups[rows + apart]]
    child = np.flatnonzero(parent != np.arange(n))
    return child, parent[child]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every run of rows with equal (key, low, high); runs may cross batches."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        changes = np.ones(len(rows), np.int64)
        changes[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
        group = np.cumsum(changes)
        size = np.bincount(group)
        keep = size[group] > 1
        rows, group = rows[keep], group[keep]
        a, b = forest(group, rows[:, 3].view(np.uint64)) if len(rows) else (np.zeros(0, int),) * 2
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 3]), pa.array(rows[b, 3])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            rows = np.concatenate(held) if len(held) > 1 else held[0]
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            done = last[-1] + 1 if len(last) else 0
            if done:
                yield links(np.ascontiguousarray(rows[:done]))
            held = [rows[done:]]
    if held:
        yield links(np.ascontiguousarray(np.concatenate(held)))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints at LIMIT or fewer bits whose components are those of all such links."""
    rows = keyed(nodes)
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).alias("tiles"), "n")
    dealt = (
        meet(rows, hot, ["key"], "n", how="left")
        .withColumn("tile", F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("tiles"))))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("tiles") - 1, F.lit(0)))))
        .select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "fp")
    )
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_linked, "a bigint, b bigint")


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bits: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id reachable over links).

    Links are near copies by whole shingle sets (near_copies), or with bits=LIMIT fingerprints (op9's contract) at that many bits or fewer.
    """
    if bits is None:
        return near_copies.classes(docs, text, doc_id)
    if bits != LIMIT:
        raise ValueError(f"the keys are made for {LIMIT} bits")
    rows = staged(fingerprints(docs, text, doc_id), "fingerprints")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    return meet(rows, named(nodes, components(links(nodes))), ["fp"], "n").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs but for near copies (near_copies) that another row stands for: of each class one row stays, that of the smallest doc_id,
    then of the smallest hash of its text; nulls come last, rows that repeat are copies of each other."""
    return near_copies.deduplicated(docs, text, doc_id)
