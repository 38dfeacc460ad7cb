"""Substring de-duplication by relative Lempel-Ziv parsing against an index of all documents' blocks.

Every document is cut into blocks by content: a window of WINDOW words belongs to the GRAM-word gram with the smallest
hash in it (the leftmost of equals), and the windows of one such anchor form a block.  Equal windows belong
to equal anchors, wherever they stand.  The reference is the index of every block of every document by anchor and by content; a
block whose content is indexed twice refers to the first other place of that content.  Where blocks of one anchor have different
contents, a match ends inside: the windows of those that stand alone, and of one block of each content they meet, are compared
word by word and refer to the first other place of the window.

Matches that go on in one reference document at one distance are joined, so they are as long as they can be; each document is then
parsed greedily from left to right into factors (start, length, reference document, reference start): of the matches that
start at or before the next word that is not covered the one that reaches furthest.  A factor keeps the words that it shares with the one before it, so
windows across a boundary are judged by whole matches.  All matches, and so all factors, are WINDOW words or longer; the words
in them are exactly the words in repeated windows.

Contents are compared by two independent 64-bit hashes.  Anchors that a frequent-items sketch finds common are settled by
map-side aggregation; the rest are shuffled by anchor.  Texts are shuffled once.

Defined cases: a null text has no words; texts under WINDOW words keep all of them; rows that repeat (same doc_id, same text, null
doc_ids included) are duplicates of each other and share one verdict, which is held once however many they are; a document can be its own
reference; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.shared import mix, powers, slices, span_hashes, staged, text_bytes, word_spans

WINDOW, GRAM = 35, 8
COMMON, TRACKED = 1024, 8192
#: Odd multipliers of the rolling hashes: of grams, of blocks' contents, of windows (two).
BASES = (0xD6E8FEB86659FD93, 0xE7037ED1A0B428DB, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)


def _prefix(words: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(words) + 1, base)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return total, down


def rolling(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total, down = _prefix(words, base)
    return mix((total[n:] - total[:m]) * down[:m])


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The place of the smallest of each n values, the leftmost of equals."""
    at, reach = np.arange(len(values)), 1
    while reach < n:
        step = min(reach, n - reach)
        a, b = at[:-step] if step < len(at) else at[:0], at[step:]
        at, reach = np.where(values[b] < values[a], b, a), reach + step
    return at


def blocks(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, content hash, first window and number of windows of every block."""
    m = len(words) - window + 1
    if m <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    grams = rolling(words, gram, BASES[0])
    whole = doc[:m] == doc[window - 1 :]
    owner = np.where(whole, least(grams, window - gram + 1)[:m], -1)
    change = np.ones(m, bool)
    change[1:] = owner[1:] != owner[:-1]
    edges = np.flatnonzero(change)
    sizes = np.diff(np.append(edges, m))
    own = owner[edges] >= 0
    first, size = edges[own], sizes[own]
    total, down = _prefix(words, BASES[1])
    content = mix((total[first + size + window - 1] - total[first]) * down[first])
    content = mix(content ^ (size * 64 + owner[first] - first).astype(np.uint64))
    return grams[owner[first]], content, first, size


def _words(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, spans, documents and hashes of all words, and each document's first word."""
    data, offsets = text_bytes(batch.column(at))
    starts, ends, doc = word_spans(data, offsets)
    return data, starts, ends, doc, span_hashes(data, starts, ends), np.searchsorted(doc, np.arange(batch.num_rows + 1))


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copy) and the blocks of each document."""
    for whole in batches:
        for batch in slices(whole, "text"):
            *_, doc, words, base = _words(batch, 2)
            anchor, content, first, size = blocks(words, doc)
            of = doc[first]
            rows = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array((first - base[of]).astype(np.int32)), pa.array(size.astype(np.int32))],
                ["doc_id", "copy", "anchor", "content", "first", "size"],
            )


def _other(low: Column, high: Column) -> Column:
    """The first place of a content that is not here: low, or high where low is this place."""
    here = F.struct("doc_id", "copy", "first")
    return F.when(here.eqNullSafe(low), high).otherwise(low)


def verdicts(index: DataFrame) -> DataFrame:
    """index with full (the block's content occurs twice), open (its windows must be compared one by one) and the place that it refers to."""
    common = staged(index.agg(F.expr(f"approx_top_k(anchor, {COMMON}, {TRACKED})").alias("top")).select(F.explode("top").alias("x")).filter("x.count > 1000").select(F.col("x.item").alias("anchor")), "common")
    here = F.struct("doc_id", "copy", "first")
    # At most COMMON rows are broadcast.
    rare = index.join(F.broadcast(common), "anchor", "left_anti").repartition("anchor")
    same, group = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    rare = (
        rare.withColumn("n", F.count("*").over(same))
        .withColumn("low", F.min(here).over(same))
        .withColumn("high", F.max(here).over(same))
        .withColumn("mixed", F.min("content").over(group) != F.max("content").over(group))
    )
    hot = index.join(F.broadcast(common), "anchor")
    counts = staged(hot.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(here).alias("low"), F.max(here).alias("high")), "contents")
    kinds = counts.groupBy("anchor").agg((F.min("content") != F.max("content")).alias("mixed"))
    # The COMMON most frequent contents are settled where they are read; those left have few rows each.
    heavy = staged(counts.orderBy(F.desc("n"), "anchor", "content").limit(COMMON), "heavy")
    met = hot.join(F.broadcast(heavy), ["anchor", "content"])
    left = hot.join(F.broadcast(heavy), ["anchor", "content"], "left_anti").join(counts, ["anchor", "content"])
    hot = met.unionByName(left).join(F.broadcast(kinds), "anchor")
    keep = ["doc_id", "copy", "first", "size", "n", "low", "high", "mixed"]
    both = rare.select(keep).unionAll(hot.select(keep))
    full, open_ = F.col("n") > 1, F.col("mixed") & ((F.col("n") == 1) | here.eqNullSafe(F.col("low")))
    return both.filter(full | open_).select("doc_id", "copy", "first", "size", full.alias("full"), open_.alias("open"), F.when(full, _other(F.col("low"), F.col("high"))).alias("ref"))


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The elements of lists end to end and the row that each belongs to; a null list is empty."""
    sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.repeat(np.arange(len(column)), sizes)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of open blocks.  Of windows that repeat within a slice the first and the last are sent on: they tell each place in
    between another one.  Rows that repeat stand next to each other and send theirs once: their blocks are known to repeat."""
    before = None
    for whole in batches:
        for batch in slices(whole, "text"):
            *_, words, base = _words(batch, 2)
            one, two = rolling(words, WINDOW, BASES[2]), rolling(words, WINDOW, BASES[3])
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = np.array([k != p for k, p in zip(keys, [before, *keys])])
            before = keys[-1] if keys else before
            found, of = _lists(batch.column(3))
            first, size, open_ = (found.field(x).to_numpy(zero_copy_only=False) for x in ("first", "size", "open"))
            wanted = open_.astype(bool) & new[of]
            first, size, of = first[wanted].astype(np.int64) + base[of[wanted]], size[wanted].astype(np.int64), of[wanted]
            if not len(of):
                continue
            of = np.repeat(of, size)
            at = np.arange(len(of)) + np.repeat(first - np.cumsum(size) + size, size)
            order = np.lexsort((at, two[at], one[at]))
            at, of = at[order], of[order]
            edge = np.ones(len(at) + 1, bool)
            edge[1:-1] = (one[at][1:] != one[at][:-1]) | (two[at][1:] != two[at][:-1])
            opens = np.flatnonzero(edge[:-1])
            sizes = np.diff(np.append(opens, len(at)))
            ends = edge[1:] | edge[:-1]
            # A window between the first and the last of its slice is known to repeat; the first stands for where.
            inner = ~ends
            head = np.repeat(opens, sizes)
            w1 = np.where(inner, mix(one[at] + mix(at.astype(np.uint64))), one[at])
            rows, heads = pa.array(of), pa.array(of[head])
            place = pa.StructArray.from_arrays([batch.column(0).take(heads), batch.column(1).take(heads), pa.array((at[head] - base[of[head]]).astype(np.int32))], ["doc_id", "copy", "first"])
            known = pa.compute.if_else(pa.array(inner), place, pa.nulls(len(at), place.type)) if inner.any() else pa.nulls(len(at), place.type)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(w1.view(np.int64)), pa.array(two[at].view(np.int64)), pa.array((at - base[of]).astype(np.int32)), known],
                ["doc_id", "copy", "w1", "w2", "first", "known"],
            )


def factors(row: np.ndarray, first: np.ndarray, size: np.ndarray, ref: np.ndarray, ref_first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, start, stop, ref, ref_start) of the greedy parse, in words.  In: runs of `size` matched windows from window `first` of a row,
    and where they match: reference document (any number) and window."""
    shift = ref_first - first
    order = np.lexsort((first, shift, ref, row))
    row, first, size, ref, shift = row[order], first[order], size[order], ref[order], shift[order]
    group = np.ones(len(row), bool)
    group[1:] = (row[1:] != row[:-1]) | (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])
    far = 1 << 40
    reach = np.maximum.accumulate(np.cumsum(group) * far + first + size)
    opens = group.copy()
    opens[1:] |= reach[:-1] - np.cumsum(group)[1:] * far < first[1:]  # a gap: the match does not go on
    at = np.flatnonzero(opens)
    last = np.append(at[1:], len(row)) - 1
    stop = (reach - np.cumsum(group) * far)[last] + WINDOW - 1 if len(at) else np.zeros(0, np.int64)
    row, start, ref, shift = row[at], first[at], ref[at], shift[at]
    # Greedy: of what starts at or before the next free word, the furthest.
    order = np.lexsort((ref, -stop, start, row))
    picked, here, free, best = [], -1, 0, -1
    rows, starts, stops = row.tolist(), start.tolist(), stop.tolist()
    for i in order.tolist():
        if rows[i] != here:
            if best >= 0:
                picked.append(best)
            here, free, best = rows[i], starts[i], -1
        while starts[i] > free:
            if best >= 0:
                picked.append(best)
                free, best = stops[best], -1
            else:
                free = starts[i]
        if stops[i] > free and (best < 0 or stops[i] > stops[best]):
            best = i
    if best >= 0:
        picked.append(best)
    picked = np.array(picked, np.int64)
    return row[picked], start[picked], stop[picked], ref[picked], (start + shift)[picked]


def _matches(blocks: pa.Array, singles: pa.Array) -> tuple[np.ndarray, ...]:
    """What factors() takes, and the reference documents that its numbers stand for."""
    found, of = _lists(blocks)
    full = np.flatnonzero(found.field("full").to_numpy(zero_copy_only=False).astype(bool))
    found, of = found.take(pa.array(full)), of[full]
    windows, to = _lists(singles)
    refs = pa.concat_arrays([found.field("ref"), windows.field("ref").cast(found.field("ref").type)])
    key = np.stack([x.fill_null(0).to_numpy(zero_copy_only=False) for x in (refs.field("copy"), pa.compute.is_null(refs.field("doc_id")).cast(pa.int64()))], 1) if len(refs) else np.zeros((0, 2), np.int64)
    names = refs.field("doc_id").dictionary_encode()
    number = np.unique(np.column_stack([key, names.indices.fill_null(-1).to_numpy(zero_copy_only=False)]), axis=0, return_inverse=True)[1].reshape(-1) if len(refs) else np.zeros(0, np.int64)
    of_number = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    of_number[number] = np.arange(len(number))
    first = np.concatenate([found.field("first").to_numpy(zero_copy_only=False), windows.field("first").to_numpy(zero_copy_only=False)]).astype(np.int64)
    size = np.concatenate([found.field("size").to_numpy(zero_copy_only=False).astype(np.int64), np.ones(len(to), np.int64)])
    return np.concatenate([of, to]), first, size, number, refs.field("first").to_numpy(zero_copy_only=False).astype(np.int64), refs.field("doc_id").take(pa.array(of_number))


def parsed(docs: DataFrame, output: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """output "digest": doc_id, n_words, n_removed, kept_sha256; "text": doc_id, kept text and the removed spans of words; "factors": doc_id and its factors."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("copy"), docs[text].alias("text"))
    shape = f"doc_id {kind}, copy bigint, anchor bigint, content bigint, first int, size int"
    index = staged(rows.mapInArrow(_indexed, shape), "blocks")
    # Sets, not lists: rows that repeat have equal verdicts.
    found = staged(verdicts(index).groupBy("doc_id", "copy").agg(F.collect_set(F.struct("first", "size", "full", "open", "ref")).alias("blocks"), F.bool_or("open").alias("any_open")), "verdicts")

    def beside(left: DataFrame, right: DataFrame) -> Column:
        return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["copy"] == right["copy"])

    judged = rows.join(found, beside(rows, found), "left").select(rows["doc_id"], rows["copy"], rows["text"], "blocks", "any_open")
    place = f"struct<doc_id:{kind},copy:bigint,first:int>"
    windows = judged.filter("any_open").select("doc_id", "copy", "text", "blocks").mapInArrow(_compared, f"doc_id {kind}, copy bigint, w1 bigint, w2 bigint, first int, known {place}")
    equal, here = Window.partitionBy("w1", "w2"), F.struct("doc_id", "copy", "first")
    windows = windows.withColumn("n", F.count("*").over(equal)).withColumn("low", F.min(here).over(equal)).withColumn("high", F.max(here).over(equal)).filter("known is not null or n > 1")
    singles = windows.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("first", F.coalesce("known", _other(F.col("low"), F.col("high"))).alias("ref"))).alias("singles"))
    final = judged.join(singles, beside(judged, singles), "left").select(judged["doc_id"], judged["text"], "blocks", "singles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                *matches, refs = _matches(batch.column(2), batch.column(3))
                row, start, stop, ref, ref_start = factors(*matches)
                if output == "factors":
                    cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
                    listed = pa.StructArray.from_arrays([pa.array(start), pa.array(stop - start), refs.take(pa.array(ref)), pa.array(ref_start)], ["start", "length", "ref", "ref_start"])
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cut, listed)], ["doc_id", "factors"])
                    continue
                data, starts, ends, _, _, base = _words(batch, 1)
                raw, words = data.tobytes(), np.diff(base)
                edge = np.zeros(len(starts) + 1, np.int64)
                np.add.at(edge, base[row] + start, 1)
                np.add.at(edge, base[row] + stop, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[base])
                kept, spans = [], []
                for a, b in zip(base[:-1].tolist(), base[1:].tolist()):
                    stay = a + np.flatnonzero(~gone[a:b])
                    left = b" ".join([raw[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())])
                    if output == "digest":
                        kept.append(hashlib.sha256(left).hexdigest())
                    else:
                        kept.append(left.decode())
                        turn = np.diff(np.concatenate([[0], gone[a:b].astype(np.int8), [0]]))
                        spans.append([{"first": x, "stop": y} for x, y in zip(np.flatnonzero(turn > 0).tolist(), np.flatnonzero(turn < 0).tolist())])
                if output == "digest":
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    inner = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(spans, inner)], ["doc_id", "kept", "spans"])

    result = {"digest": "n_words bigint, n_removed bigint, kept_sha256 string", "text": "kept string, spans array<struct<first:bigint,stop:bigint>>", "factors": f"factors array<struct<start:bigint,length:bigint,ref:{kind},ref_start:bigint>>"}
    return final.mapInArrow(run, f"doc_id {kind}, {result[output]}")
