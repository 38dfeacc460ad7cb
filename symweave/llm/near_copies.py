"""Near copies at a Jaccard similarity of 0.8 or more over five-word shingles, for the near-duplicate stage of the pipeline.

SimHash brings texts together: a fingerprint has one bit for each of 1022 random hyperplanes, the side on which the sum of the
shingles' vectors lies, read as 146 pieces of seven bits.  At exactly 0.8, where it is highest, a bit differs with a chance of
0.15, so a piece agrees with one of 0.32.  First, texts that agree in six pieces at once are compared by whole shingle sets, which
joins large groups.  Then all meet under keys of two pieces (three or four where there are many texts), so many that a pair
at 0.8 shares none about once in 10^6 (of three pieces in 10^5); those of other components whose fingerprints are too far apart (LEADING, NEAR: a pair at 0.8 is
once in 10^7) are discarded, the rest is compared by whole shingle sets, so no pair below the limit links.  Keys with many texts
are dealt out as pairs of tiles, and each gives a spanning forest of its links at most, never all pairs.

Defined cases: words are cut at ASCII white space and compared without the case of A-Z; a text of five words or fewer is
one shingle; null and wordless texts are copies of each other and of nothing else; sets are compared by 64-bit hashes;
an empty table gives an empty result; a null doc_id is never the smallest; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.components import components
from symweave.llm.shared import meet, mix, slices, span_hashes, staged, text_bytes, word_spans

SHINGLE, LIMIT, BANDS, BITS, FIRST, WIDE, TILE = 5, (4, 5), 146, 7, 8, 6, 1024
#: Pieces in a key and keys of a text, by the number of texts up to which keys of so many pieces tell enough.
KEYS = ((1 << 21, 2, 240), (1 << 25, 3, 750), (1 << 62, 4, 2400))
#: Rows of keys that are written at a time (or ROUND keys of each text, if that is more), which bounds the disk.
AT_ONCE, ROUND = 1 << 23, 40
#: Of the first 64 and the first 256 bits so many differ at most in a pair that is compared.
LEADING, NEAR = 28, 70
#: Words are compared without the case of A-Z.
LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, end to end, and the n + 1 offsets."""
    data, offsets = text_bytes(column)
    starts, ends, doc = word_spans(data, offsets)
    words = span_hashes(LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=len(column))
    first = np.cumsum(count) - count
    size = np.minimum(count, SHINGLE)
    number = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
    owner = np.repeat(np.arange(len(column)), number)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    hashes = np.zeros(len(owner), np.uint64)
    for k in range(SHINGLE):
        has = k < size[owner]
        hashes[has] = mix(hashes[has] + words[at[has] + k] + _STEP)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(column)))]).astype(np.int64)


def set_hashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each set; zero for the empty one."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes + _STEP), out=total[1:])
    return np.where(at[1:] > at[:-1], mix((total[at[1:]] - total[at[:-1]]) ^ mix((at[1:] - at[:-1]).astype(np.uint64))), 0)


@cache
def _planes() -> np.ndarray:
    """Vectors of shingles, nearly normal numbers made by a rule: 4096 and their negatives; a shingle's hash says which is its own."""
    rows = [np.bitwise_count(mix((np.arange(BANDS * BITS, dtype=np.uint64) + np.uint64(k << 10 | 1)) * _STEP)).astype(np.int16) - np.int16(32) for k in range(4096)]
    return np.concatenate([rows, np.negative(rows)])


def simhashes(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The fingerprint of each set that is not empty, BANDS * BITS bits packed into rows of bytes, in order."""
    planes, own = _planes(), (mix(hashes ^ _STEP) >> np.uint64(51)).astype(np.intp)
    spans = [(x, y) for x, y in zip(at[:-1].tolist(), at[1:].tolist()) if x < y]
    sums = np.zeros((len(spans), planes.shape[1]), np.int32)
    for k, (x, y) in enumerate(spans):
        for z in range(x, y, 1000):  # so few that the sums fit 16 bits
            sums[k] += np.add.reduce(planes[own[z : min(y, z + 1000)]], axis=0, dtype=np.int16)
    return np.packbits(sums > 0, axis=1, bitorder="little")


def pieces(prints: np.ndarray) -> np.ndarray:
    """The BANDS pieces of each fingerprint."""
    bits = np.unpackbits(prints, axis=1, count=BANDS * BITS, bitorder="little").reshape(-1, BANDS, BITS)
    return (bits << np.arange(BITS, dtype=np.uint8)).sum(2, dtype=np.uint8)


def band_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The BANDS pieces of the fingerprint of each set that is not empty, in order."""
    return pieces(simhashes(hashes, at))


def _combinations(parts: int, most: int) -> np.ndarray:
    """The pieces that each key is made of: all pieces serve before one serves again."""
    rng, rows = np.random.Generator(np.random.PCG64(parts)), []
    while len(rows) < most:
        rows += rng.permutation(BANDS)[: BANDS // parts * parts].reshape(-1, parts).tolist()
    return np.array(rows[:most])


def _joined(found: np.ndarray, of: np.ndarray, first: int) -> np.ndarray:
    """Keys (one column each, numbered from first) of the pieces."""
    keys = np.full((len(found), len(of)), 0, np.int64)
    for part in of.T:
        keys = keys << BITS | found[:, part]
    return keys | np.arange(first, first + len(of)) << 48


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, tie (hash of the text), fp (hash of the shingle set), the fingerprint and its wide keys of each document."""
    wide = np.arange(FIRST * WIDE).reshape(FIRST, WIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, at = shingle_sets(batch.column(1))
                prints = simhashes(hashes, at)
                keys = _joined(pieces(prints), wide, 0)
                full = at[1:] > at[:-1]
                ends = np.concatenate([[0], np.cumsum(np.where(full, FIRST, 0))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
                each = iter(prints)
                printed = pa.array([next(each).tobytes() if f else None for f in full.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(set_hashes(hashes, at).view(np.int64)), printed, listed], ["doc_id", "tie", "fp", "print", "keys"]
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tie bigint, fp bigint, print binary, keys array<bigint>")


WORDS = [f"w{k}" for k in range(4)]


def _keyed(prints: DataFrame, of: np.ndarray, first: int, bare: bool = False) -> DataFrame:
    """A row for each key of each fingerprint (fp, root, print): key, fp, root and the first 256 bits, or bare the key alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = _joined(pieces(rows), of, first)
            if bare:
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1))], ["key"])
                continue
            own = [batch.column(0), batch.column(1), *map(pa.array, np.ascontiguousarray(rows[:, :32]).view(np.int64).T)]
            for column in keys.T:
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(column)), *own], ["key", "fp", "root", *WORDS])

    return prints.select("fp", "root", "print").mapInArrow(run, "key bigint" if bare else "key bigint, fp bigint, root bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")


def near_groups(group: np.ndarray, root: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each row the first row that near fingerprints of other components lead to; rows of a group stand together."""
    n = len(group)
    parent, rows, apart = np.arange(n), np.arange(n - 1), 1
    rows = rows[group[rows] == group[rows + 1]]
    while len(rows):
        i = rows[root[rows] != root[rows + apart]]
        i = i[np.bitwise_count(words[0][i] ^ words[0][i + apart]) <= LEADING]
        i = i[sum(np.bitwise_count(w[i] ^ w[i + apart]).astype(np.int64) for w in words) <= NEAR]
        j = i + apart
        while len(i):
            x, y = parent[i], parent[j]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while (parent != (up := parent[parent])).any():
                parent = up
            still = parent[i] != parent[j]
            i, j = i[still], j[still]
        apart += 1
        rows = rows[rows + apart < n]
        rows = rows[group[rows] == group[rows + apart]]
    return parent


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(team, fp, root): near fingerprints of every run of rows with equal slot; runs may cross batches.  Equal teams have one name."""
    held: list[np.ndarray] = []

    def teams(rows: np.ndarray) -> pa.RecordBatch:
        changes = np.ones(len(rows), np.int64)
        changes[1:] = rows[1:, 0] != rows[:-1, 0]
        group = np.cumsum(changes)
        parent = near_groups(group, rows[:, 2], [np.ascontiguousarray(rows[:, 3 + k]).view(np.uint64) for k in range(4)])
        size = np.bincount(parent, minlength=len(rows))[parent]
        at = np.flatnonzero(size > 1)
        mixed = np.zeros(len(rows), np.uint64)
        np.add.at(mixed, parent[at], mix(rows[at, 1].view(np.uint64) + _STEP))
        name = mix(mixed[parent[at]] ^ size[at].astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(rows[at, 1]), pa.array(rows[at, 2])], ["team", "fp", "root"])

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            last = held[-1][-1, 0]
            if held[0][0, 0] == last:
                continue
            rows = np.concatenate(held) if len(held) > 1 else held[0]
            done = int(np.flatnonzero(rows[:, 0] != last)[-1]) + 1
            yield teams(rows[:done])
            held = [rows[done:]]
    if held:
        yield teams(np.concatenate(held))


def _teams(prints: DataFrame) -> DataFrame:
    """(team, fp, root) of all near fingerprints of other components that meet under a key.  prints: fp, root, print, one row a fingerprint."""
    n = prints.count()
    parts, most = next((p, k) for up_to, p, k in KEYS if n <= up_to)
    of, step, found = _combinations(parts, most), max(ROUND, AT_ONCE // max(1, n)), []
    for first in range(0, most, step):
        rows = _keyed(prints, of[first : first + step], first)
        hot = staged(_keyed(prints, of[first : first + step], first, bare=True).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("key", F.ceil(F.col("n") / TILE).alias("tiles"), "n"), "hot")
        dealt = (
            meet(rows, hot, ["key"], "n", how="left")
            .withColumn("tile", F.when(F.col("tiles").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("fp"), F.col("tiles"))))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("tiles") - 1, F.lit(0)))))
            # one number for a key or a pair of its tiles; should two share it, more fingerprints meet than must
            .select(F.when(F.col("tiles").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))).alias("slot"), "fp", "root", *WORDS)
        )
        near = dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(_near, "team bigint, fp bigint, root bigint")
        found.append(staged(near.distinct(), "teams"))
    return reduce(DataFrame.unionAll, found).distinct()


def _sets(docs: DataFrame) -> DataFrame:
    """fp and its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, at = shingle_sets(batch.column(0))
                listed = [hashes[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(hashes, at).view(np.int64)), pa.array(listed, pa.binary())], ["fp", "members"])

    return docs.select("text").mapInArrow(run, "fp bigint, members binary")


def forest(sets: list[np.ndarray], component: np.ndarray) -> list[tuple[int, int]]:
    """Links between rows of different components whose sets reach the limit: a spanning forest of all such links."""
    found: list[tuple[int, int]] = []
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, component = sizes[order], np.unique(component[order], return_inverse=True)[1]
    _, ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(ids.max() + 1, bool)
    up, down = LIMIT
    for i in range(len(order) - 1):
        last = int(np.searchsorted(sizes, sizes[i] * down // up, "right"))  # a larger set is too large
        if last <= i + 1 or (component[i + 1 : last] == component[i]).all():
            continue
        mine = ids[at[i] : at[i + 1]]
        marked[mine] = True
        both = np.add.reduceat(marked[ids[at[i + 1] : at[last]]], at[i + 1 : last] - at[i + 1], dtype=np.int64)
        marked[mine] = False
        linked = i + 1 + np.flatnonzero(both * down >= (sizes[i] + sizes[i + 1 : last] - both) * up)
        joined, where = np.unique(component[linked], return_index=True)
        for c, j in zip(joined, linked[where]):
            if c != component[i]:
                found.append((int(order[i]), int(order[j])))
        component[np.isin(component, joined)] = component[i]
    return found


def _compared(table: pa.Table) -> pa.Table:
    fps = table.column("fp").to_numpy()
    pairs = forest([np.frombuffer(s, np.uint64) for s in table.column("members").to_pylist()], table.column("root").to_numpy())
    return pa.table({"a": pa.array([int(fps[i]) for i, _ in pairs], pa.int64()), "b": pa.array([int(fps[j]) for _, j in pairs], pa.int64())})


def _links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among fingerprints of a key; keys of equal members are not compared again."""
    rows = rows.withColumn("root", F.col("fp"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("who")).filter("n > 1")
    groups = groups.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / TILE).alias("tiles"), "n")
    dealt = (
        meet(rows, groups, ["key"], "n")
        .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        .select("key", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "fp", "root")
    )
    return dealt.join(sets, "fp").groupBy("key", "low", "high").applyInArrow(_compared, "a bigint, b bigint")


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """fp, n and component_id, the smallest doc_id of the component.  nodes: fp, first (smallest doc_id), n; roots: see components()."""
    tied = staged(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "tied")
    least = tied.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    joined = meet(tied.select("root", "fp"), least, ["root"], "size").select("fp", "component_id")
    return nodes.join(joined, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))


def _sets_of(docs: DataFrame, rows: DataFrame, fps: DataFrame) -> DataFrame:
    """fp and its shingle set, for these fps; one document of each is read again."""
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tie")
    wanted = rows.join(fps.select("fp").distinct(), "fp", "left_semi").groupBy("fp").agg(F.min(place).alias("one")).select(F.col("one.doc_id").alias("wanted"), F.col("one.tie").alias("wanted_tie")).distinct()
    read = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted"]) & (F.xxhash64(docs["text"]) == wanted["wanted_tie"]), "left_semi")
    return staged(_sets(read).dropDuplicates(["fp"]), "sets")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text): rows (doc_id, tie, fp, print, keys), nodes (fp, first, n) and the components of linked fps."""
    rows = staged(_signed(docs), "signed")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    keyed = rows.select("fp", F.explode("keys").alias("key")).distinct()
    shared = keyed.groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("key")
    keyed = staged(keyed.join(shared, "key"), "keyed")
    early = staged(_links(keyed, _sets_of(docs, rows, keyed)), "early")
    roots = components(early).withColumnRenamed("node", "fp")
    prints = rows.filter("print is not null").select("fp", "print").dropDuplicates(["fp"])
    teams = staged(_teams(staged(prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "print"), "prints")), "teams")
    late = teams.join(_sets_of(docs, rows, teams), "fp").groupBy("team").applyInArrow(_compared, "a bigint, b bigint")
    return rows, nodes, components(early.union(late))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, fp (hash of the shingle set), component_id (the smallest doc_id reachable over links)."""
    rows, nodes, roots = _classes(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    return meet(rows, named(nodes, roots), ["fp"], "n").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, with all their columns: see simhash.deduplicated."""
    rows, nodes, roots = _classes(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    # Texts of documents that stand alone need no verdict: of each class the least (doc_id, tie) stays, of rows that repeat one.
    group = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")
    many = staged(group.join(group.groupBy("root").agg(F.sum("n").alias("all")).filter("all > 1"), "root").select("fp", "root", "n"), "many")
    inside = meet(rows.select("doc_id", "tie", "fp"), many, ["fp"], "n")
    inside = inside.groupBy("root", "doc_id", "tie").agg(F.count("*").alias("times"))
    place = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "tie")
    inside = staged(inside, "inside")
    best = inside.groupBy("root").agg(F.min(place).alias("best"), F.count("*").alias("size"))
    judged = meet(inside, best, ["root"], "size").select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), place.eqNullSafe(F.col("best")).alias("stays"), (F.col("times") > 1).alias("again"))
    judged = staged(judged.filter("not stays or again"), "judged")
    kept = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("tie"))
    kept = kept.join(judged, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left").filter("stays is null or stays")
    turn = Window.partitionBy("doc_id", "tie").orderBy("again")
    again = kept.filter("again").withColumn("turn", F.row_number().over(turn)).filter("turn = 1")
    return kept.filter("again is null or not again").select("doc.*").unionByName(again.select("doc.*"))
