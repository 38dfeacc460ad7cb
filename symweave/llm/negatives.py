"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A further component sqrt(M^2 - |v|^2) gives all vectors the norm M of the longest one; with 0 there, a query q is at a distance d from v with
d^2 = |q|^2 + M^2 - 2 score.  So a window of scores is an annulus around the query, and higher scores are nearer.

The tree is fitted on a bounded sample (`sample` rows, the first by a hash); its vantage points and radii, at most `leaves` of them, are broadcast.  Every row
goes to its leaf (cell), and the smallest and largest distance of all rows of a cell to each vantage point on its way are kept: by the triangle
inequality they bound the scores of a cell's rows.  A query visits cells nearest first within its annulus, in rounds of 1, 8 and all further
cells; after each round, what cannot hold a better row than the k-th found is out.  Results are exact, whatever the sample.

Rows of a cell lie in blocks of about BLOCK rows, dealt out by a hash, the queries of a cell in groups of about TILES * TILE; a unit of work is one block
and one group, and returns the k best rows of each query and window.  So neither a cell with a third of all rows nor one that all queries visit is in one
task.  Rows and queries meet in their units by a shuffle: vectors that repeat are small as Parquet, so a join that goes by that size would broadcast them
all.  Only the tree, counts of cells and the hashes that bound the sample pass through the driver.

Defined cases: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; shorter vectors count as filled up with
zeros; rows that repeat, with equal vec_ids too, are rows of their own, and an anchor's row is no partner of itself; scores beyond 64 bits end at
their limits; a negative positive_score has an empty window; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symweave.llm.shared import staged

SAMPLE, LEAVES, BLOCK, TILE = 2048, 128, 4096, 512
#: Tiles of queries in a unit of work, which scores them one tile at a time.
TILES = 8
#: Cells that a query visits before the first, second and third look at what it has found; then all that are left.
ROUNDS = (1, 8)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def rows_of(vectors: DataFrame, scale: float, every: int, vec_id: str, vector: str, label: str) -> DataFrame:
    """row, vec_id, label and the scaled components of the rows that take part."""
    own = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("int").alias("label"), vectors[vector].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return own.select(F.monotonically_increasing_id().alias("row"), "vec_id", moved, F.transform("x", lambda x: x * F.lit(float(scale))).alias("x"))


def _matrix(arrays: pd.Series, width: int) -> np.ndarray:
    """Floored components, one row a vector, filled up with zeros."""
    out = np.zeros((len(arrays), width))
    for k, x in enumerate(arrays):
        out[k, : len(x)] = x
    return np.floor(out)


def _stored(m: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.ascontiguousarray(m)]


def _read(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), width)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, within 64 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(exact[0] @ exact[1].T, LOW, HIGH).astype(np.int64)


class Tree:
    """Vantage points with radii; node k has the children 2k + 1 (within its radius) and 2k + 2, a node without a radius is a cell."""

    def __init__(self, sample: np.ndarray, longest: float, leaves: int) -> None:
        self.longest, self.point, self.radius = longest, {}, {}
        self.width = sample.shape[1]
        depth, todo = max(0, int(np.log2(leaves))), [(0, np.arange(len(sample)))]
        whole, used = self.augmented(sample), {}
        while todo:
            k, own = todo.pop()
            if k >= (1 << depth) - 1 or len(own) < 4:
                continue
            # Of a few points that no node above has, the one from which distances differ most.
            above = {used[n] for n in self.ancestors(k)}
            some = [i for i in own[:: max(1, len(own) // 16)] if i not in above][:16] or own[:1]
            point = max(some, key=lambda i: (float(self._apart(whole[own], whole[i]).std()), -int(i)))
            used[k] = point
            far = self._apart(whole[own], whole[point])
            radius = float(np.median(far))
            inside = far <= radius
            if inside.all():
                continue  # equal vectors cannot be told apart
            self.point[k], self.radius[k] = whole[point], radius
            todo += [(2 * k + 1, own[inside]), (2 * k + 2, own[~inside])]

    @staticmethod
    def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(((a - b) ** 2).sum(-1))

    def augmented(self, m: np.ndarray) -> np.ndarray:
        return np.column_stack([m, np.sqrt(np.maximum(0.0, self.longest - (m * m).sum(1)))])

    def queried(self, m: np.ndarray) -> np.ndarray:
        return np.column_stack([m, np.zeros(len(m))])

    def routed(self, m: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """The cell of each (augmented) vector and its distances to the vantage points on the way."""
        node, way = np.zeros(len(m), np.int64), [[] for _ in range(len(m))]
        open_ = np.arange(len(m))
        while len(open_ := open_[[n in self.radius for n in node[open_]]]):
            for n in np.unique(node[open_]):
                own = open_[node[open_] == n]
                far = self._apart(m[own], self.point[n])
                for i, d in zip(own, far, strict=True):
                    way[i].append(float(d))
                node[own] = np.where(far <= self.radius[n], 2 * n + 1, 2 * n + 2)
        return node, way

    def ancestors(self, cell: int) -> list[int]:
        up = []
        while cell:
            cell = (cell - 1) // 2
            up.append(cell)
        return up[::-1]

    def bounds(self, m: np.ndarray, cells: dict[int, tuple[list[float], list[float]]]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """For queries, the smallest and largest score that a row of each cell may have."""
        q = self.queried(m)
        far = {k: self._apart(q, p) for k, p in self.point.items()}
        names = sorted(cells)
        square = (m * m).sum(1) + self.longest
        low, high = np.empty((len(m), len(names))), np.empty((len(m), len(names)))
        for c, cell in enumerate(names):
            near, wide = np.zeros(len(m)), np.sqrt(square * 2) + 1
            for k, lo, hi in zip(self.ancestors(cell), *cells[cell], strict=True):
                near = np.maximum(near, np.maximum(far[k] - hi, lo - far[k]))
                wide = np.minimum(wide, far[k] + hi)
            high[:, c], low[:, c] = (square - near * near) / 2, (square - wide * wide) / 2
        slack = (1 + 1e-9 * square)[:, None]  # of rounding; whole scores lose nothing by it
        return names, low - slack, high + slack


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the input, neither of which is broadcast, however small it is as Parquet."""
    return left.join(right.hint("merge"), on, how)


def _first(found: DataFrame, k: int, of: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc("score"), "other", "other_row"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


class Index:
    """Rows in cells and blocks, and the bounds of each cell; made once for any number of searches."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, leaves: int = LEAVES) -> None:
        spark = rows.sparkSession
        rows = staged(rows, "vectors")
        # No floored component is larger than its number or the one below, so this bounds the longest vector.
        size = F.aggregate("x", F.lit(0.0), lambda s, x: s + F.pow(F.greatest(F.abs(x), F.abs(x - 1)), F.lit(2.0)))
        stats = rows.agg(F.max(F.size("x")), F.max(size)).first()
        self.width, longest = stats[0] or 1, float(stats[1] or 0.0)
        # First the largest hash of the sample, then its vectors: no task returns a whole sample.
        hashed = rows.withColumn("hash", F.xxhash64("vec_id", "row"))
        last = hashed.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
        picked = hashed.filter(F.col("hash") <= (0 if last is None else last)).orderBy("hash").limit(sample).select("x").toPandas()
        self.tree = Tree(_matrix(picked.x, self.width), longest, leaves)
        self.sent = spark.sparkContext.broadcast(self.tree)
        sent, width = self.sent, self.width

        def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tree = sent.value
            for f in frames:
                m = _matrix(f.x, width)
                cell, way = tree.routed(tree.augmented(m))
                yield pd.DataFrame({"row": f.row, "vec_id": f.vec_id, "label": f.label, "cell": cell, "way": way, "v": _stored(m)})

        self.rows = staged(rows.mapInPandas(route, "row long, vec_id long, label int, cell long, way array<double>, v binary"), "routed")
        at = self.rows.select("cell", F.posexplode_outer("way").alias("level", "d")).groupBy("cell", "level").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("*").alias("n"))
        # One row for each of at most `leaves` cells and levels.
        self.cells: dict[int, tuple[list[float], list[float]]] = {}
        self.held: dict[int, int] = {}
        for r in sorted(at.collect(), key=lambda r: (r.cell, r.level or 0)):
            lo, hi = self.cells.setdefault(r.cell, ([], []))
            if r.level is not None:
                lo.append(r.lo)
                hi.append(r.hi)
            self.held[r.cell] = r.n
        parts = F.create_map(*[F.lit(int(x)) for c, n in self.held.items() for x in (c, -(-n // BLOCK))]) if self.held else F.create_map(F.lit(0), F.lit(1))
        #: How many blocks a row's cell has.
        self.parts = F.element_at(parts, F.col("cell").cast("int"))
        self.blocks = self.rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), self.parts).cast("int")).drop("way")

    def bounded(self, anchors: DataFrame) -> DataFrame:
        """anchors (row, v, ...) with `cells`: (cell, low, high), highest possible score first."""
        sent, cells, width, columns = self.sent, self.cells, self.width, anchors.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for at in range(0, len(f), 1024):
                    part = f.iloc[at : at + 1024]
                    names, low, high = sent.value.bounds(_read(part.v, width), cells)
                    order = np.argsort(-high, axis=1, kind="stable")
                    told = [[{"cell": names[c], "low": low[i, c], "high": high[i, c]} for c in order[i]] for i in range(len(part))]
                    yield part.assign(cells=told)[[*columns, "cells"]]

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
        return anchors.mapInPandas(run, f"{kinds}, cells array<struct<cell:long,low:double,high:double>>")

    def _visited(self, visits: DataFrame, k: int, same: bool) -> DataFrame:
        """The k best rows in each visited cell for each window, by block: row, key, other, other_row, score."""
        width = self.width
        counts = F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count("*") / (TILES * TILE)).cast("int").alias("groups")))  # a row a cell
        up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        asked = visits.join(counts, "cell").withColumn("group", F.pmod(F.xxhash64("row"), F.col("groups")).cast("int")).withColumn("block", up_to(self.parts))
        held = self.blocks.join(counts, "cell").withColumn("group", up_to(F.col("groups")))
        unit = ["cell", "block", "group"]

        def run(asked: pa.Table, held: pa.Table) -> pa.Table:
            ids, rows, labels = (held[c].to_numpy() for c in ("vec_id", "row", "label"))
            v = _read(held["v"].to_pylist(), width)
            out: list[tuple] = []
            for at in range(0, len(asked) if len(held) else 0, TILE):
                tile = asked.slice(at, TILE).to_pylist()
                s = scores(_read([a["v"] for a in tile], width), v)
                for i, a in enumerate(tile):
                    fits = (labels == a["label"]) == same
                    if same:
                        fits &= rows != a["row"]
                    for w in a["windows"]:
                        own = np.flatnonzero(fits & (s[i] >= w["least"]) & (s[i] <= w["most"]))
                        if len(own) > k:  # all that reach the k-th score, then ties by id
                            own = own[s[i, own] >= np.partition(s[i, own], len(own) - k)[len(own) - k]]
                        for j in own[np.lexsort((rows[own], ids[own], -s[i, own]))][:k]:
                            out.append((a["row"], w["key"], ids[j], rows[j], s[i, j]))
            columns = np.array(out, np.int64).reshape(-1, 5).T
            return pa.table(dict(zip(("row", "key", "other", "other_row", "score"), columns, strict=True)))

        asked = asked.select(*unit, "row", "label", "v", "windows")
        held = held.select(*unit, "row", "vec_id", "label", "v").toDF(*unit, "row", "vec_id", "label", "v")  # visits may be of the same table
        work = asked.groupBy(*unit).cogroup(held.groupBy(*unit))
        return work.applyInArrow(run, "row long, key long, other long, other_row long, score long")

    def search(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """row, key, other, other_row, score, rank: the k best rows of equal (same) or different label within each window.

        anchors: row, label, v and windows, an array of (key, least, most) scores.
        """
        anchors = staged(self.bounded(anchors), "asked")
        best: DataFrame | None = None
        first = 0
        for count in (*ROUNDS, None):
            left = F.slice("cells", first + 1, count) if count else F.slice("cells", first + 1, F.greatest(F.size("cells") - first, F.lit(0)))
            now = anchors
            if best is not None:
                # A window with k rows needs no lower score than its k-th.
                full = best.filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("key", "score"))).alias("kth"))
                raised = F.transform("windows", lambda w: F.struct(w["key"].alias("key"), F.greatest(w["least"], F.coalesce(F.col("kth")[w["key"]], w["least"])).alias("least"), w["most"].alias("most")))
                now = _met(anchors, full, ["row"], "left").withColumn("kth", F.coalesce("kth", F.create_map().cast("map<bigint,bigint>"))).withColumn("windows", raised)
            each = now.select("row", "label", "v", "windows", F.explode(left).alias("c"))
            needed = F.filter("windows", lambda w: (F.col("c.high") >= w["least"]) & (F.col("c.low") <= w["most"]))
            visits = each.select("row", "label", "v", needed.alias("windows"), F.col("c.cell").alias("cell")).filter(F.size("windows") > 0)
            found = self._visited(visits, k, same)
            if best is not None:
                found = found.unionByName(best.drop("rank"))
            best = staged(_first(found, k, ["row", "key"]), "best", replaces=(best,) if best is not None else ())
            first += count or 0
        return best


def mined(vectors: DataFrame, positives: int = 5, k: int = 5, low: int = 80, high: int = 100, anchors: int = 100, moved: int = 7, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for every anchor (vec_id divisible by `anchors`) and positive.

    Negatives are the first k rows of another label with low * positive_score <= 100 * negative_score <= high * positive_score.
    Labels of rows whose vec_id is divisible by `moved` are first moved on by one, modulo ten.
    """
    index = Index(rows_of(vectors, scale, moved, vec_id, vector, label))
    asked = index.rows.filter(F.col("vec_id") % anchors == 0).select("row", "vec_id", "label", "v")
    window = lambda key, least, most: F.struct(key.cast("long").alias("key"), least.cast("long").alias("least"), most.cast("long").alias("most"))
    near = index.search(asked.withColumn("windows", F.array(window(F.lit(0), F.lit(LOW), F.lit(HIGH)))), positives, True)
    # 100 n >= low p is n >= ceil(low p / 100): in whole numbers, so that nothing is rounded.
    up = lambda p, by: -F.floor(-(p.cast("decimal(38,0)") * by) / 100)
    down = lambda p, by: F.floor(p.cast("decimal(38,0)") * by / 100)
    windows = near.groupBy("row").agg(F.collect_list(window(F.col("rank"), up(F.col("score"), low), down(F.col("score"), high))).alias("windows"))
    far = index.search(_met(asked, windows, ["row"]), k, False)
    near = near.select("row", F.col("rank").cast("long").alias("key"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    told = _met(_met(far, near, ["row", "key"]), asked.select("row", F.col("vec_id").alias("anchor_id")), ["row"])
    return told.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
