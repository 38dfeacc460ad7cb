"""op12 against a comparison of every anchor with every row."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from symweave.llm import negatives

SHAPE = "vec_id long, embedding array<float>, label int"


def plain(rows):
    own = []
    for n, (i, x, y) in enumerate(rows):
        if i is None or y is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.append((n, i, [math.floor(256 * c) for c in x], (y + 1) % 10 if i % 7 == 0 else y))
    dot = lambda a, b: max(-(1 << 63), min((1 << 63) - 1, sum(p * q for p, q in zip(a, b))))  # noqa: B905, E731
    out = []
    for n, i, x, y in own:
        if i % 100:
            continue
        all_ = sorted((-dot(x, v), j, m, z == y) for m, j, v, z in own if m != n)
        for p, j, _, _ in [r for r in all_ if r[3]][:5]:
            far = [r for r in all_ if not r[3] and 80 * -p <= 100 * -r[0] <= 100 * -p][:5]
            out += [(i, j, k + 1, r[1], -p, -r[0]) for k, r in enumerate(far)]
    return sorted(out)


def single(x):
    import struct

    return None if x is None else struct.unpack("f", struct.pack("f", x))[0]


def rows(seed, n=700, width=6):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(8)]
    out = []
    for k in range(n):
        c = rng.choice(middle)
        out.append((k, [single(x + rng.gauss(0, 0.4)) for x in c], rng.randrange(10)))
    return out


def odd(seed):
    rng = random.Random(seed)
    out = rows(seed)
    same = out[3][1]
    out += [(1000 + k, same, rng.randrange(3)) for k in range(350)]  # a third of all rows is one vector
    out += [(100, out[0][1], 1), (100, out[0][1], 1), (200, None, 1), (300, [], 2), (400, [1.0], 2), (500, [1.0] * 9, 3), (None, [1.0], 1), (600, [1.0, None], 1), (601, [math.nan], 1), (602, [math.inf], 1), (800, [1.0], None), (2000, [-1.0] * 6, 8)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_a_comparison_of_all(spark, monkeypatch, small):
    if small:  # many cells, blocks and tiles, and a sample that knows little
        for name, value in {"BLOCK": 64, "TILE": 2}.items():
            monkeypatch.setattr(negatives, name, value)
        monkeypatch.setattr(negatives.Index.__init__, "__defaults__", (100, 16))
    data = odd(1)
    df = spark.createDataFrame(data, SHAPE).withColumns({c: F.lit(1) for c in ("row", "cell", "score", "x", "v", "n")})
    got = negatives.mined(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(data)


def test_huge_components_and_no_rows(spark):
    data = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 2), (2, [2.9e38, 1.0], 2), (100, [1e9, 1.0], 1), (101, [1e9, 0.5], 1), (102, [9e8, 1.0], 4)]
    data = [(i, [single(c) for c in x], y) for i, x, y in data]
    assert sorted(map(tuple, negatives.mined(spark.createDataFrame(data, SHAPE)).collect())) == plain(data)
    assert negatives.mined(spark.createDataFrame([], SHAPE)).count() == 0


def test_bounds_hold_and_cells_are_left_out(spark):
    df = spark.createDataFrame(rows(2, 1500, 4), SHAPE)
    index = negatives.Index(negatives.rows_of(df, 256.0, 7, "vec_id", "embedding", "label"), leaves=32)
    asked = index.rows.filter("vec_id % 100 = 0").select("row", "v")
    known = index.rows.select("cell", "v").toPandas()
    whole = negatives._read(known.v, index.width)
    visited = 0
    for r in index.bounded(asked).collect():
        score = negatives.scores(negatives._read([r.v], index.width), whole)[0]
        for c in r.cells:
            own = score[known.cell == c.cell]
            assert c.low <= own.min() and own.max() <= c.high
        best = sorted(score)[-6]
        visited += sum(c.high >= best for c in r.cells)
    assert visited < 0.8 * len(index.cells) * asked.count()


def test_vectors_are_not_broadcast(spark):
    """20000 equal vectors, some KB as Parquet, would all be in the driver's memory (F1)."""
    df = spark.range(20000).selectExpr("id vec_id", "array_repeat(float(0.25), 64) embedding", "int(id % 10) label")
    index = negatives.Index(negatives.rows_of(df, 256.0, 7, "vec_id", "embedding", "label"))
    window = F.array(F.struct(F.lit(0).cast("long").alias("key"), F.lit(negatives.LOW).alias("least"), F.lit(negatives.HIGH).alias("most")))
    visits = index.rows.filter("vec_id % 100 = 0").select("row", "label", "v", window.alias("windows"), "cell")
    inside = None
    for line in index._visited(visits, 5, True)._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            assert not re.search(r"\b(v|held)#", line)
        else:
            inside = depth if "BroadcastExchange" in line else None
