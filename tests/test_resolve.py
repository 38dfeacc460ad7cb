"""Resolution by ends of paths and names against plain comparison of all pairs, and its size where names are common."""

import random

from pyspark.sql import functions as F

from symweave.operators import resolve
from symweave.schema import NODES, REFS, conform


def test_ends_of_paths_and_names_equal_a_comparison_of_all_pairs(spark):
    rng = random.Random(4)
    part = lambda: rng.choice(["a", "ba", "b", "index", "x.y", ""])
    files = sorted({"/".join(part() for _ in range(rng.randrange(1, 5))) + rng.choice([".ts", "/index.ts"]) for _ in range(150)})
    rows = [(f"file:{p}", "file", p.rsplit("/", 1)[-1], p, p) for p in files]
    names = sorted({rng.choice(["::", "."]).join(rng.choice(["A", "BA", "get", "Xget", "a:b", "GET:/a", ":", "did:go:"]) for _ in range(rng.randrange(1, 4))) for _ in range(160)} | {"X.A.a:b.c", "src/r.ts::GET:/a.users", "a:::b"})
    rows += [(f"method:{k}:{i}", "method", q.replace("::", ".").rsplit(".", 1)[-1], q, "m.ts") for k in range(2) for i, q in enumerate(names) if k == 0 or i % 3 == 0]
    asked = ["index.ts", "a/index.ts", "/index.ts", "ba/b.ts", "b.ts/", "a/a/index.ts", "x/b.ts", "A.get", "A::get", "get", "::get", "BA.get", "A.A.get", "et", "A.", "get.get", "Xget::A", "A.a:b.c", "r.ts::GET.users", "a:b.get", "::GET:/a", ":A::Xget", "b.get", "a:::b", "::did:go:"]
    asked += [rng.choice(files)[rng.randrange(4) :] for _ in range(60)] + [rng.choice(names)[rng.randrange(3) :] for _ in range(160)]
    nodes = conform(spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string, file_path string"), NODES)
    refs = conform(spark.createDataFrame(list(enumerate(asked)), "ref_id long, reference_name string"), REFS)

    def paths(name):
        if "/" not in name:
            return None
        own = [r for r in rows if r[1] == "file"]
        last = name.rsplit("/", 1)[-1]
        found = [(-0.95 if p == name else -0.85, i) for i, _, n, _, p in own if n == last and p.endswith(name)]
        sole = [(-0.7, i) for i, _, n, _, _ in own if n == last]
        return min(found + (sole if len(sole) == 1 else []), default=None)

    def qualified(name):
        if "." not in name and "::" not in name:
            return None
        whole = [(-0.95, i) for i, _, _, q, _ in rows if q == name]
        last = name.replace("::", ".").rsplit(".", 1)[-1]
        ends = [(-0.85, i) for i, _, n, q, _ in rows if last and n == last == q.replace("::", ".").rsplit(".", 1)[-1] and q.endswith(name)]
        return min((whole if len(whole) == 1 else []) + ends, default=None)

    for strategy, plain in ((resolve.by_file_path, paths), (resolve.by_qualified_name, qualified)):
        got = {r.ref_id: (-r.confidence, r.target) for r in strategy(refs, nodes).collect()}
        assert got == {k: found for k, name in enumerate(asked) if (found := plain(name))}


def test_common_names_give_as_many_rows_as_references(spark):
    n = 3000
    key = F.col("id").cast("string")
    files = spark.range(n).select(F.concat(F.lit("src/m"), key, F.lit("/index.ts")).alias("file_path")).select(F.concat(F.lit("file:"), "file_path").alias("id"), F.lit("file").alias("kind"), F.lit("index.ts").alias("name"), F.col("file_path").alias("qualified_name"), "file_path", F.lit("typescript").alias("language"))
    gets = spark.range(n).select(F.concat(F.lit("method:"), key).alias("id"), F.lit("method").alias("kind"), F.lit("get").alias("name"), F.concat(F.lit("Box"), key, F.lit("::get")).alias("qualified_name"), F.concat(F.lit("src/m"), key, F.lit("/box.ts")).alias("file_path"), F.lit("typescript").alias("language"))
    nodes = conform(files.unionByName(gets), NODES)
    names = F.when(F.col("id") % 3 == 0, F.concat(F.lit("m"), key, F.lit("/index.ts"))).when(F.col("id") % 3 == 1, F.concat(F.lit("Box"), key, F.lit("::get"))).otherwise(F.concat(F.lit("box"), key, F.lit("_a.get")))
    refs = conform(spark.range(n).select(F.col("id").alias("ref_id"), names.alias("reference_name"), F.lit("typescript").alias("language"), F.lit("main.ts").alias("file_path")), REFS).cache()
    for strategy, kind in ((resolve.by_file_path, 0), (resolve.by_qualified_name, 1), (resolve.by_method_call, 2)):
        got = strategy(refs, nodes).filter(F.col("ref_id") % 3 == kind)
        assert got.count() == n // 3
        right = F.when(F.col("ref_id") % 3 == 0, F.concat(F.lit("file:src/m"), "ref_id", F.lit("/index.ts"))).otherwise(F.concat(F.lit("method:"), "ref_id"))
        assert got.filter(F.col("target") != right).isEmpty()
