import pytest
from pyspark.sql import functions as F

from symweave.functions import paths, words
from symweave.operators import explore


@pytest.mark.parametrize(
    "line, want",
    [
        ("authenticate user", words.Query("authenticate user")),
        ("kind:function auth", words.Query("auth", ["function"])),
        ("language:typescript foo", words.Query("foo", [], ["typescript"])),
        ("kind:function kind:method auth", words.Query("auth", ["function", "method"])),
        ("path:src/api name:Handler", words.Query("", [], [], ["src/api"], ["Handler"])),
        ('path:"my dir/file" foo', words.Query("foo", [], [], ["my dir/file"])),
        ("http://example.com", words.Query("http://example.com")),
        ("kind: foo", words.Query("kind: foo")),
        ("TODO: needs review", words.Query("TODO: needs review")),
        ("kind:invalid foo", words.Query("kind:invalid foo")),
        ('path:"open', words.Query("", [], [], ['"open'])),
        (":x y:", words.Query(":x y:")),
        ("", words.Query("")),
    ],
)
def test_queries(line, want):
    assert words.parse_query(line) == want


def test_distances(spark):
    cases = {("user", "user"): 0, ("user", "usar"): 1, ("user", "users"): 1, ("users", "user"): 1, ("confg", "configX"): 2, ("foo", "completely-different"): 3, ("a", "aaaaaaa"): 3, ("", ""): 0, ("a", ""): 1, ("", "abc"): 3, ("Foo", "foo"): 1, ("aaaaa", "bbbbb"): 3}
    df = spark.createDataFrame(list(cases), "a string, b string").select("a", "b", words.edit_distance(F.col("a"), F.col("b"), 2).alias("d"))
    assert {(r.a, r.b): r.d for r in df.collect()} == cases


def test_stems_and_terms():
    assert set(words.stems("caching")) == {"cach", "cache"} and "run" in words.stems("running")
    assert "evict" in words.stems("eviction") and "manage" in words.stems("management") and "entry" in words.stems("entries")
    assert words.stems("class") == [] and "error" in words.stems("errors") and {"handle", "handl"} <= set(words.stems("handled")) and "carry" in words.stems("carried")
    assert "build" in words.stems("builder") and words.stems("feed") == []
    assert words.search_terms("getUserName in the user_service file", False) == ["getusername", "user_service", "get", "user", "name", "service"]


def test_paths(spark):
    yes = "okhttp/src/jvmTest/kotlin/okhttp3/CallTest.kt Tests/SessionTests.swift foo/test_bar.py pkg/bar_test.go src/foo.spec.ts com/example/FooTestCase.java project/__tests__/foo.ts examples/a.ts x/demo/b.rs".split()
    no = "src/latest/loader.kt lib/manifest.kt src/contestEntry.ts pkg/greatest.go src/flask/app.py".split()
    df = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in df.filter(paths.is_test_file(F.col("p"))).collect()} == set(yes)
    rows = [("a.h", "namespace x {}"), ("b.h", "int f(void);"), ("c.TSX", None), ("Makefile", None), ("d.rake", None), ("x.y/plain", None)]
    df = spark.createDataFrame(rows, "p string, s string")
    assert {r.p: r.l for r in df.select("p", paths.language_of(F.col("p"), F.col("s")).alias("l")).collect()} == {"a.h": "cpp", "b.h": "c", "c.TSX": "tsx", "Makefile": "unknown", "d.rake": "ruby", "x.y/plain": "unknown"}
    df = spark.createDataFrame([(p,) for p in ("a/b.ts", "a/../b.ts", "../x", "a/../../x", "/r/a", "/r2/a", "./a")], "p string")
    assert {r.p for r in df.filter(paths.inside(F.col("p"), "/r")).collect()} == {"a/b.ts", "a/../b.ts", "/r/a", "./a"}
    df = spark.createDataFrame([("a/b/c/x", "a/b/d/y"), ("x", "y"), ("a/b/c/d/e/f/g/x", "a/b/c/d/e/f/g/y")], "a string, b string")
    assert [r[0] for r in df.select(paths.proximity(F.col("a"), F.col("b"))).collect()] == [30, 0, 80]


@pytest.mark.parametrize("glob, yes, no", [("**/*.ts", ["a.ts", "x/y/.z.ts"], ["a.tsx"]), ("src/*/{a,b}.py", ["src/q/a.py"], ["src/q/r/a.py", "src/q/c.py"]), ("**/dist/**", ["dist/x", "a/dist/b/c"], ["distx/y"]), ("[!a]?.go", ["bc.go"], ["ab.go", "b/.go"])])
def test_globs(glob, yes, no):
    import re

    assert all(re.match(paths.glob_regex(glob), p) for p in yes) and not any(re.match(paths.glob_regex(glob), p) for p in no)


def test_budgets():
    assert [explore.budget_for(n).characters for n in (0, 499, 500, 4999, 5000, 14999, 15000)] == [18000, 18000, 13000, 13000, 35000, 35000, 38000]
    assert [explore.calls_for(n) for n in (1, 500, 5000, 15000, 25000)] == [1, 2, 3, 4, 5]
    text = "x" * 9000 + "\n" + "y" * 9000
    assert explore.truncated("short") == "short" and explore.truncated(text, 10000).startswith("x" * 9000 + "\n\n...")


def test_symbol_lookup(spark):
    from symweave.operators.lookups import matches_symbol

    rows = [("run", "run", "src/configurator/stage_apply.rs", "function"), ("run", "run", "src/configurator/stage_detect.rs", "function"), ("stage_apply.rs", "src/configurator/stage_apply.rs", "src/configurator/stage_apply.rs", "file")]
    df = spark.createDataFrame(rows, "name string, qualified_name string, file_path string, kind string")
    for symbol in ("stage_apply::run", "configurator::stage_apply::run", "crate::configurator::stage_apply::run", "configurator/stage_apply/run"):
        assert [r.file_path for r in df.filter(matches_symbol(symbol)).collect()] == ["src/configurator/stage_apply.rs"]
    assert df.filter(matches_symbol("run")).count() == 2 and df.filter(matches_symbol("stage_apply")).first().kind == "file"
