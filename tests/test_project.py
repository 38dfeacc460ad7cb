"""A small tree end to end: index, names, re-exports, search, walks, sync, store."""

import pytest
from pyspark.sql import functions as F

from symweave import project
from symweave.extract.imports import mappings, passed_on
from symweave.operators import context, imports, textindex
from symweave.sources import store, tree

FILES = {
    "src/base.ts": "export class BaseThing {\n  run(): void {}\n}\nexport interface Printable { print(): void }\n",
    "src/derived.ts": "import { BaseThing, Printable } from './base';\nimport { formatValue } from './utils';\nexport class DerivedThing extends BaseThing implements Printable {\n  print(): void { formatValue('x'); }\n}\n",
    "src/utils.ts": "export function formatValue(v: string) { return v; }\nexport function processValue(v: string) { return formatValue(v); }\nfunction unusedHelper() {}\n",
    "src/auth.ts": "export function signIn() {}\n",
    "src/index.ts": "export { signIn as login } from './auth';\n",
    "src/all.ts": "export * from './index';\n",
    "src/main.ts": "import { login } from './all';\nimport { DerivedThing } from './derived';\nexport function main() { login(); const d = new DerivedThing(); d.print(); }\n",
    "src/main.test.ts": "import { main } from './main';\nmain();\n",
    "node_modules/x/skip.ts": "export function skipped() {}\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (at / path).parent.mkdir(parents=True, exist_ok=True)
        (at / path).write_text(text)
    return at


@pytest.fixture(scope="module")
def kept(spark, root, tmp_path_factory):
    p = project.Project(spark, str(root), str(tmp_path_factory.mktemp("graph")))
    p.index()
    return p


def named_edges(graph, *kinds):
    at = graph.nodes.select("id", "name")
    e = graph.of_kind(*kinds).join(at.toDF("source", "a"), "source").join(at.toDF("target", "b"), "target")
    return {(r.a, r.kind, r.b) for r in e.collect()}


def test_reading_leaves_out_what_is_no_source(spark, root):
    assert {r.path for r in tree.read(spark, str(root)).collect()} == {p for p in FILES if p.startswith("src/")}
    assert {r.path for r in tree.listed(spark, str(root)).collect()} == {p for p in FILES if p.startswith("src/")}
    assert {(r.language, r.n) for r in tree.summary(tree.listed(spark, str(root))).collect()} == {("typescript", 8)}


def test_edges_of_the_tree(kept):
    got = named_edges(kept.graph, "calls", "extends", "implements", "instantiates")
    assert {("DerivedThing", "extends", "BaseThing"), ("DerivedThing", "implements", "Printable"), ("main", "instantiates", "DerivedThing"), ("print", "calls", "formatValue"), ("processValue", "calls", "formatValue")} <= got
    assert ("main", "calls", "signIn") in got  # renamed on the way, through a wildcard


def test_questions(kept):
    assert kept.search("formatValue").first().name == "formatValue"
    assert {r.source for r in kept.callers("formatValue").collect()} == {n.id for n in kept.graph.nodes.filter("name in ('print', 'processValue')").collect()}
    nodes, _ = kept.impact("signIn", 2)
    assert nodes.count() >= 2
    assert {r.path for r in kept.affected(["src/utils.ts"]).filter("is_test").collect()} <= {"src/main.test.ts"}
    found, _ = kept.context("How does DerivedThing print with formatValue", context.Budget(roots=3, nodes=12))
    assert {"DerivedThing", "formatValue"} <= {r.name for r in found.collect()}
    assert "src/derived.ts" in kept.explore("How does DerivedThing print")
    assert {r.value: r.n for r in kept.status().filter("measure = 'total'").collect()}["files"] == 8


def test_sync_equals_full_index(spark, kept, root):
    assert kept.sync().count() == 0
    (root / "src/extra.ts").write_text("export function extra() { return 1; }\n")
    (root / "src/utils.ts").write_text(FILES["src/utils.ts"] + "export function more() { return formatValue('y'); }\n")
    (root / "src/index.ts").unlink()
    assert {tuple(r) for r in kept.sync().collect()} == {("src/extra.ts", "added"), ("src/utils.ts", "modified"), ("src/index.ts", "removed")}
    full = project.build(tree.read(spark, str(root)))
    assert named_edges(kept.graph) == named_edges(full)
    assert ("more", "calls", "formatValue") in named_edges(kept.graph, "calls")


def test_store_refuses_newer_versions(spark, kept, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))
    spark.createDataFrame([("v", 99)], "name string, version int").write.json(str(tmp_path / "new/current"))
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "new"))


def test_import_forms():
    js = "import d, { a, b as c, default as e } from './m';\nimport * as ns from \"./n\";\nimport type { T } from './t';\nconst { x, y: z } = require('./r');\nconst w = require('./w'); // import q from './no'\n"
    assert set(mappings(js, "typescript")) == {
        ("d", "default", "./m", "default"), ("a", "a", "./m", "named"), ("c", "b", "./m", "named"), ("e", "default", "./m", "default"), ("ns", "*", "./n", "namespace"),
        ("T", "T", "./t", "named"), ("x", "x", "./r", "named"), ("z", "y", "./r", "named"), ("w", "default", "./w", "default"),
    }
    py = "from a.b import (c,\n  d as e)\nimport f.g as h, i\nfrom j import *\n"
    assert set(mappings(py, "python")) == {("c", "c", "a.b", "named"), ("e", "d", "a.b", "named"), ("h", "*", "f.g", "namespace"), ("i", "*", "i", "namespace")}
    assert set(mappings('import (\n\t"fmt"\n\th "net/http"\n)\nvar x = "y"\n', "go")) == {("fmt", "*", "fmt", "namespace"), ("h", "*", "net/http", "namespace")}
    assert set(mappings("use App\\Models\\User;\nuse A\\B as C;\n", "php")) == {("User", "User", "App\\Models\\User", "named"), ("C", "B", "A\\B", "named")}
    assert passed_on("export * from './a';\nexport { b, c as d } from './e';\n", "typescript") == [("*", "*", "./a", "wildcard"), ("b", "b", "./e", "named"), ("d", "c", "./e", "named")]


def test_module_names_to_files(spark):
    config = '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*", "alt/*"], "exact": ["src/one.ts"], /* more */ "@lib/deep/*": ["deep/*",],},},}'
    aliases = imports.aliases_of(config)
    assert [a[0] for a in aliases] == ["exact", "@lib/deep/", "@lib/"]
    files = spark.createDataFrame([(p,) for p in ("src/a/b.ts", "src/a/index.ts", "lib/x.ts", "alt/y/index.ts", "deep/z.ts", "src/one.ts", "src/q.ts", "pkg/m.py", "pkg/n/__init__.py")], "path string")
    asked = [("src/a/c.ts", "typescript", s) for s in ("./b", ".", "../q", "@lib/x", "@lib/y", "@lib/deep/z", "exact", "@/q", "react", "../../../etc")] + [("pkg/n/k.py", "python", s) for s in ("pkg.m", "..m", ".", "os")]
    got = {(r.path, r.source): r.target for r in imports.located(spark.createDataFrame(asked, "path string, language string, source string"), files, aliases).collect()}
    want = {"./b": "src/a/b.ts", ".": "src/a/index.ts", "../q": "src/q.ts", "@lib/x": "lib/x.ts", "@lib/y": "alt/y/index.ts", "@lib/deep/z": "deep/z.ts", "exact": "src/one.ts", "@/q": "src/q.ts"}
    assert {s: t for (p, s), t in got.items() if p.endswith(".ts")} == want
    assert {s: t for (p, s), t in got.items() if p.endswith(".py")} == {"pkg.m": "pkg/m.py", "..m": "pkg/m.py", ".": "pkg/n/__init__.py"}


def test_text_index_matches_known_scores(spark):
    rows = [("function:a1", "getUser", "UserService::getUser", "Return the user by id", "(id: string)"), ("class:b2", "UserService", "UserService", None, None), ("method:c3", "save_user", "UserService::save_user", "persist", "(u: User)"), ("function:d4", "render", "render", "draw user list", "()"), ("function:e5", "parse", "parse", None, "(s: string)")]
    df = spark.createDataFrame(rows, "id string, name string, qualified_name string, docstring string, signature string")
    # The known scores count the words of the id in each row's length; here the id is indexed with weight 0.
    weights = {"idx": 0.0} | textindex.WEIGHTS
    index = textindex.build(df.withColumn("idx", F.col("id")), weights)
    for query, want in {
        "user": {"class:b2": 2.1349656613914602e-06, "method:c3": 2.104391814210163e-06, "function:a1": 1.7177177177177178e-06, "function:d4": 1.0437956204379561e-06},
        "getuser": {"function:a1": 2.2643637543894455},
        "user save": {"method:c3": 2.284118959284802, "class:b2": 2.1349656613914602e-06, "function:a1": 1.7177177177177178e-06, "function:d4": 1.0437956204379561e-06},
        "save_user": {"method:c3": 2.284116854892988},
    }.items():
        got = {r.id: r.score for r in textindex.ranked(index, query).collect()}
        assert got == pytest.approx(want, rel=1e-9)


def test_conventions(spark):
    from symweave.operators import conventions
    from symweave.schema import NODES, REFS, conform

    nodes = spark.createDataFrame([("a", "UserService", "class", "x/other/UserService.java"), ("b", "UserService", "class", "x/services/UserService.java"), ("c", "useCart", "function", "src/hooks/useCart.ts"), ("d", "Cart", "class", "x/a/Cart.java")], "id string, name string, kind string, file_path string")
    refs = spark.createDataFrame([(1, "UserService", "java"), (2, "useCart", "typescript"), (3, "Cart", "java"), (4, "Nothing", "java"), (5, "UserService", "python")], "ref_id long, reference_name string, language string")
    got = {r.ref_id: (r.target, r.confidence) for r in conventions.by_convention(conform(refs, REFS), conform(nodes, NODES), ["spring", "react"]).collect()}
    assert got == {1: ("b", 0.85), 2: ("c", 0.85), 3: ("d", 0.7)}
    assert conventions.by_convention(refs, nodes, []).count() == 0
    assert conventions.detected(spark.createDataFrame([("a.py", "from django.db import x"), ("b", None)], "path string, content string")) == ["django"]


def test_views_and_commands(kept, capsys):
    from symweave import render
    from symweave.__main__ import main

    assert render.files_view(kept.graph.files, "flat", "src/b") == "src/base.ts"
    assert render.files_view(kept.graph.files, "grouped").startswith("typescript (8)")
    assert render.files_view(kept.graph.files, "tree", depth=1) == "src/"
    found = kept.context("How does DerivedThing print")
    assert "DerivedThing" in render.context(*found) and '"nodes"' in render.context(*found, "json") and "class DerivedThing" in render.context(*found, "tree")
    for verb, word in (("status", None), ("query", "formatValue"), ("node", "DerivedThing"), ("callers", "formatValue")):
        assert main([verb, *([word] if word else []), "--root", kept.root, "--graph", kept.at]) == 0
    assert "DerivedThing" in capsys.readouterr().out


def test_a_reader_keeps_its_graph_while_another_is_saved(spark, kept, tmp_path):
    at = str(tmp_path / "g")
    graph = kept.graph
    store.save(graph, at)
    before = store.load(spark, at)
    for _ in range(2):
        reading = store.load(spark, at)
        store.save(graph, at)
        assert reading.nodes.count() == graph.nodes.count()  # the version before stays
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.startswith("v-")]) == 2
    with store.locked(spark, at), pytest.raises(RuntimeError, match="another writer"):
        store.save(graph, at)
    assert not (tmp_path / "g/lock").exists() and before.nodes.columns == graph.nodes.columns
    store.optimized(spark, at)
    assert store.load(spark, at).edges.count() == graph.edges.count()
    store.cleared(spark, at)
    with pytest.raises(FileNotFoundError):
        store.load(spark, at)


def test_a_change_of_a_large_file_is_seen(spark, tmp_path):
    (tmp_path / "a.ts").write_text("x" * (tree.MOST + 1))
    (tmp_path / "b.ts").write_text("y" * (tree.MOST + 1))
    rows = {r.path: r for r in tree.read(spark, str(tmp_path)).collect()}
    assert rows["a.ts"].content is None and rows["a.ts"].content_hash != rows["b.ts"].content_hash


def test_staged_tables_go(spark):
    import os

    from symweave.plans.staging import scratch, staged

    def there(df):
        return os.path.isdir(df._staged_at.removeprefix("file:"))

    with scratch():
        a = staged(spark.range(3), "a")
        b = staged(a, "b", replaces=(a,))
        c = staged(b, "c", lasting=True)
        assert not there(a) and there(b)
    assert not there(b) and c.count() == 3


def test_find_a_symbol(kept):
    node, note = kept.find("formatValue")
    assert node.name == "formatValue" and not note
    assert kept.find("base::run")[0].file_path == "src/base.ts" and kept.find("nowhere::run") == (None, "")
    rows, note = kept.find_all("print")
    assert len(rows) >= 1 and all(r.name == "print" for r in rows)
    assert "run" in kept.details("BaseThing")


def test_requests_for_something_new():
    from symweave.operators.symbols import asks_for_something_new as new

    assert new("Add a login page") and not new("Fix the bug in add") and not new("how does build work") and not new("login page")


def test_settings(spark, tmp_path):
    from symweave import config
    from symweave.errors import ConfigError

    root = str(tmp_path)
    assert config.load(root) == config.Config()
    config.changed(root, include=("**/*.txt",), exclude=("**/gen/**",), pattern=config.Pattern("todo", "TODO: (.+)", "constant"), languages=("python",))
    now = config.changed(root, include=("**/*.txt",), pattern=config.Pattern("todo", "FIXME (.+)", "constant"))
    assert now == config.load(root) and now.include[-1] == "**/*.txt" and now.include.count("**/*.txt") == 1 and [p.pattern for p in now.patterns] == ["FIXME (.+)"]
    for bad in ({"languages": ("klingon",)}, {"most": "1"}, {"pattern": config.Pattern("x", "(a+)+", "constant")}, {"pattern": config.Pattern("x", "(", "constant")}, {"pattern": config.Pattern("x", "a", "thing")}):
        with pytest.raises(ConfigError):
            config.changed(root, **bad)
    assert config.load(root) == now
    (tmp_path / ".symweave/config.json").write_text("{")
    with pytest.raises(ConfigError):
        config.load(root)


def test_aliases_come_from_the_tree(spark, tmp_path):
    files = {"tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"#lib/*": ["source/lib/*"]}}}', "source/lib/a.ts": "export function deep() {}\n", "source/m.ts": "import { deep } from '#lib/a';\nexport function go() { deep(); }\n"}
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    p = project.Project(spark, str(tmp_path), str(tmp_path / "graph"))
    p.index()
    found = p.graph.edges.filter("kind = 'calls'").select("metadata.resolved_by").collect()
    assert [r[0] for r in found] == ["import"]
    assert "deep" in p.explore("how does deep go")
