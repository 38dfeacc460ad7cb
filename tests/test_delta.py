"""Syncs after random edits against full builds: the same edges, and only what a change can concern is resolved again."""

import random

from pyspark.sql import functions as F

from symweave import project
from symweave.operators import delta
from symweave.sources import tree

NAMES = ["alpha", "beta", "Gamma", "delta", "Items"]
FOLDERS = ["src", "src/lib"]


def source(rng, path, paths):
    """A module with imports, re-exports, classes, functions and calls, most of which other modules may answer."""
    lines = []
    for _ in range(rng.randrange(3)):
        to = rng.choice([*paths, "src/none.ts"])
        to = ("./" + to.rsplit("/", 1)[-1] if rng.random() < 0.5 else "@/" + to.removeprefix("src/")).removesuffix(".ts").removesuffix("/index")
        a, b = rng.choice(NAMES), rng.choice(NAMES)
        lines.append(rng.choice([f"import {{ {a} }} from '{to}';", f"import {{ {a} as {b} }} from '{to}';", f"import * as {b} from '{to}';", f"export * from '{to}';", f"export {{ {a} as {b} }} from '{to}';"]))
    for name in rng.sample(NAMES, rng.randrange(1, 4)):
        call = rng.choice([f"{rng.choice(NAMES)}()", f"{rng.choice(NAMES)}.{rng.choice(NAMES)}()", f"new {rng.choice(NAMES)}()"])
        lines.append(rng.choice([f"export function {name}() {{ {call}; }}", f"function {name}() {{ {call}; }}", f"export class {name} {{ {rng.choice(NAMES)}() {{ {call}; }} }}", f"export class {name} extends {rng.choice(NAMES)} {{}}"]))
    return "\n".join(lines) + "\n"


def rows(graph):
    return sorted(map(tuple, graph.edges.select("source", "target", "kind", "line", "col", "provenance", F.round("metadata.confidence", 6), "metadata.resolved_by").fillna("", ["provenance"]).fillna(-1).collect()), key=repr)


def test_syncs_equal_full_builds(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    paths = [f"{f}/{n}.ts" for f in FOLDERS for n in ("a", "b", "c", "d", "index")]
    for p in paths[:8]:
        (tmp_path / "t" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / p).write_text(source(rng, p, paths))
    kept = project.Project(spark, str(tmp_path / "t"), str(tmp_path / "g"))
    kept.index()
    sizes, resolved = [], delta.resolved_edges
    monkeypatch.setattr(delta, "resolved_edges", lambda refs, *rest: (sizes.append(refs.count()), resolved(refs, *rest))[1])
    for step in range(2):
        for p in rng.sample(paths, 2):
            at = tmp_path / "t" / p
            if at.exists() and rng.random() < 0.3:
                at.unlink()
            else:
                at.write_text(source(rng, p, paths))
        kept.sync()
        mine = list(sizes)
        full = project.build(tree.read(spark, str(tmp_path / "t")))
        assert rows(kept.graph) == rows(full)
        assert kept.graph.refs.count() == full.refs.count()
        sizes[:] = mine
    # A file that nothing else concerns is all that is resolved.
    (tmp_path / "t/src/lone.ts").write_text("export function unheard() { unheardOf(); }\n")
    sizes.clear()
    kept.sync()
    assert sizes == [1]


def test_frameworks_and_aliases_that_change(spark, tmp_path):
    at = tmp_path / "t"
    (at / "src/hooks").mkdir(parents=True)
    (at / "src/hooks/h.ts").write_text("export function useThing() {}\n")
    (at / "src/b.ts").write_text("export function useThing() {}\n")
    (at / "src/a.ts").write_text("import { useThing as own } from '#x/b';\nexport function main() { useThing(); own(); }\n")
    kept = project.Project(spark, str(at), str(tmp_path / "g"))
    kept.index()
    for path, text in (("src/c.ts", "import { x } from 'react';\n"), ("tsconfig.json", '{"compilerOptions": {"baseUrl": ".", "paths": {"#x/*": ["src/*"]}}}')):
        (at / path).write_text(text)
        kept.sync()
        assert rows(kept.graph) == rows(project.build(tree.read(spark, str(at)), kept.aliases()))
