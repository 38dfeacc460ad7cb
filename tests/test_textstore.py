"""Stored text indexes: after many updates they answer as fresh ones, in few segments; locks that their writers left."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symweave import project
from symweave.errors import StoreError
from symweave.operators import textindex
from symweave.sources import store, textstore

WORDS = ["get", "getter", "user", "item", "save", "load", "path", "node"]
SCHEMA = "id string, name string, qualified_name string, docstring string, signature string"


def row(rng, file, k):
    pick = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return (f"f{file}:{k}", pick(1), f"{pick(1)}::{pick(1)}", rng.choice([None, "", pick(4)]), rng.choice([None, f"({pick(2)})"]))


def same(got, want):
    for query in ("get", "user save", "node::path", "get_us"):
        left, right = ({r.id: r.score for r in textindex.ranked(index, query).collect()} for index in (got, want))
        assert left == pytest.approx(right, rel=1e-9)


def frame(spark, rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame(pa.table({c: pa.array([r[k] for r in rows], pa.string()) for k, c in enumerate(names)}), SCHEMA)


def test_updates_equal_a_fresh_index(spark, tmp_path):
    rng, at = random.Random(5), str(tmp_path / "g")
    files = {f: [row(rng, f, k) for k in range(rng.randrange(5))] for f in range(30)}
    every = lambda: [r for rows in files.values() for r in rows]
    text = textstore.written(frame(spark, every()), at)
    for step in range(20):
        touched = rng.sample(sorted(files), 2)
        before = [r for f in touched for r in files[f]]
        for f in touched:
            some = [r if rng.random() < 0.5 else row(rng, f, k) for k, r in enumerate(files[f])]
            files[f] = [] if rng.random() < 0.2 else some + [row(rng, f, len(some) + k) for k in range(rng.randrange(3))]
            files[f] += files[f][: rng.randrange(2)]  # a row that repeats, or goes on repeating
        text = textstore.updated(text, frame(spark, before), frame(spark, [r for f in touched for r in files[f]]), at)
        sizes = [s["postings"] + s["dead"] for s in text["segments"]]
        assert all(size >= textstore.FACTOR * sum(sizes[k + 1 :]) for k, size in enumerate(sizes[:-1]))
        if step in (3, 11, 19):
            fresh, got = textindex.build(frame(spark, every())), textstore.opened(spark, text, at)
            assert (got.rows, got.tokens) == (fresh.rows, fresh.tokens)
            key = ["term", "id", "col", "pos", "d"]
            assert got.postings.select(key).exceptAll(fresh.postings.select(key)).isEmpty() and fresh.postings.select(key).exceptAll(got.postings.select(key)).isEmpty()
    same(got, fresh)
    textstore.swept(spark, at, text)
    assert {p.name for p in (tmp_path / "g/text").iterdir()} == {s["name"] for s in text["segments"]}
    assert textstore.updated(text, frame(spark, every()[:9]), frame(spark, every()[:9]), at) == text


def test_merging_keeps_sizes_apart():
    assert textstore._first([100]) == 0
    assert textstore._first([100, 10]) == 1
    assert textstore._first([100, 10, 3]) == 1
    assert textstore._first([100, 20, 6]) == 0
    assert textstore._first([0, 0]) == 1


def test_empty_indexes_and_questions_by_term(spark, tmp_path, capsys):
    at = str(tmp_path)
    text = textstore.written(frame(spark, []), at)
    assert textindex.ranked(textstore.opened(spark, text, at), "get").collect() == []
    one = [("a", "get", "get", None, None)]
    text = textstore.updated(text, frame(spark, []), frame(spark, one), at)
    text = textstore.updated(text, frame(spark, one), frame(spark, [("a", "put", "put", None, None), ("b", "get", None, None, None)]), at)
    index = textstore.opened(spark, text, at)
    assert {r.id for r in textindex.ranked(index, "get").collect()} == {"b"} and {r.id for r in textindex.ranked(index, "put").collect()} == {"a"}
    index.postings.filter(F.col("term").startswith("ge")).explain()
    assert "StringStartsWith(term,ge)" in capsys.readouterr().out


def test_projects_keep_their_index(spark, tmp_path, monkeypatch):
    at = tmp_path / "t"
    at.mkdir()
    for name in "abcd":
        (at / f"{name}.ts").write_text("\n".join(f"/** Opens the {w} of {name}. */\nexport function {w}{name.upper()}() {{}}" for w in WORDS) + "\n")
    kept = project.Project(spark, str(at), str(tmp_path / "g"))
    kept.index()
    (at / "a.ts").write_text("export function getOther() {}\n")
    (at / "b.ts").unlink()
    monkeypatch.setattr(textstore, "written", None)  # a sync writes no whole index
    kept.sync()
    build = textindex.build
    monkeypatch.setattr(textindex, "build", None)  # and a search builds none
    got = kept.text
    fresh = build(project.searched(kept.graph.nodes))
    assert (got.rows, got.tokens) == (fresh.rows, fresh.tokens)
    same(got, fresh)
    assert [r.name for r in kept.search("getOther", 1).collect()] == ["getOther"]


def test_a_lock_ends_after_its_lease(spark, tmp_path):
    at = str(tmp_path / "g")
    (tmp_path / "g").mkdir()
    (tmp_path / "g/lock").write_text("a writer that is gone")
    with pytest.raises(StoreError, match="another writer"), store.locked(spark, at):
        pass
    time.sleep(1.5)
    with store.locked(spark, at, 1.0) as own:
        own()
        time.sleep(2.5)  # renewed meanwhile
        with pytest.raises(StoreError, match="another writer"), store.locked(spark, at, 1.5):
            pass
        own()
        (tmp_path / "g/.lock.crc").unlink()
        (tmp_path / "g/lock").write_text("another")
        with pytest.raises(StoreError, match="taken over"):
            own()
    assert (tmp_path / "g/lock").read_text() == "another"
    assert [p.name for p in (tmp_path / "g").iterdir() if p.name.startswith(("lock-", "sign-"))] == []
