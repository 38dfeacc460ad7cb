"""The near-duplicate stage of the pipeline against all pairs of whole shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from symweave.llm import near_copies, simhash


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(texts):
    """{doc_id: smallest doc_id of its class}."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def planted():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    texts, passage = {}, " ".join(word() for _ in range(40))
    for k in range(60):
        base = [word() for _ in range(rng.randrange(60, 260))]
        texts[len(texts)] = f"{passage} {' '.join(base)}"
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1, 9)):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = f"{passage} {' '.join(copy)}"
    words = [word() for _ in range(150)]
    for _ in range(150):  # one large group
        copy = list(words)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(150)] = word()
        texts[len(texts)] = " ".join(copy)
    for t in (None, "", " \t", "One two", "one  TWO", "a b c d e", "a b c d e f"):
        texts[len(texts)] = t
    return texts


@pytest.mark.parametrize("tile", [1024, 16])
def test_stage_drops_every_near_copy(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    texts = planted()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = plain_classes(texts)
    assert len(set(want.values())) < len(texts) - 150
    assert {r.doc_id: r.component_id for r in near_copies.classes(docs).collect()} == want
    if tile == 1024:
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(want.values())


def test_nulls_and_empty_tables(spark):
    rows = [(None, "a b c d e f g"), (3, "A b c d e f g"), (2, None), (1, ""), (None, "x y"), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()), key=str)
    assert got == sorted([(3, "A b c d e f g"), (1, ""), (None, "x y"), (5, "z")], key=str)
    assert simhash.deduplicated(docs.limit(0)).count() == 0
    got = {(r.doc_id, r.fp == 0): r.component_id for r in simhash.classes(docs.filter("doc_id > 0"), bits=simhash.LIMIT).collect()}
    assert got[1, True] == got[2, True] == 1 and simhash.classes(docs.limit(0), bits=simhash.LIMIT).count() == 0


def test_keys_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(1)
    shared = 0
    for _ in range(60):  # 200 of 250 shingles in common: 0.8
        words = rng.integers(1 << 62, size=300).astype(np.uint64)
        a, b = np.sort(words[:225]), np.sort(np.concatenate([words[:200], words[225:250]]))
        keys = near_copies.band_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        shared += int((keys[0] == keys[1]).sum())
    assert abs(shared / 60 / near_copies.BANDS - 0.8**5) < 0.05
    hashes, at = near_copies.shingle_sets(pa.array(["a b c d e f", None, "A B"]))
    assert np.diff(at).tolist() == [2, 0, 1] and len(hashes) == 3


def test_pieces_are_sides_of_random_hyperplanes():
    hashes, at = near_copies.shingle_sets(pa.array(["a b c d e f g h i", None, "a b c d e f g h j", "k " * 3000]))
    planes = near_copies._planes()
    bits = []
    for x, y in zip(at, at[1:]):
        if x < y:
            total = sum(planes[int(near_copies.mix(h ^ near_copies._STEP)) >> 51].astype(int) for h in hashes[x:y])
            bits.append([int(v > 0) for v in total])
    found = near_copies.band_keys(hashes, at)
    assert found.shape == (3, near_copies.BANDS)
    assert [[int(p) >> b & 1 for p in row for b in range(near_copies.BITS)] for row in found] == bits


def test_near_groups_join_other_components_only():
    far = np.uint64((1 << 64) - 1)
    words = np.zeros((4, 6), np.uint64)
    words[:, 2] = far
    words[0, 1] = np.uint64(7)
    group, root = np.array([1, 1, 1, 2, 2, 3]), np.array([10, 11, 12, 13, 13, 14])
    assert near_copies.near_groups(group, root, list(words)).tolist() == [0, 0, 2, 3, 4, 5]
