"""Operators held against brute force on the small tables and on made-up documents."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from symweave.llm import catalog, sql, substring_dedup

TABLES = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}


def plain_substring(texts, window=35):
    words = {k: WORD.findall(t or "") for k, t in texts.items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup_on_tables(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in catalog.op1_substring_dedup(spark, TABLES).collect()}
    assert got == plain_substring(texts)


def test_substring_dedup_on_shared_passages(spark, monkeypatch):
    rng = random.Random(9)
    vocabulary = ["of", "the", "a"] + [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (34, 35, 36, 50, 120)]
    texts = {}
    for k in range(120):
        out = []
        for _ in range(rng.randrange(1, 6)):
            out += rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        texts[k] = " ".join(out)
    texts[200], texts[201], texts[202] = "la " * 90, "la di " * 60, "x " * 36
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(6)
    want = plain_substring(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.parsed(docs, "digest").collect()}
    assert got == want
    spans = {r.doc_id: sum(s.stop - s.first for s in r.spans) for r in substring_dedup.parsed(docs, "text").collect()}
    assert spans == {k: v[1] for k, v in want.items()}
    # The factors: long enough, true of their references, greedy, and together all that goes.
    words = {k: WORD.findall(t) for k, t in texts.items()}
    some = 0
    for r in substring_dedup.parsed(docs, "factors").collect():
        covered, free = set(), -1
        for f in r.factors:
            assert f.length >= 35 and (f.ref, f.ref_start) != (r.doc_id, f.start)
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.ref][f.ref_start : f.ref_start + f.length]
            assert f.start + f.length > free
            free = f.start + f.length
            covered |= set(range(f.start, free))
            some += f.length > 35
        assert len(covered) == want[r.doc_id][1]
    assert some > 50


def test_a_factor_spans_many_blocks(spark):
    """A copied passage of 400 words is one factor, although it holds many blocks, and its ends are found to the word."""
    rng = random.Random(3)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(400)]
    texts = {1: [f"a{i}" for i in range(50)] + passage + [f"b{i}" for i in range(50)], 2: ["c"] + passage[7:393] + ["d"] * 3}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.parsed(docs, "factors").collect()}
    assert got == {1: [(57, 386, 2, 1)], 2: [(1, 386, 1, 57)]}


def test_rows_that_repeat_are_judged_once(spark):
    rng = random.Random(5)
    body = " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(300))
    rows = spark.range(10_000).selectExpr("CAST(NULL AS long) AS doc_id").withColumn("text", F.lit(body))
    docs = rows.unionByName(spark.createDataFrame([(1, "x y z " + body[: len(body) // 2] + " end")], "doc_id long, text string"))
    began = time.time()
    got = substring_dedup.parsed(docs, "digest").groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted((r.n_words, r.n_removed, r["count"]) for r in got if r.doc_id is None) == [(300, 300, 10_000)]
    assert time.time() - began < 60


def test_common_anchors_take_the_other_way(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {k: f"{'a b c ' * (k % 5)}s{k} {passage} e{k} {passage if k % 3 else ''}" for k in range(700)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.parsed(docs, "digest").collect()}
    assert got == plain_substring(texts)


def test_simhash_on_tables(spark, texts):
    import xxhash

    prints = {}
    for k, t in texts.items():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    parent = {k: k for k in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in catalog.op9_simhash(spark, TABLES).collect()}
    assert got == {k: (f"{v:016x}", root(k)) for k, v in prints.items()}


def test_simhash_links_and_tiles(spark, monkeypatch):
    from symweave.llm import simhash
    from symweave.llm.components import components

    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(12):
            s ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4)))
            fps.add(s)
    fps = sorted(fps)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    want = {}
    for i, f in enumerate(fps):
        want.setdefault(root(i), set()).add(f)
    want = {frozenset(v) for v in want.values() if len(v) > 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for tile in (4096, 2):
        monkeypatch.setattr(simhash, "TILE", tile)
        found = {}
        for r in components(simhash.links(nodes)).collect():
            found.setdefault(r.root, set()).add(r.node % (1 << 64))
        assert {frozenset(v) for v in found.values()} == want


def test_exact_dedup_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{TABLES}/documents.parquet'")
    want = {tuple(r) for r in con.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({sql.OP10})").fetchall()}
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in catalog.op10_exact_dedup(spark, TABLES).collect()}
    assert got == want


def test_bpe_matches_the_library_on_tables(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    from symweave.llm import bpe_trie

    lib = Tokenizer.from_file(public_tokenizers.path(bpe_trie.TOKENIZER))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in catalog.op4_bpe(spark, TABLES).collect()}
    for k, t in texts.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert got[k] == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))


def test_flac_reads_back_what_was_written(spark, texts):
    import zlib

    for r in catalog.op3_flac(spark, TABLES).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 or (192 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


@pytest.mark.parametrize("query, label, least", [("op2_toxicity", "toxic", 0.85), ("op6_quality", "quality", 0.97)])
def test_classifiers_on_held_out_rows(spark, query, label, least):
    tables = "/root/testdata/sf0.1"
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{tables}/labels.parquet").collect()}
    rows = [r for r in catalog.queries()[query](spark, tables).collect() if r.held_out and truth.get(r.doc_id) is not None]
    right = sum(r.predicted == truth[r.doc_id] for r in rows) / len(rows)
    caught = [r.predicted for r in rows if truth[r.doc_id] == 1]
    assert right > 0.95 and sum(caught) / len(caught) > least and all(0 <= r.score <= 1 for r in rows)


def test_language_of_documents_and_pages(spark):
    tables = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = catalog.op8_language(spark, tables).collect()
    docs = [r for r in rows if r.doc_id is not None]
    assert len(docs) == len(truth) and sum(r.lang == truth[r.doc_id] for r in docs) / len(docs) > 0.98
    pages = [r for r in rows if r.page_id is not None]
    assert sum(r.lang == r.declared for r in pages) / len(pages) > 0.98


SQL_QUERIES = ["op1_substring_dedup", "op5_mixing", "op7_pii", "op10_exact_dedup"]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A documents table with a hot source, null sources and texts, personal data shared by documents, copies and a huge row."""
    rng = random.Random(8)
    names = [f"user{k}@mail.org" for k in range(30)] + [f"10.1.{k}.7" for k in range(20)] + ["4111 1111 1111 1111", "+1 (555) 010-9999", "+44 20 7946 0000"]
    rows = []
    for i in range(1500):
        words = [rng.choice("abcdefghij") + str(int(rng.paretovariate(0.6)) % 400) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.2:
            who = rng.randrange(len(names))
            words[rng.randrange(len(words)) :] = [names[who], f"Secret{who}", "it's"]
        rows.append((i, " ".join(words), rng.choice(["a"] * 12 + ["b"] * 3 + ["c", None])))
    rows += [(2000, None, "a"), (2001, "", None), (2002, "w " * 4000, "d"), (2003, "  \t", "e"), *[(2100 + k, rows[k % 3][1], "a") for k in range(60)]]
    at = tmp_path_factory.mktemp("skewed")
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.mark.parametrize("query", SQL_QUERIES)
@pytest.mark.parametrize("tables", ["small", "skewed"])
def test_queries_match_sql(spark, skewed, query, tables):
    import duckdb

    at = TABLES if tables == "small" else skewed
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet{'' if tables == 'small' else '/*.parquet'}'")
    df = catalog.queries()[query](spark, at)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[query]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_every_pass_has_its_own_permutation(spark, skewed):
    from symweave.llm import mixing

    docs = spark.read.parquet(f"{skewed}/documents.parquet")
    got = mixing.mixed(docs, entropy=1.0, repeats=1e9, budget=1.2e5).toPandas()
    b = got[got.source == "b"]
    passes = int(b["pass"].max())
    orders = [b[b["pass"] == p].sort_values(["block", "position"]).doc_id.tolist() for p in range(1, passes + 1)]
    assert passes >= 3 and all(sorted(o) == sorted(orders[0]) for o in orders[:-1])
    assert orders[0] != orders[1] and set(orders[-1]) < set(orders[0])
    blocks = [b[b["pass"] == p].groupby("block").doc_id.apply(frozenset) for p in (1, 2)]
    assert set(blocks[0]) == set(blocks[1]) and list(blocks[0]) != list(blocks[1])  # the same blocks in another order
    for _, rows in b.groupby(["pass", "block"]):
        assert sorted(rows.position) == list(range(1, len(rows) + 1))


def test_a_limit_that_no_mix_can_keep(spark, skewed):
    from symweave.llm import mixing

    docs = spark.read.parquet(f"{skewed}/documents.parquet")
    with pytest.raises(ValueError, match="budget"):
        mixing.mixed(docs, repeats=1.5, budget=1e6)


def test_dual_descent_is_near_its_optimum():
    """Primal and dual objective of the hinge loss nearly meet, which no other point does."""
    import numpy as np

    from symweave.llm import quality

    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 300, 25)) for _ in range(400)]
    y = np.array([float((f < 40).sum() * 3 + rng.normal() > 11) for f in rows])
    values = [np.full(len(f), 1 / np.sqrt(len(f))) for f in rows]
    w, bias = quality.descend(y, rows, values, rounds=2000)
    cost = 0.5 / np.where(y > 0, (y > 0).mean(), (y == 0).mean())
    margin = np.where(y > 0, 1, -1) * np.array([w[f] @ v + bias for f, v in zip(rows, values)])
    primal = 0.5 * (w @ w + bias * bias) + (cost * np.maximum(0, 1 - margin)).sum()
    for _ in range(200):  # no small step anywhere makes it better by more than the tolerance
        step, b = rng.normal(0, 0.01, len(w)), rng.normal(0, 0.01)
        step[300:] = 0
        m = np.where(y > 0, 1, -1) * np.array([(w + step)[f] @ v + bias + b for f, v in zip(rows, values)])
        assert 0.5 * ((w + step) @ (w + step) + (bias + b) ** 2) + (cost * np.maximum(0, 1 - m)).sum() >= primal - 1e-3


@pytest.mark.parametrize("of, label", [("quality", "quality"), ("toxicity", "toxic")])
def test_scores_by_a_plain_formula(spark, of, label):
    """Scores of whole texts from a model's numbers, one document and one term at a time."""
    import importlib
    import math

    import pyarrow as pa

    from symweave.llm.shared import text_bytes

    part = importlib.import_module(f"symweave.llm.{of}")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = part.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), label)
    got = {r.doc_id: r for r in part.rated(docs, model).collect()}
    for r in list(got.values())[:150]:
        data, offsets = text_bytes(pa.array([r.text]))
        found = sorted(set(part.terms(data, offsets)[1].tolist()))
        if of == "quality":
            norm = math.sqrt(sum(float(model.square[t]) for t in found))
            z = model.slope * (sum(float(model.weight[t]) for t in found) / max(norm, 1e-9) + model.bias) + model.shift
        else:
            known = [int(model.place[t]) for t in found if model.place[t] >= 0]
            z = model.bias + sum(model.weight[t] for t in known)
            z += sum(float(model.factors[a] @ model.factors[b]) for i, a in enumerate(known) for b in known[i + 1 :])
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-4


def test_language_by_a_plain_fusion(spark):
    """Fused scores of records with given likelihoods, from counts taken in Python."""
    import math

    from symweave.llm import language

    rng = random.Random(6)
    names = ["de", "en", "fr"]
    rows = []
    for i in range(400):
        host = rng.choice(["a.x.org", "a.x.org", "b.x.org", "c.y.com", "d.z.de", None])
        like = [rng.uniform(-9, 0) for _ in names] if rng.random() < 0.9 else [0.0] * 3
        rows.append((i, None, host, host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1], rng.choice(["en", "de", "xx", None]), like))
    shape = "doc_id long, page_id long, host string, domain string, suffix string, declared string, likelihood array<double>"
    got = {r.doc_id: r for r in language.fused(spark.createDataFrame(rows, shape).repartition(3), names).collect()}
    vote = {i: max(range(3), key=lambda k: like[k]) if max(like) > min(like) else None for i, *_, like in rows}

    def votes(test):
        return [sum(vote[r[0]] == k for r in rows if test(r)) for k in range(3)]

    def smooth(v, up):
        return [(x + 5 * u) / (sum(v) + 5) for x, u in zip(v, up)]

    flag = {r[0]: r[5] if r[5] in names else "-" if r[5] is None else "?" for r in rows}

    def likelihoods(of):
        kinds = {of(r) for r in rows}
        tables = {x: votes(lambda r: of(r) == x) for x in kinds}
        return {x: [math.log((t[k] + 1) / (sum(u[k] for u in tables.values()) + len(kinds))) for k in range(3)] for x, t in tables.items()}

    base = [x + 1 for x in votes(lambda r: True)]
    base = [x / sum(base) for x in base]
    by_flag, by_tail = likelihoods(lambda r: flag[r[0]]), likelihoods(lambda r: r[4])
    for r in rows:
        prior = smooth(votes(lambda q: q[4] == r[4]), base)
        prior = smooth(votes(lambda q: q[3:5] == r[3:5]), prior)
        prior = smooth(votes(lambda q: q[2:5] == r[2:5]), prior)
        total = [r[6][k] + math.log(prior[k]) + by_flag[flag[r[0]]][k] + by_tail[r[4]][k] for k in range(3)]
        best = max(total)
        assert got[r[0]].lang == names[total.index(best)]
        assert abs(got[r[0]].score - 1 / sum(math.exp(t - best) for t in total)) < 1e-5


def test_bpe_on_letters_and_marks_of_any_age():
    import unicodedata

    import public_tokenizers
    from symweave.llm import bpe_trie
    from tokenizers import Tokenizer

    path = public_tokenizers.path(bpe_trie.TOKENIZER)
    lib, bpe = Tokenizer.from_file(path), bpe_trie.TrieBpe(open(path, encoding="utf-8").read())
    rng = random.Random(1)
    marks = [c for c in range(0x300, 0x11000) if unicodedata.combining(chr(c))]
    letters = [c for c in range(0x41, 0x3000) if chr(c).isalpha()]
    texts = ["a\u1df6\u0323", "a\u1ac1\u0323", "a\u08d3\u0301", "\u1100\u1161\u11a8 \uac00\u11a8", "\u304b\u3099", "\u2000\u212b\u037e", "Σ İ ǅ ﬁ"]
    texts += ["".join(chr(rng.choice(letters)) + "".join(chr(rng.choice(marks)) for _ in range(rng.randrange(3))) for _ in range(rng.randrange(1, 4))) for _ in range(100_000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x500), rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(6)) for _ in range(20_000)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert bpe.encode(text) == want.ids, ascii(text)
