"""The corpus pipeline against brute-force versions of its five stages, and every stage on odd tables."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from symweave.llm import quality, sql
from symweave.llm.shared import text_bytes
from tests.llm.test_edges import EXTRA, ROWS, SHAPE
from tests.llm.test_near_copies import plain_classes

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest tables with copies, near copies and odd rows added."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    near = docs.filter("doc_id % 9 = 0").selectExpr("doc_id + 100000 AS doc_id", "concat(text, ' and one more word') AS text", "lang", "source", "n_chars")
    same = docs.filter("doc_id % 11 = 0").selectExpr("doc_id + 200000 AS doc_id", "concat(' ', text) AS text", "lang", "'src0' AS source", "n_chars")
    odd = spark.createDataFrame([(300001, None, None, None, None), (300002, "", "en", None, 0), (300003, " \t", "en", "lonely", 2), (300004, "some words " * 3000, "en", "lonely", 9)], docs.schema)
    docs.unionByName(near).unionByName(same).unionByName(odd).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{TABLES}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def plain_quality(spark, rows, tables):
    """Kept rows, by the fitted numbers applied one document and one term at a time; and those too near the limit to tell."""
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    score = {}
    for doc, text, *_ in rows:
        data, offsets = text_bytes(pa.array([text or ""]))
        found = set(quality.terms(data, offsets)[1].tolist())
        norm = math.sqrt(sum(float(model.square[t]) for t in found))
        z = model.slope * (sum(float(model.weight[t]) for t in found) / max(norm, 1e-9) + model.bias) + model.shift
        score[doc] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return [r for r in rows if score[r[0]] >= 0.3], {d for d, s in score.items() if abs(s - 0.3) < 1e-4}


def plain_exact(rows):
    first = {}
    for r in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")
        if key not in first or r[0] < first[key][0]:
            first[key] = r
    return list(first.values())


def plain_near(rows):
    roots = plain_classes({r[0]: r[1] for r in rows})
    return [r for r in rows if roots[r[0]] == r[0]]


def plain_mix(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": pa.array([r[1] for r in rows], pa.string()), "source": pa.array([r[3] for r in rows], pa.string())}))
    copies = Counter(doc for doc, times in con.sql(f'SELECT doc_id, "pass" FROM ({sql.OP5})').fetchall() if times is not None)
    return [r for r in rows for _ in range(copies[r[0]])]


def plain_tokens(rows):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = []
    for doc, text, *_ in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        out.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    return out


def test_every_stage_and_the_whole_run_equal_plain_versions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    rows = list(map(tuple, docs.collect()))
    good, doubtful = plain_quality(spark, rows, tables)
    assert not doubtful
    want = [good, plain_exact(good)]
    want.append(plain_near(want[-1]))
    want.append(plain_mix(want[-1]))
    want.append(plain_tokens(want[-1]))
    assert len(want[1]) < len(want[0]) < len(rows) and len(want[2]) < len(want[1]) and len(want[3]) != len(want[2])
    now = docs
    for (name, stage), plain in zip(corpus_pipeline.STAGES, want):
        got = stage(spark, now, tables)
        if plain is not want[-1]:
            assert got.columns == docs.columns
            now = got.cache()
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain)), name
    assert sorted(map(tuple, corpus_pipeline.run(spark, tables).collect())) == sorted(want[-1])


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_odd_rows_clashing_columns_and_empty_tables(spark, tables, stage):
    run = corpus_pipeline.STAGES[stage][1]
    docs = spark.createDataFrame(ROWS, SHAPE)
    got = run(spark, docs, tables)
    plain = sorted(map(repr, map(tuple, got.collect())))
    if stage == 1:  # a null text equals the empty one, a repeated row is one text, a null doc_id comes last
        assert len(plain) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in ROWS})
    if stage == 2:
        texts = {r.doc_id: r.text for r in got.collect()}
        assert None not in texts and 9 in texts and 1 in texts and 2 not in texts and 3 not in texts
    if stage == 4:
        assert len(plain) == len(ROWS)
    extra = docs.select("*", *[F.lit(k).alias(name) for k, name in enumerate([*EXTRA, "met", "size", "pass", "block", "places", "tie", "again", "stays", "root"])])
    more = run(spark, extra, tables)
    if stage < 4:
        assert more.columns == extra.columns
    assert sorted(map(repr, map(tuple, more.select(got.columns).collect()))) == plain
    empty = run(spark, docs.limit(0), tables)
    assert empty.columns == got.columns and empty.count() == 0
