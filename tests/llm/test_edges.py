"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from symweave.llm import alignment, bpe_trie, exact_dedup, flac, language, mixing, pii, quality, simhash, substring_dedup, toxicity

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))


LONG = prose(30_000, 1)
ROWS = [
    (0, prose(80, 2), "en", "a", 1),
    (1, None, "en", "a", None),
    (2, "", None, None, 0),
    (3, " \t\n ", "en", "b", 4),
    (4, prose(80, 2), "en", "b", 1),  # a copy of 0
    (4, prose(80, 2), "en", "b", 1),  # a repeated row
    (5, LONG, "en", "c", 9),
    (6, "x" * 200_000, "en", "c", 9),
    (7, prose(20, 3) + " " + prose(50, 4), "de", "c", 9),
    (8, prose(20, 5) + "  " + prose(50, 4) + "\n" + prose(9, 6), "de", "c", 9),
    (9, "one two", "fr", "d", 2),
    (None, "one  two", "fr", "d", 2),
    (10, "na " * 300, "fr", "d", 2),
    (11, "Mail A.b@c-d.org or +1 (555) 010-9999, 10.0.0.255, 4111 1111 1111 1111; <|endoftext|>Don't", "en", "d", 2),
]
EXTRA = "key text2 copy kept score component_id fp bucket term n x anchor content first blocks digest row place doc".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, None), (4, 1, 1), (7, 0, 1), (8, None, None), (None, 1, 1), (9, 0, 0), (10, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")


def with_extras(df):
    return df.select("*", *[F.lit(k).alias(name) for k, name in enumerate(EXTRA)])


def judged(docs, labels, of, label):
    return of.rated(docs.select("doc_id", "text"), of.fit(docs, labels, label)).select("doc_id", "score")


def pages_of(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("http://h.example.org/x")).alias("url"), F.concat(F.lit('<html lang="en"><script>1<2</script><p>'), "text").alias("html"))


RUNS = {
    "substring": lambda d, y: substring_dedup.parsed(d, "digest"),
    "substring_factors": lambda d, y: substring_dedup.parsed(d, "factors").withColumn("factors", F.transform("factors", lambda f: f["length"])),
    "substring_text": lambda d, y: substring_dedup.parsed(d, "text"),
    "toxicity": lambda d, y: judged(d, y, toxicity, "toxic"),
    "flac": lambda d, y: flac.digests(d),
    "pcm": lambda d, y: flac.pcm_blocks(flac.stored(d)),
    "bpe": lambda d, y: bpe_trie.digests(d),
    "bpe_ids": lambda d, y: bpe_trie.encoded(d),
    "alignment": lambda d, y: alignment.digests(d),
    "alignment_groups": lambda d, y: alignment.aligned(d),
    "mixing": lambda d, y: mixing.mixed(d),
    "mixing_drawn": lambda d, y: mixing.drawn(d),
    "quality": lambda d, y: judged(d, y, quality, "quality"),
    "pii": lambda d, y: pii.spans(d),
    "pii_text": lambda d, y: pii.sanitised(d, pii.spans(d)),
    "language": lambda d, y: language.identified(d, pages_of(d)),
    "simhash": lambda d, y: simhash.classes(d),
    "simhash_docs": lambda d, y: simhash.deduplicated(d),
    "exact": lambda d, y: exact_dedup.assign(d),
    "exact_docs": lambda d, y: exact_dedup.deduplicated(d),
}
PER_ROW = {"alignment", "alignment_groups", "substring", "substring_text", "substring_factors", "toxicity", "flac", "bpe", "bpe_ids", "quality", "pii", "simhash", "exact"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows_extra_columns_and_empty_tables(docs, labels, name):
    run = RUNS[name]
    got = run(docs, labels)
    plain = sorted(map(repr, got.collect()))
    if name in PER_ROW:
        assert len(plain) == len(ROWS)
    more = run(with_extras(docs), labels)
    assert sorted(map(repr, more.select(got.columns).collect())) == plain
    empty = run(docs.limit(0), labels.limit(0))
    assert empty.columns == got.columns and empty.count() == 0


def test_exact_dedup_by_hand(docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.assign(docs, least=2).collect()}
    rows = exact_dedup.assign(docs, least=2).collect()
    text = {}
    for doc, body, *_ in ROWS:
        text.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", body or ""), []).append(doc)
    for norm, ids in text.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        known = [i for i in ids if i is not None]
        for i in ids:
            r = got[(i, sha)]
            assert r.group_size == len(ids) and r.keep_id == (min(known) if known else None)
    assert sum(r.kept for r in rows) == len(text)
    assert rows and {r.doc_id for r in exact_dedup.deduplicated(docs, least=2).collect()} == {r.doc_id for r in rows if r.kept}


def test_heavy_and_light_groups_agree(spark):
    rows = [(i, f"copy {i % 3}" if i % 2 else f"own {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    light, heavy = ({tuple(r) for r in exact_dedup.assign(docs, least=k).collect()} for k in (10**9, 2))
    assert light == heavy and len(light) == 600


def test_mixing_keeps_to_budget_and_limit(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else f"s{i % 50}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for entropy, repeats in ((0.99, 100.0), (1.0, 2.0), (0.0, 4.0)):
        got = mixing.mixed(docs, entropy=entropy, repeats=repeats).toPandas()
        once = got.drop_duplicates("doc_id")
        total = once.n_tokens.sum()
        took = (once.n_tokens * once.copies).groupby(once.source).sum()
        weight = once.groupby("source").weight.first()
        assert abs(weight.sum() - 1) < 1e-6
        assert (abs(took - weight * total) <= 7 + 1e-3).all()  # within one document
        assert once.copies.max() <= repeats + 1 and len(got) == once.copies.clip(lower=1).sum()
        if entropy == 0.0:
            assert (once.copies == 1).all()
    drawn = mixing.drawn(docs, entropy=1.0, repeats=100.0)
    want = mixing.mixed(docs, entropy=1.0, repeats=100.0).filter("copies > 0").groupBy("doc_id").count().collect()
    assert drawn.columns == docs.columns and sorted(map(tuple, drawn.groupBy("doc_id").count().collect())) == sorted(map(tuple, want))


def test_mixing_of_rows_that_repeat(spark):
    """Rows with one doc_id and text are rows of their own: an extra pass takes as many of them as fit."""
    docs = spark.createDataFrame([(None, "a b", "x")] * 900 + [(k, "c d", "y") for k in range(100)], "doc_id long, text string, source string")
    got = mixing.mixed(docs, entropy=1.0, repeats=100.0).groupBy("source", "pass").count().collect()
    found = {(r.source, r["pass"]): r["count"] for r in got if r["pass"] is not None}
    assert found[("x", 1)] == 500 and found[("y", 1)] == 100 and found[("y", 5)] >= 99


def test_near_duplicates_lose_no_text(spark):
    a, b = prose(60, 21), prose(60, 22)
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (2, b, 3), (None, a + " end", 4), (None, prose(60, 23), 5), (None, prose(60, 23), 6), (3, None, 7), (4, "", 8)]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("1", a), ("2", b), ("None", prose(60, 23)), ("3", "")])


def test_one_row_of_a_repeated_doc_id_is_learnt_from(spark):
    from symweave.llm.labelled import training_rows

    sent = []
    docs = spark.range(200_000).selectExpr("7L AS doc_id", "concat('some text ', id % 1000) AS text").unionByName(spark.createDataFrame([(8, "other")], "doc_id long, text string"))
    y, rows = training_rows(docs, spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, y int"), quality.terms)
    sent = quality.terms(*_bytes("some text 0"))[1]
    assert y.tolist() == [1.0, 0.0] and sorted(rows[0]) == sorted(set(sent.tolist()))


def _bytes(text):
    import pyarrow as pa

    from symweave.llm.shared import text_bytes

    return text_bytes(pa.array([text]))


def test_every_language_of_the_sample_is_learnt(spark):
    """A hundred languages of few documents each: none is left out."""
    rows = [(i, " ".join(f"{chr(97 + k // 26)}{chr(97 + k % 26)}q{k}" for _ in range(30)), f"l{k:03}", "s") for i, k in enumerate(list(range(100)) * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language.fit(docs)
    assert len(model.names) == 100
    got = language.identified(docs, spark.createDataFrame([], "page_id long, url string, html string")).collect()
    assert sum(r.lang == rows[r.doc_id][2] for r in got) > 390


def test_linear_in_one_long_text():
    import time

    import pyarrow as pa

    text = " ".join(f"user.name{k}@mail.example.org 10.0.0.{k % 256} and" for k in range(23_000))
    began = time.time()
    batch = next(pii._found(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])])))
    assert batch.column(1)[0].as_py() == batch.column(2)[0].as_py() == 23_000 and time.time() - began < 6
    began = time.time()
    assert language.declared_language("<html " * 170_000) is None and language.declared_language("<HTML class=a lang = 'Fr'>") == "fr"
    assert language.declared_language("<htmlx lang=de><html lang=en>") == "en" and language.declared_language("<html><p lang=en>") is None
    language.plain_text("<html " * 170_000)
    assert time.time() - began < 3


def test_meet_agrees_with_a_join(spark):
    from symweave.llm.shared import meet

    left = spark.createDataFrame([(k % 7 if k % 5 else None, k) for k in range(300)], "k long, x long")
    right = spark.createDataFrame([(None, "n", 60), *[(k, f"v{k}", 40) for k in range(5)]], "k long, v string, n long")
    for how in ("inner", "left"):
        want = left.join(right, left["k"].eqNullSafe(right["k"]), how).select(left["k"], "x", "v").collect()
        for most in (0, 2, 100):
            assert sorted(map(repr, meet(left, right, ["k"], "n", how, most).collect())) == sorted(map(repr, want))


def test_bpe_memo_may_start_anew(spark, docs, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path(bpe_trie.TOKENIZER))
    bpe = bpe_trie.TrieBpe(open(public_tokenizers.path(bpe_trie.TOKENIZER), encoding="utf-8").read())
    monkeypatch.setattr(bpe_trie, "MEMO", 50)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz'!?.,- 0123éñßΣİ́\x1c " + "etaoin" * 4
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(40))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x"])
        want = lib.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == want
        assert bpe.decode(want) == lib.decode(want, skip_special_tokens=False)


def flac_parts():
    import numpy as np

    rng = np.random.default_rng(3)
    wave = np.arange(192 * 200)
    parts = [rng.integers(0, 256, 192 * 5), np.full(192 * 3, 7), 128 + 60 * np.sin(wave / 1.3) + 40 * np.sin(wave / 0.8), np.repeat([0, 255], 192 * 2), np.full(192, 32), rng.choice([0, 255], 192 * 4), 128 + np.where(np.arange(384) % 192 < 96, 1, 90) * rng.uniform(-1, 1, 384)]
    return [p.astype(np.uint8) for p in parts]


def test_flac_round_trip():
    import numpy as np

    parts = flac_parts()
    sizes = np.array([len(p) for p in parts])
    streams = flac.encode(np.concatenate(parts), sizes)
    back, lengths = flac.decode(streams)
    assert (back == np.concatenate(parts)).all() and (lengths == sizes).all()
    for p, s in zip(parts, streams):  # a payload gives the same stream in any company
        assert flac.encode(p, np.array([len(p)])) == [s]
    # A wave takes linear predictors and several Rice partitions; noise is stored as it is.
    body = np.frombuffer(streams[2], np.uint8)
    s = flac._parsed(streams[2], True)
    f = flac._found(body[s.frames :], np.array([0]), np.array([len(body) - s.frames]))
    kinds = body[s.frames :][f.subframes] >> 1
    assert (kinds >= 32).mean() > 0.9 and len(streams[2]) < 0.7 * len(parts[2])
    assert len(f.starts) == 200 and len(s.points) == -(-200 // flac.POINT)
    # Without its seek table a stream is read only on demand.
    cut = 42 + 4 + int.from_bytes(streams[2][43:46])
    bare = streams[2][:4] + b"\x80" + streams[2][5:42] + streams[2][cut:]
    assert (flac.decode([bare], seekable=False)[0] == parts[2]).all()
    with pytest.raises(ValueError):
        flac.decode([bare])


def test_flac_reads_plain_frames_bit_by_bit():
    """A slow reader of one frame, written from the format alone, finds the samples that were stored."""
    import numpy as np

    def read(bits, order_of):
        at = 0

        def take(n):
            nonlocal at
            value = int(bits[at : at + n] or "0", 2)
            at += n
            return value

        signed = lambda v, n: v - (1 << n) if n and v >> (n - 1) else v
        assert take(16) == 0xFFF8 and take(16) == 0x1402
        lead = take(8)
        for _ in range(max(0, 8 - len(bin(~lead & 0xFF)[2:]) - 1) if lead >= 0x80 else 0):
            take(8)
        take(8)
        kind = take(8) >> 1
        if kind == 0:
            return [signed(take(8), 8)] * 192
        if kind == 1:
            return [signed(take(8), 8) for _ in range(192)]
        order = kind - 31 if kind >= 32 else kind - 8
        out = [signed(take(8), 8) for _ in range(order)]
        if kind >= 32:
            precision, shift = take(4) + 1, take(5)
            taps = [signed(take(precision), precision) for _ in range(order)]
        else:
            taps, shift = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
        assert take(2) == 0
        parts = 1 << take(4)
        order_of.append((kind, parts))
        for p in range(parts):
            k = take(4)
            for _ in range(192 // parts - (order if p == 0 else 0)):
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                guess = sum(c * x for c, x in zip(taps, out[::-1])) >> shift
                out.append((u >> 1 ^ -(u & 1)) + guess)
        return out

    kinds = []
    for part in flac_parts():
        data, size = flac.encode_frames((part[:384].reshape(-1, 192) if len(part) > 192 else part.reshape(1, 192)).__xor__(np.uint8(128)).view(np.int8), np.arange(min(2, len(part) // 192)))
        at = 0
        for row, n in enumerate(size.tolist()):
            bits = "".join(f"{b:08b}" for b in data[at : at + n].tolist())
            want = (part[192 * row : 192 * row + 192] ^ np.uint8(128)).view(np.int8).tolist()
            assert read(bits, kinds) == want
            at += n
    assert any(k >= 32 for k, _ in kinds) and any(n > 1 for _, n in kinds)


def test_flac_damage_is_noticed():
    import numpy as np

    part = flac_parts()[2][: 192 * 70]
    stream = flac.encode(part, np.array([len(part)]))[0]
    for at in [*range(90), *range(90, len(stream), 401)]:  # magic, STREAMINFO, seek points, frames
        for bit in (0, 4, 7):
            broken = bytearray(stream)
            broken[at] ^= 1 << bit
            with pytest.raises(ValueError):
                flac.decode([bytes(broken)])
    for cut in (0, 1, 3, 4, 5, 20, 41, 42, 50, 85, len(stream) // 2, len(stream) - 1):
        with pytest.raises(ValueError):
            flac.decode([stream[:cut]])


def test_flac_samples_that_look_like_headers():
    """Stored samples may hold whole frames of a stream: their headers are no frames of this one."""
    import numpy as np

    rng = np.random.default_rng(9)
    inner, size = flac.encode_frames(rng.integers(-128, 128, (4, 192)).astype(np.int8), np.arange(4))
    noise = rng.integers(0, 256, 192 * 8).astype(np.uint8)
    noise[100 : 100 + len(inner[: 2 * size[0]])] = inner[: 2 * size[0]] ^ np.uint8(128)
    stream = flac.encode(noise, np.array([len(noise)]))
    assert (flac.decode(stream)[0] == noise).all()


def test_flac_blocks_by_seek_point(spark):
    import numpy as np

    docs = spark.createDataFrame([(1, "wave " * 9000), (2, None), (3, "short")], "doc_id long, text string")
    media = flac.stored(docs)
    held = {r.doc_id: r.media for r in media.collect()}
    rows = flac.pcm_blocks(media).collect()
    for r in rows:
        assert held[r.doc_id][r.stream_offset : r.stream_offset + 2] == b"\xff\xf8"
    payload = {k: b"".join((np.frombuffer(r.pcm, np.uint8) ^ 128).tobytes() for r in sorted(rows, key=lambda r: r.first_sample) if r.doc_id == k) for k in held}
    assert payload[1] == (b"wave " * 9000).ljust(45120) and payload[2] == b" " * 192 and payload[3] == b"short".ljust(192)
    assert sorted(r.first_sample for r in rows if r.doc_id == 1) == list(range(0, 45120, 192 * flac.POINT))


def test_pii_by_plain_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def plain(text):
        out = []
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    out.append((kind, *m.span()))
        return out

    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab.@-1 +()93.5%\né") for _ in range(rng.randrange(45)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans(ROWS[-1][1]) == plain(ROWS[-1][1]) and len(plain(ROWS[-1][1])) == 4


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"hello note{i} call zanzibar agent A@mail.org now word{i % 5} filler{i}") for i in range(6)]
    rows += [(100 + i, f"plain text{i} about nothing word{i % 5} now hello agent call") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.spans(docs).collect()}
    assert all(s == "" for i, s in got.items() if i >= 100)
    text = dict(rows)
    found = {text[i][int(a) : int(b)] for i, s in got.items() if i < 6 for k, a, b in (x.split(":") for x in s.split(",")) if k in ("remove", "generalise")}
    assert "zanzibar" in found and "hello" not in found and "now" not in found
    clean = {r.doc_id: r.sanitised for r in pii.sanitised(docs, pii.spans(docs)).collect()}
    assert "zanzibar" not in clean[0] and "@" not in clean[0] and clean[100] == text[100]


def test_factors_learn_pairs_that_no_sum_of_weights_can():
    import numpy as np

    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(2000):  # a pair of terms counts when both or neither of them stands there
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append(np.array([k for k, has in ((0, a), (1, b)) if has] + list(rng.choice(np.arange(2, 12), 3, replace=False))))
        y.append(float(a == b))
    bias, w, v = toxicity.train(np.array(y), rows, 12, rounds=60)

    def says(f):
        total = v[f].sum(0)
        return bias + w[f].sum() + 0.5 * (total @ total - (v[f] ** 2).sum()) > 0

    assert np.mean([says(f) == (t > 0.5) for f, t in zip(rows, y)]) > 0.95


def test_toxicity_learns_pairs_whose_terms_tell_nothing_alone(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("mon", "tar", "lis", "vek", "dou") for b in ("sa", "rin", "po", "gel", "tu", "wam")]
    rows = []
    for i in range(6000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = rng.sample(words, 8) + ["abc"] * a + ["xyz"] * b
        rng.shuffle(text)
        rows.append((i, " ".join(text), int(a == b)))
    made = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = made.select("doc_id", "text"), made.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)  # with production settings
    got = {r.doc_id: r.score for r in toxicity.rated(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 1000 and sum((s > 0.5) == (y == 1) for s, y in held) / len(held) > 0.97


def test_toxicity_keeps_no_pairs_of_chance():
    import numpy as np

    rng = np.random.default_rng(6)
    rows = [np.sort(rng.choice(700, 60, replace=False)) for _ in range(1500)]
    y = (rng.random(1500) < 0.2).astype(float)
    assert len(toxicity.pairing(y, rows)) == 0
    rare = [np.union1d(f[(f != 3) & (f != 650)], [k for k in (3, 650) if rng.random() < 0.5]).astype(np.int64) for f in rows]
    both = np.array([float((3 in f) == (650 in f)) for f in rare])
    assert list(toxicity.pairing(both, rare)) == [3, 650]  # in two tiles
