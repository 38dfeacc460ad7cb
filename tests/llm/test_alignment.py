"""op13 against a plain version that walks bytes one text at a time."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symweave.llm import alignment

ODD = [
    None, "", " ", "  two  spaces ", "a", "tab\tand\nline", "▁ a block", "<|endoftext|> <s></s><unk> <0x41>", "naïve Ünïcode 漢字 かな 한국 🎉👩‍👩‍👧 é", "\x00\x1c\x85", "x" * 5_000,
    "same text", "same text", "1234 5678 don't we'll", "١٢٣ עברית ไทย ᏣᎳᎩ \U0001e900", "ǅ ʰ ⅷ ² ½", "trailing \n\n  ", "﻿bom", "　wide space",
]


def letters():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(rows):
    table, a = letters(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    bytes_a = lambda i: bytes([table[c] for c in a.id_to_token(i)]) if all(c in table for c in a.id_to_token(i)) else a.id_to_token(i).encode()
    bytes_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    found, total = [], Counter()
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        left = [(i, bytes_a(i)) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        right = [(i, bytes_b(b.id_to_piece(i))) for i in b.encode(text or "")]
        if not text or b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            left = right = []
        ends = []
        for side in (left, right):
            at, out = 0, {}
            for i, x in side:
                at += len(x)
                out[at] = i
            ends.append(out)
        cuts = set(ends[0]) & set(ends[1])
        linked = [(ends[0][c], ends[1][c]) for c in cuts]
        total.update(linked)
        runs = []
        for side in ends:
            runs.append([[]])
            for at in sorted(side):
                runs[-1][-1].append(str(side[at]))
                if at in cuts:
                    runs[-1].append([])
        groups = ["|".join(map(",".join, both)) for both in zip(runs[0][:-1], runs[1][:-1], strict=True)]
        found.append((doc, len(left), len(right), len(groups), linked, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    top = {}
    for (x, y), n in total.items():
        top[y] = max(top.get(y, 0), n)
    return sorted((d, a, b, g, len(l), sum(total[p] == top[p[1]] for p in l), sum(total[p] for p in l), sha) for d, a, b, g, l, sha in found)


def test_digests_equal_a_walk_over_bytes(spark, monkeypatch):
    rng = random.Random(3)
    rows = list(enumerate(ODD))
    rows += [(len(rows) + k, "".join(rng.choice("ab cdé漢  \n1'st") for _ in range(rng.randrange(80)))) for k in range(60)]
    rows += [(len(rows) + k, "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x10000, 0x1FFFF), 32])) for _ in range(40))) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("a", "b", "at", "row", "pair", "n_links", "run")})
    monkeypatch.setattr(alignment, "RUN", 7)
    told = alignment.digests(docs)
    assert told.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = plain(rows)
    assert sorted(map(tuple, told.collect())) == expected
    monkeypatch.setattr(alignment, "BROADCAST", 0)  # the way for vocabularies without a small bound
    assert sorted(map(tuple, alignment.digests(docs).collect())) == expected
    # Repeated rows and null ids are rows of their own; counts are of the whole corpus.
    twice = alignment.digests(docs.unionAll(docs.withColumn("doc_id", F.lit(None).cast("long"))))
    assert twice.count() == 2 * len(rows) and twice.agg(F.sum("count_sum")).first()[0] == 4 * sum(r[6] for r in expected)
    assert alignment.digests(docs.limit(0)).count() == 0


def test_groups_and_links_of_the_general_result(spark):
    rows = [(0, "the quick brown fox, 漢字 supercalifragilistic"), (1, None)]
    got = {r.doc_id: r for r in alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    r = got[0]
    assert [i for g in r.groups for i in g.a] == r.a and [i for g in r.groups for i in g.b] == r.b
    assert [(g.a[-1], g.b[-1]) for g in r.groups] == [tuple(x) for x in r.links]
    assert r.a_ends[-1] == r.b_ends[-1] == len((" " + rows[0][1]).encode())
    assert got[1].groups == [] and got[1].links == [] and got[1].a == []


def test_bound_of_distinct_pairs_holds():
    pair = alignment.Pair(*alignment._files(None, None))
    a, b = set(pair.a), set(pair.b)
    suffixes = sum(x[k:] in b for x in pair.a for k in range(len(x))) + sum(x[k:] in a for x in pair.b for k in range(len(x)))
    assert suffixes <= pair.most_pairs() < alignment.BROADCAST
