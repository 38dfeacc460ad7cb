"""Alignment of two tokenizers' tokens by the bytes that they cover.

Tokenising is the only Python: it gives each text's ids and the byte offsets where its tokens end, for a byte-level BPE (A) and a
sentence-piece model (B).  All else is Spark's higher-order functions: ``array_intersect`` of the two end arrays gives the cuts, a merge of
ends and cuts (``sort_array``, ``filter`` over a ``sequence`` of places, ``transform``) says how many tokens each cut has before it, and from
these counts groups and links are built.  A link is the pair of tokens that end at one cut, so a text has as many links as groups.

Counts of linked id pairs are taken over the whole corpus.  Of two tokens that end together one is a suffix of the other, so there are no
more distinct pairs than `most_pairs` computes from the two vocabularies, whatever the corpus: the table of counts has a proven bound
and is broadcast; the links of a text are settled where they are read, and what is shuffled is one row a text.

Defined cases: a text that is null, empty, or not given back by either tokenizer's tokens has no tokens: zeros and an empty string; strings of
special tokens are ordinary text; rows that repeat, and rows with a null doc_id, are rows of their own; an empty table gives an empty result;
other columns may have any name.  A text of n bytes needs some 60 n bytes of working memory in the task that reads it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symweave.llm.shared import slices, staged

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Rows of 20 bytes up to which the pair counts are broadcast, judged by the bound that the vocabularies give, not by the corpus.
BROADCAST = 1 << 21
#: Links in one row of the table between the two passes.
RUN = 1024
#: Texts of these characters are split alike by every version of the Unicode tables; others go to the tokenizer file's own library.
_SETTLED = re.compile(r"[\t\n\r\x20-\x7e\xa0-ȳΑ-ΡΣ-ώЀ-џ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]*")


@cache
def _letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


class Pair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        self.library = Tokenizer.from_str(byte_level)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        letters, vocabulary = _letters(), self.library.get_vocab(with_added_tokens=False)
        self.a = [b""] * (1 + max(self.library.get_vocab().values()))
        for token, k in vocabulary.items():
            self.a[k] = bytes([letters[c] for c in token]) if all(c in letters for c in token) else token.encode()
        self.fast = self._ranked(json.loads(byte_level))
        self.b_model = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        named = [self.b_model.id_to_piece(k) for k in range(self.b_model.vocab_size())]
        self.b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in named]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a, self.b))

    def _ranked(self, file: dict) -> tiktoken.Encoding | None:
        """The same vocabulary as ranks, if the order of merges is the order of ids and nothing but the byte-level split shapes a text."""
        split, letters = file.get("pre_tokenizer") or {}, _letters()
        vocabulary, special = file["model"]["vocab"], {t["content"] for t in file.get("added_tokens", [])}
        merged = [vocabulary[a + b] for a, b in (m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"])]
        plain = file.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if not plain or merged != sorted(merged) or len(set(merged)) < len(merged):
            return None
        ranks = {bytes([letters[c] for c in token]): k for token, k in vocabulary.items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, text: str) -> np.ndarray | None:
        """Ids of A, None where they do not give the text back."""
        if self.fast is not None and _SETTLED.fullmatch(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)  # all bytes have ranks, so nothing is lost
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int32) if b"".join([self.a[i] for i in ids]) == text.encode() else None

    def both(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """Ids and ends by A, ids and ends by B, of each text."""
        none = np.zeros(0, np.int32)
        name = self.b.__getitem__
        for text, ids in zip(texts, self.b_model.encode([t or "" for t in texts], num_threads=1), strict=True):
            a = self.ids_a(" " + text) if text and b"".join(map(name, ids)) == b" " + text.encode() else None
            if a is None:
                yield none, none, none, none
            else:
                b = np.array(ids, np.int32)
                yield a, np.cumsum(self.a_sizes[a]).astype(np.int32), b, np.cumsum(self.b_sizes[b]).astype(np.int32)

    def most_pairs(self) -> int:
        """An upper bound of distinct linked pairs: of two linked tokens one is a suffix of the other, and the suffixes of a token are its bytes in number.

        A string of bytes is one token of A at most, and of B as many as share its bytes.
        """
        shared = max(1, int(np.unique(np.array(sorted(self.b), object), return_counts=True)[1].max()))
        return int(self.b_sizes.sum() + shared * self.a_sizes.sum())


_loaded: dict[int, Pair] = {}


def _pair(files: tuple[str, bytes]) -> Pair:
    key = hash(files)
    if key not in _loaded:
        _loaded[key] = Pair(*files)
    return _loaded[key]


def _files(byte_level: str | None, pieces: str | None) -> tuple[str, bytes]:
    with open(byte_level or public_tokenizers.path(BYTE_LEVEL), encoding="utf-8") as a, open(pieces or public_tokenizers.path(PIECES), "rb") as b:
        return a.read(), b.read()


TOKENS = "a array<int>, a_ends array<int>, b array<int>, b_ends array<int>"


def tokenised(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids and ends (exclusive byte offsets in space + text) by A and by B."""
    files = docs.sparkSession.sparkContext.broadcast(_files(byte_level, pieces))

    def lists(arrays: list[np.ndarray]) -> pa.Array:
        at = np.zeros(len(arrays) + 1, np.int32)
        np.cumsum([len(x) for x in arrays], out=at[1:])
        return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(files.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                columns = zip(*pair.both(batch.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[lists(list(c)) for c in columns]], ["doc_id", "a", "a_ends", "b", "b_ends"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(run, f"doc_id {kind}, {TOKENS}")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: a name that is only bound by a lambda is not written out where it is used."""
    return F.transform(F.array(value), body)[0]


def before(ends: Column, cuts: Column) -> Column:
    """How many tokens end at or before each cut; both arrays ascend and every cut is an end.

    In one ascending array of both, a cut is what equals its successor: its place there, less the cuts before it, is the number of tokens before its own.
    """
    return let(
        F.sort_array(F.concat(ends, cuts)),
        lambda merged: F.transform(F.filter(F.sequence(F.lit(0), F.size(merged) - 2), lambda k: merged[k] == merged[k + 1]), lambda place, k: place - k + 1),
    )


def _counted(tokens: DataFrame) -> DataFrame:
    """tokens with `at`, null without tokens: for each group, how many tokens of A and of B stand before it (a_from, b_from) and up to its end (a_to, b_to)."""
    first = lambda to: F.concat(F.array(F.lit(0)), F.slice(to, 1, F.size(to) - 1))
    ends = lambda c: F.struct(before(F.col("a_ends"), c).alias("a"), before(F.col("b_ends"), c).alias("b"))
    whole = lambda e: F.struct(first(e["a"]).alias("a_from"), e["a"].alias("a_to"), first(e["b"]).alias("b_from"), e["b"].alias("b_to"))
    return tokens.withColumn("at", F.when(F.size("a_ends") > 0, let(let(F.array_intersect("a_ends", "b_ends"), ends), whole)))


def groups(at: Column, a: Column, b: Column) -> Column:
    """array<struct<a, b>>: the tokens of A and B between two cuts."""
    run = lambda items, first, last: F.slice(items, first + 1, last - first)
    return F.transform(at["a_to"], lambda to, k: F.struct(run(a, at["a_from"][k], to).alias("a"), run(b, at["b_from"][k], at["b_to"][k]).alias("b")))


def _linked(at: Column, a: Column, b: Column) -> Column:
    """array<struct<a, b>>: the two tokens that end at each cut."""
    last = lambda items, to: F.transform(to, lambda i: items[i - 1])
    return F.arrays_zip(last(a, at["a_to"]).alias("a"), last(b, at["b_to"]).alias("b"))


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, a, a_ends, b, b_ends, groups and links of every text."""
    tokens = _counted(tokenised(docs, byte_level, pieces, text, doc_id))
    none = F.array().cast("array<struct<a:array<int>,b:array<int>>>")
    out = let(F.col("at"), lambda at: F.struct(groups(at, F.col("a"), F.col("b")).alias("groups"), _linked(at, F.col("a"), F.col("b")).alias("links")))
    found = tokens.withColumn("out", F.when(F.col("at").isNotNull(), out))
    return found.select(
        "doc_id", "a", "a_ends", "b", "b_ends", F.coalesce("out.groups", none).alias("groups"), F.coalesce("out.links", F.array().cast("array<struct<a:int,b:int>>")).alias("links")
    )


def _side(items: Column, first: Column, last: Column) -> Column:
    """The tokens of each group, joined by commas."""
    return F.zip_with(first, last, lambda i, j: F.when(j - i == 1, items[i]).otherwise(F.array_join(F.slice(items, i + 1, j - i), ",")))


def _written(at: Column, a: Column, b: Column) -> Column:
    """The groups as a1,a2|b1;a3|b2,b3."""
    side = lambda items, of: let(items.cast("array<string>"), lambda named: _side(named, at[f"{of}_from"], at[f"{of}_to"]))
    return F.array_join(F.zip_with(side(a, "a"), side(b, "b"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(a, b, n, best) over all rows' `pairs`: how many links hold the pair, and whether no other pair of its B id has more."""
    counts = staged(linked.select(F.explode("pairs").alias("pair")).groupBy("pair.a", "pair.b").agg(F.count("*").alias("n")), "pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("top"))
    return counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("top")).cast("long").alias("best"))


def digests(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text."""
    most = _pair(_files(byte_level, pieces)).most_pairs()
    a, b = F.col("a"), F.col("b")
    out = let(
        F.col("at"),
        lambda at: F.struct(F.sha2(_written(at, a, b), 256).alias("sha"), _linked(at, a, b).alias("pairs")),
    )
    rows = _counted(tokenised(docs, byte_level, pieces, text, doc_id)).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("a").cast("long").alias("n_a"), F.size("b").cast("long").alias("n_b"), F.when(F.col("at").isNotNull(), out).alias("out")
    )
    # A text's links are written in runs, so that a reader's batch of rows stays small.
    runs = F.coalesce(F.transform(F.sequence(F.lit(0), F.floor((F.size("out.pairs") - 1) / RUN)), lambda k: F.slice("out.pairs", k * RUN + 1, RUN)), F.array(F.lit(None).cast("array<struct<a:int,b:int>>")))
    only = lambda c, of: F.when(F.col("run") == 0, of).alias(c)
    parts = rows.select("row", "doc_id", "n_a", "n_b", F.coalesce("out.sha", F.lit("")).alias("sha"), F.posexplode(runs).alias("run", "pairs"))
    parts = staged(parts.select("row", "run", only("doc_id", F.col("doc_id")), only("n_a", F.col("n_a")), only("n_b", F.col("n_b")), only("groups_sha256", F.col("sha")), "pairs"), "linked")
    counts = staged(pair_counts(parts), "pair-counts")
    held = parts.select("row", F.explode("pairs").alias("pair")).select("row", "pair.a", "pair.b").join(F.broadcast(counts) if most <= BROADCAST else counts, ["a", "b"])
    told = held.groupBy("row").agg(F.count("*").alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    number = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return parts.filter("run = 0").drop("pairs", "run").join(told, "row", "left").select(
        "doc_id", "n_a", "n_b", number("n_links", "n_groups"), number("n_links", "n_links"), number("n_best", "n_best"), number("count_sum", "count_sum"), "groups_sha256"
    )
