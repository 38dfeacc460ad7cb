"""Personal data with information-theoretic sanitisation.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers by fixed patterns.  A protected entity is
a base value.  Every word outside the base spans of a document that holds an entity is counted with it, in whole
documents over the whole corpus, as are all terms and all documents.  A term discloses an entity where its pointwise
mutual information with the entity reaches SHARE of the entity's own information, -log2 p(entity): it then tells nearly
as much as the entity itself.  Every occurrence of such a term in a document that holds the entity becomes a further
span: ``remove`` where the share is one (the term occurs nowhere without the entity), else ``generalise``.  An entity
of a single document counts like any other.  Entities that stand in the same documents disclose by the same terms, so they are
counted as one class: a document with many entities of its own pairs its terms with one class, not with each of them.

Defined cases: a null text is the empty text; offsets are code points, end exclusive; texts without entities have no
spans; copies of one text are documents like any other; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.shared import meet, slices, span_hashes, staged, text_bytes, word_spans

SHARE = 0.8
KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the base kinds and their parts.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Terms are compared without the case of A-Z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_TABLE = np.frombuffer(LOWER, np.uint8)

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ backwards: linear in the text."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            found.append(("email", start, free := domain.end()))
        at = text.find("@", max(at + 1, free))
    return found


def addresses(text: str) -> list[Span]:
    """Each four parts of a dotted run of numbers in turn; runs of three parts or fewer hold none."""
    found = []
    for run in DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append(("ip", at, at + size))
            at += size + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) << (k & 1)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    found = []
    for m in CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found


def phones(text: str) -> list[Span]:
    return [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def base_spans(text: str) -> list[Span]:
    """By kind in the order of KINDS, then by start."""
    found = emails(text) if "@" in text else []
    if DIGIT.search(text):
        found += addresses(text) + cards(text) + (phones(text) if "+" in text else [])
    return found


def joined(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def _hashed(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def entity(kind: str, value: str) -> int:
    """Equal for writings of one value: letter case and separators do not count."""
    return _hashed(f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}".encode())


def terms(text: str, spans: list[Span]) -> list[tuple[bytes, int, int]]:
    """(term, start, end) of the words that are in no base span."""
    found, taken, k, end = [], sorted((a, b) for _, a, b in spans), 0, 0
    for m in WORD.finditer(text):
        x, y = m.span()
        while k < len(taken) and taken[k][0] < y:
            end = max(end, taken[k][1])
            k += 1
        if end <= x:
            found.append((m[0].encode().translate(LOWER), x, y))
    return found


def term_hash(terms: list[bytes]) -> np.ndarray:
    """The same hashes as term_counts makes."""
    data = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms], dtype=np.int64) if terms else np.zeros(0, np.int64)
    return span_hashes(data, ends - np.array([len(t) for t in terms], np.int64), ends)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base results of each document, its entities and the words that stand beside them."""
    for whole in batches:
        for batch in slices(whole, "text"):
            out: list[list] = [[], [], [], [], [], []]
            near, held, sizes = [np.zeros((3, 0), np.int64)], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                kinds = [k for k, _, _ in spans]
                shown = joined(spans)
                if around := terms(text, spans) if spans else []:
                    hashes = term_hash([t for t, _, _ in around]).view(np.int64)
                    near.append(np.stack([hashes, *(np.fromiter((x[k] for x in around), np.int64, len(around)) for k in (1, 2))]))
                held.append(list({entity(k, text[a:b]) for k, a, b in spans}))
                sizes.append(len(around))
                row = [*(kinds.count(k) for k in KINDS), hashlib.sha256(shown.encode()).hexdigest(), shown]
                for column, value in zip(out, row):
                    column.append(value)
            flat = np.concatenate(near, 1)
            inner = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1].astype(np.int32)), pa.array(flat[2].astype(np.int32))], ["term", "start", "stop"])
            cut = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string()), pa.array(held, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(cut), inner)],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "near"],
            )


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): in how many documents each word occurs, over all documents; counted in each slice, then added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                data, offsets = text_bytes(batch.column(0))
                starts, ends, doc = word_spans(data, offsets)
                words = span_hashes(LOWER_TABLE[data], starts, ends)
                order = np.lexsort((doc, words))
                words, doc = words[order], doc[order]
                first = np.ones(len(words), bool)
                first[1:] = (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])
                terms, counts = np.unique(words[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts, pa.int64())], ["term", "df"])

    return docs.select(docs[text].alias("text")).mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def disclosing(held: DataFrame, beside: DataFrame, docs: DataFrame, text: str = "text", share: float = SHARE) -> DataFrame:
    """(row, term, exact): the terms of each row that disclose one of its entities.

    held: distinct (row, entity); beside: distinct (row, term).  Mutual information reaches `share` of the entity's information
    where c * total / (df * n) >= (total / n) ** share, and c is n at most: a term with df over total ** (1 - share) * n ** share
    can disclose none, so the others alone are paired with entities.
    """
    total = F.lit(float(docs.count()))
    counts = held.groupBy("entity").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("who")).filter(F.col("n") < total)
    # Entities of the same documents are one class.
    of = staged(meet(held, counts.withColumn("size", F.col("n")), ["entity"], "size").select("row", F.xxhash64("n", "who").alias("class"), "n").distinct(), "classes")
    most = F.pow(total, F.lit(1 - share)) * F.pow(F.col("n"), F.lit(share)) * (1 + 1e-9)
    widest = of.agg(F.max(most).alias("widest"))
    rare = term_counts(docs, text).join(F.broadcast(widest), F.col("df") <= F.col("widest")).select("term", "df", F.col("df").alias("size"))
    pairs = staged(meet(beside, rare, ["term"], "size").join(of, "row").filter(F.col("df") <= most).select("row", "class", "term", "df", "n"), "pairs")
    told = F.log2(F.col("c") * total / (F.col("df") * F.col("n")))
    own = F.log2(total / F.col("n"))
    both = pairs.groupBy("class", "term", "df", "n").agg(F.count("*").alias("c")).filter(told >= share * own)
    both = both.select("class", "term", (F.col("c") >= F.col("df")).alias("exact"), "c")
    return meet(pairs, both, ["class", "term"], "c").groupBy("row", "term").agg(F.bool_or("exact").alias("exact"))


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, counts by kind, base_sha256 and all spans."""
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, base string, entities array<bigint>, near array<struct<term:bigint,start:int,stop:int>>"
    found = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(_found, shape)
    rows = staged(found.withColumn("row", F.monotonically_increasing_id()), "spans")
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.*")
    told = staged(disclosing(rows.select("row", F.explode("entities").alias("entity")), near.select("row", "term").distinct(), docs, text), "disclosing")
    extra = (
        near.join(told, ["row", "term"])
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("exact"), "remove").otherwise("generalise").alias("what"), "start", "stop"))).alias("extra"))
    )
    shown: Column = F.transform("extra", lambda x: F.concat_ws(":", x["what"], x["start"], x["stop"]))
    all_spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("extra") > 0, F.array_join(shown, ",")))
    return rows.join(extra, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", all_spans.alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the text's spans replaced: base kinds and generalised terms by a placeholder, removed terms by nothing; doc_id is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for body, listed in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                body = body or ""
                parts = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in (listed or "").split(",") if x))
                at, pieces = 0, []
                for a, b, k in parts:
                    if a >= at:
                        pieces += [body[at:a], "" if k == "remove" else f"[{'term' if k == 'generalise' else k}]"]
                        at = b
                done.append("".join(pieces) + body[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(done, pa.string())], ["doc_id", "sanitised"])

    kind = docs.schema[doc_id].dataType.simpleString()
    pairs = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).join(found.select("doc_id", "spans"), "doc_id", "left").select("doc_id", "text", "spans")
    return pairs.mapInArrow(run, f"doc_id {kind}, sanitised string")
