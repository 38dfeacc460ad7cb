"""Language identification by Bayesian evidence fusion.

The text's likelihood under byte-trigram models is combined with the language that a page's markup declares, the suffix of
its address, and a prior of its host that is smoothed towards its domain, its suffix and the whole corpus.  The
likelihoods of declarations and suffixes and all priors come from grouped sums over every record, in which each record counts for the
language that its text alone suggests.  Documents without an address take their source as host.

The trigram models are fitted on at most ``SAMPLE`` labelled documents, one for every language among them.  Defined cases: a null or wordless text is
judged by the other evidence alone; a null host, suffix or declaration is a value of its own; without labelled documents the
result has no language; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.llm.labelled import remainder, training_rows
from symweave.llm.quality import LOWER
from symweave.llm.shared import meet, mix, slices, staged, text_bytes

BITS, SAMPLE = 16, 4096
#: Trigrams of one text count as so many independent ones at most: neighbours tell much the same.
GRAMS = 40.0
#: Records that a level of the host hierarchy weighs as much as.
STRENGTH = 5.0
DECLARED = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]+)""", re.I)
HTML = re.compile(r"<html\b", re.I)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of the byte trigrams of texts laid end to end; A-Z count as a-z."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = LOWER[data].astype(np.uint64)
    key = b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = doc[:-2] == doc[2:]
    return doc[:-2][whole], (mix(key[whole]) >> np.uint64(64 - BITS)).astype(np.int64)


def declared_language(page: str) -> str | None:
    """What the first <html> tag says. Linear in the page."""
    opens = HTML.search(page)
    if not opens:
        return None
    close = page.find(">", opens.end())
    found = DECLARED.search(page, opens.end(), close if close >= 0 else len(page))
    return found[1].lower() if found else None


def plain_text(page: str) -> str:
    """The text between the tags; scripts, styles and comments go; an unclosed tag ends the page. Linear in the page."""
    kept, at, low = [], 0, page.lower()
    if len(low) != len(page):
        low = page
    while (tag := page.find("<", at)) >= 0:
        kept.append(page[at:tag])
        close = ">"
        for start, stop in (("<!--", "-->"), ("<script", "</script>"), ("<style", "</style>")):
            if low.startswith(start, tag):
                close = stop
        at = low.find(close, tag + 1)
        if at < 0:
            break
        at += len(close)
    else:
        kept.append(page[at:])
    return html.unescape(" ".join(kept))


class Trigrams:
    """Log likelihoods of texts in each language."""

    def __init__(self, y: np.ndarray, rows: list[np.ndarray], names: list[str]):
        self.names = names
        counts = np.full((len(names), 1 << BITS), 0.1)
        for c, f in zip(y.astype(int), rows):
            counts[c][f] += 1
        self.table = np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32) if names else np.zeros((1 << BITS, 0), np.float32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row a text, one column a language; scaled to GRAMS trigrams at most."""
        n = len(offsets) - 1
        doc, bucket = trigrams(data, offsets)
        size = np.bincount(doc, minlength=n)
        sums = np.stack([np.bincount(doc, self.table[bucket, k], n) for k in range(len(self.names))], 1) if self.names else np.zeros((n, 0))
        return sums * np.minimum(1, GRAMS / np.maximum(size, 1))[:, None]


def fit(docs: DataFrame, most: int = SAMPLE, held: int = 0, folds: int = 5) -> Trigrams:
    """From documents with a lang; those whose crc32 remainder is `held` are left out."""
    left = remainder(F.col("doc_id"), folds)
    known = docs.filter(F.col("lang").isNotNull() & (left >= 0) & (left != held)).groupBy("doc_id").agg(F.min("lang").alias("lang"))
    chosen = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "chosen")
    names = sorted(r[0] for r in chosen.select("lang").distinct().collect())  # no more than the sample has rows
    if not names:
        return Trigrams(np.zeros(0), [], [])
    spot = F.array_position(F.array(*map(F.lit, names)), F.col("lang")) - 1
    y, rows = training_rows(docs, chosen.select("doc_id", spot.cast("int").alias("y")), trigrams)
    return Trigrams(y, rows, names)


def addressed(pages: DataFrame) -> DataFrame:
    """page_id, host, domain (its last two labels), suffix (its last label), and the page itself."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host == "", None).otherwise(host)
    return pages.select("page_id", host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"), F.col("html").alias("text"))


def evidence(records: DataFrame, model: Trigrams) -> DataFrame:
    """records (doc_id, page_id, host, domain, suffix, text) with the declared language and the likelihoods, without the text."""
    sent = records.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "page_id", "host", "domain", "suffix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                is_page, bodies = batch.column(5).to_pylist(), batch.column(6)
                declared: list[str | None] = [None] * len(is_page)
                if any(is_page):
                    texts = bodies.to_pylist()
                    for k, page in enumerate(is_page):
                        if page and texts[k]:
                            declared[k] = declared_language(texts[k])
                            texts[k] = plain_text(texts[k])
                    bodies = pa.array(texts, pa.string())
                scores = sent.value(*text_bytes(bodies))
                flat = pa.array(scores.reshape(-1).astype(np.float64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(declared, pa.string()), lists], [*names, "declared", "likelihood"])

    shape = "doc_id bigint, page_id bigint, host string, domain string, suffix string, declared string, likelihood array<double>"
    return records.select(*names, F.col("page_id").isNotNull().alias("is_page"), "text").mapInArrow(run, shape)


def fused(seen: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, page_id, lang, score, text_lang and declared of every record of seen (see evidence)."""
    n = len(names)
    if not n:
        return seen.select("doc_id", "page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("text_lang"), "declared")

    def first_best(values: str) -> Column:
        """The place, from 1, of the largest value; the first of equals."""
        return F.array_position(values, F.array_max(values)).cast("int")

    # A text without trigrams has equal likelihoods and votes for nothing.
    seen = seen.withColumn("vote", F.when(F.array_max("likelihood") > F.array_min("likelihood"), first_best("likelihood")))
    flag = seen.withColumn("flag", F.when(F.col("declared").isin(names), F.col("declared")).when(F.col("declared").isNull(), "-").otherwise("?"))

    def counted(*keys: str) -> DataFrame:
        """keys, votes (one number a language) and size, the number of records."""
        one = flag.groupBy(*keys, "vote").agg(F.count("*").cast("double").alias("n"))
        met = F.map_from_entries(F.collect_list(F.when(F.col("vote").isNotNull(), F.struct("vote", "n"))))
        found = one.groupBy(*keys).agg(met.alias("met"), F.sum("n").alias("size"))
        return found.select(*keys, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.coalesce(F.element_at("met", k), F.lit(0.0))).alias("votes"), "size")

    def smoothed(up: str) -> Column:
        """Shares of the votes with STRENGTH further records like `up`."""
        total = F.aggregate("votes", F.lit(STRENGTH), lambda a, v: a + v)
        return F.zip_with("votes", up, lambda v, u: (v + STRENGTH * u) / total)

    def likelihoods(key: str) -> DataFrame:
        """key and log p(key | language), smoothed by one record of each language."""
        table = staged(counted(key), "counts")
        sums = table.agg(F.array(*[F.sum(F.col("votes")[k]) for k in range(n)]).alias("sums"), F.count("*").alias("kinds"))  # one row
        return table.crossJoin(F.broadcast(sums)).select(key, F.zip_with("votes", "sums", lambda v, s: F.log((v + 1.0) / (s + F.col("kinds")))).alias(f"by_{key}"), "votes")

    def added(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    corpus = counted().select(F.transform("votes", lambda v: (v + 1) / F.aggregate("votes", F.lit(float(n)), lambda a, x: a + x)).alias("base"))
    # Each level of the hierarchy takes the one above as its prior; the hosts of most records are broadcast.
    suffixes = likelihoods("suffix").crossJoin(F.broadcast(corpus)).select(F.col("suffix").alias("s"), "by_suffix", smoothed("base").alias("by_up"))
    domains = counted("suffix", "domain").join(suffixes, F.col("suffix").eqNullSafe(F.col("s")))
    domains = domains.select(F.col("suffix").alias("ds"), F.col("domain").alias("d"), smoothed("by_up").alias("by_up"), "by_suffix")
    hosts = counted("suffix", "domain", "host").join(domains, F.col("domain").eqNullSafe(F.col("d")) & F.col("suffix").eqNullSafe(F.col("ds")))
    told = added("tail", "prior")
    hosts = hosts.select("suffix", "domain", "host", F.transform(smoothed("by_up"), lambda p: F.log(p)).alias("prior"), F.col("by_suffix").alias("tail"), "size")
    hosts = staged(hosts.select("suffix", "domain", "host", told.alias("told"), "size"), "hosts")
    flags = likelihoods("flag").drop("votes")
    met = meet(flag, hosts, ["suffix", "domain", "host"], "size", rows=hosts.count()).join(F.broadcast(flags), "flag")  # one row a language and two more
    met = met.withColumn("total", added("likelihood", "told")).withColumn("total", added("total", "by_flag")).select("doc_id", "page_id", "declared", "vote", "total")
    labels = F.array(*map(F.lit, names))
    mass = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("total")))
    return met.select("doc_id", "page_id", F.get(labels, first_best("total") - 1).alias("lang"), F.round(1 / mass, 6).alias("score"), F.get(labels, F.col("vote") - 1).alias("text_lang"), "declared")


def identified(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """The language of every document (doc_id, text, source; lang for the fit) and page (page_id, url, html)."""
    model = fit(docs)
    none = F.lit(None)
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.cast("long").alias("page_id"), F.col("source").alias("host"), F.col("source").alias("domain"), none.cast("string").alias("suffix"), "text").unionByName(
        addressed(pages).select(none.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "host", "domain", "suffix", "text")
    )
    return fused(staged(evidence(records, model), "evidence"), model.names)
