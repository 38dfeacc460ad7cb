"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.llm import alignment, bpe_trie, exact_dedup, flac, labelled, language, mixing, negatives, page_text, pii, quality, simhash, sql, substring_dedup, toxicity
from symweave.llm.shared import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.parsed(table(spark, sf_dir, "documents"), "digest")


def _judged(spark: SparkSession, sf_dir: str, of, label: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = of.fit(docs, table(spark, sf_dir, "labels"), label)
    return of.rated(docs, model).select(
        "doc_id",
        (F.col("doc_id").isNull() | (labelled.remainder(F.col("doc_id"), of.FOLDS) == of.HELD)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, toxicity, "toxic")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir, quality, "quality")


def op3_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents"))


def flac_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3_flac's result that SQL can tell."""
    return op3_flac(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.digests(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"), bits=simhash.LIMIT)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extracted(table(spark, sf_dir, "pages"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_flac, op4_bpe, op5_mixing, op6_quality, op7_pii, op8_language, op9_simhash, op10_exact_dedup, op11_html, op12_hard_negatives, op13_alignment, flac_payloads)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": sql.OP1, "flac_payloads": sql.PAYLOADS, "op5_mixing": sql.OP5, "op7_pii": sql.OP7, "op10_exact_dedup": sql.OP10, "op11_html": sql.OP11, "op12_hard_negatives": sql.OP12}
