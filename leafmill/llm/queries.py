"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import bpe, decontaminate, extraction, language_id, line_dedup, pii, quality, secrets, simhash, spelling, token_output, toxicity, whitening
from leafmill.llm.common import held_out, shared_dir, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after line dedup, with how many characters it lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_before"))
    return line_dedup.dedup(docs).select("doc_id", "text", (F.col("n_before") - F.length("text")).cast("long").alias("n_removed"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to coded files and read back from them."""
    to = f"{shared_dir(spark)}/leafmill/{uuid.uuid4().hex}/ids"
    token_output.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, to)
    return token_output.read(spark, to)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that share a template window, and whether it is a leak."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the adaptive quality rules for every document."""
    return quality.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reasons")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    return pii.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.hexed(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate with its score; values only as digests."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document by the byte-level vocabulary, as digests."""
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every vector on the principal axes of all distinct ones."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.train(rows))


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, by its host's template."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its near words, its form and its root."""
    return spelling.grouped(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_toxicity, op3_token_output, op4_decontaminate, op5_quality, op6_language, op7_pii, op8_simhash, op9_secrets, op10_bpe, op11_whitening, op12_extraction, op13_spelling)}


def oracle_sql() -> dict[str, str]:
    return {}
