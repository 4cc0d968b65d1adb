"""The registered queries of this subpackage, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import prepare, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.fingerprints import document_fingerprints

    return document_fingerprints(_table(spark, sf_dir, "documents"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.sharding import hilbert_shards

    return hilbert_shards(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.language_id import fit_on_documents, held_out, predict_languages

    docs = _table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit_on_documents(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.decontamination import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("hits")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.substrings import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.token_store import read_digests, write_store

    folder = shared_folder(spark, "token-store")
    write_store(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.html_text import extract_main_text

    return extract_main_text(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_merkle_fingerprints, op3_hilbert_shards, op4_language_id, op5_decontamination, op6_repeated_passages, op7_token_store, op8_byte_bpe, op9_simhash, op10_main_text)}


def oracle_sql() -> dict[str, str]:
    from factloom.llm import decontamination, fingerprints

    return {"op2_merkle_fingerprints": fingerprints.oracle_sql(), "op5_decontamination": decontamination.ORACLE_SQL}
