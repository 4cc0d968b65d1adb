"""Corpus pipeline: from raw documents to token ids, one operator a stage.

Each stage takes the documents that the stage before kept. ``run`` writes each
stage's rows to the shared folder and reads them again, so a lost executor
costs the running stage only; what the stage read is then deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.bpe import encode_documents
from factloom.llm.decontamination import drop_contaminated
from factloom.llm.language_id import fit_on_documents, keep_identified
from factloom.llm.simhash import drop_near_copies
from factloom.llm.substrings import drop_repeated_passages
from factloom.session import delete_folder, prepare, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go."""
    prepare(spark)
    return keep_identified(docs, fit_on_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the smallest doc_id stays."""
    prepare(spark)
    return drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out; documents without a word left go."""
    prepare(spark)
    return drop_repeated_passages(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the benchmark's windows cover a twentieth or more go."""
    return drop_contaminated(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    prepare(spark)
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the fitted language model, chaining and BPE; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            delete_folder(spark, before)
        before = folder
    return docs
