"""A training corpus from ``documents``: toxicity, near copies, benchmark passages, mixing, token files.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns of ``documents``; the
last one returns what it reads back from its token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glossa.llm import decontamination, mixing, simhash, token_output, toxicity
from glossa.llm.shared import new_path, staged, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not reject."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near copies (five-word shingles, similarity 0.8)."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, up to twice each, with sources near their targets."""
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what went into the token files."""
    manifest = token_output.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, new_path(spark, "tokens"))
    return token_output.read_tokens(manifest, docs.schema["doc_id"].dataType.simpleString())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The model and the fingerprints are no matter of SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
