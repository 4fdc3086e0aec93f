"""A corpus from ``documents``: quality rules, near-duplicate removal, mixing, then token ids.

Every stage takes any table that has at least doc_id, text and source, keeps further columns whatever
their names, and gives an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.llm import byte_bpe, jaccard, mixing, quality
from scanforge.llm.common import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy.

    Null and empty texts fail it and go; rows are judged one by one, so repeated rows and rows of equal or null
    ids all stay or all go; a very long text is judged whole.
    """
    whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    return quality.ledger(whole).where(quality.passes("standard-1")).select("document.*")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the mix's proportions, repeats as repeated rows.

    Texts without words are never taken; a null source is a source of its own; equal rows share their copies evenly;
    of documents that tie in size the hash of the document decides, so reruns agree.
    """
    return mixing.mix(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.75 or more.

    The least id stays (null last, then the least hash of the row); of equal rows one; different texts under one id are
    judged by their texts; texts without words all stay; very long texts are compared whole.
    """
    return jaccard.keep_first(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and decoded bytes.

    A null or empty text has no ids; repeated rows are encoded each; columns named like the stage's own are replaced.
    """
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("mix_sources", mix_to_targets),
    ("byte_bpe", encode_tokens),
]

#: The mix's hash draws and the tokenizer's ranks have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
