"""Corpus pipeline: documents in, token ids of a clean corpus out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read back as
the next stage's docs.  All but the last return the columns of documents; the first four
decide which documents, or which of their lines, stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm import bpe, decontaminate, line_dedup, quality, simhash
from upkeep.llm.common import documents, fresh
from upkeep.session import Scratch

#: Token ids have no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the current policy."""
    name = fresh(docs.columns, "ledger")
    rows = quality.ledger(docs, name=name)
    return rows.filter(quality.passes(F.col(f"{name}.fail_bits"), quality.CURRENT)).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats; a document none of whose lines stay
    goes.  ``n_chars``, where there, follows the text."""
    name = fresh(docs.columns, "lines")
    rows = line_dedup.dedup_lines(docs, name=name).filter(F.col(f"{name}.n_left") > 0)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies."""
    return simhash.keep_first(docs, simhash.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    name = fresh(docs.columns, "leaks")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_leaks(docs, bench, name=name).filter(F.size(name) == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their decoded bytes, as digests."""
    return bpe.digest(bpe.encode_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
        decoded=True))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written before the next reads it."""
    docs, last = documents(spark, sf_dir), Scratch(spark)
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark)
        docs = scratch.write(stage(spark, docs, sf_dir))
        last.drop()  # what the previous stage wrote has been read
        last = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
