"""A corpus pipeline: language, exact and near copies, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; rejected ones go."""
    from swirlframe.llm.language import keep_identified

    return keep_identified(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    from swirlframe.llm.exact_dedup import exact_dedup

    return exact_dedup(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    from swirlframe.llm.near_dedup import near_dedup

    return near_dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a share of benchmark passages."""
    from swirlframe.llm.decontaminate import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    import public_tokenizers

    from swirlframe.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))[1]


STAGES = [
    ("language id", identified),
    ("exact dedup", distinct_texts),
    ("near dedup", without_near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language models, tokenizers and best fit are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other; each is written to the shared folder and read again, and what the stage before wrote is deleted then."""
    from swirlframe.llm.shared import removed, scratch

    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made, at = stage(spark, docs, sf_dir), scratch(spark, "stage-" + name.replace(" ", "-"))
        made.write.option("compression", "zstd").parquet(at)
        docs = spark.read.schema(made.schema).parquet(at)
        if last:
            removed(spark, last)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
