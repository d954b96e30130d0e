"""The pipeline over documents: toxicity, exact dedup, SimHash near-dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import exact_dedup, mixing, packing, simhash, toxicity
from corpuscle.llm.common import stage, table

#: Words whose ids a worker keeps: few, as packing follows other stages in the same workers.
CACHED = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text, the one of the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the five-word shingles, or all but 2 of 64 SimHash bits), the one of the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the target weights of their sources, in an order shuffled over all."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 token ids, padded, and the length of each before its padding. The vocabulary has fewer than 65,536 ids."""
    return packing.sequences(packing.pack_documents(docs, with_ids=True, cached=CACHED, width=2))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: The first stage's classifier and the fourth's tokenizer are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
