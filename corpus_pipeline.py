"""A corpus pipeline out of the operators in turnwake.llm.

Each stage takes (spark, docs, sf_dir), works on every document that the stage before kept,
and returns all columns of documents; the last one returns packed sequences.

1. language: documents that the classifier rejects go: null or without a letter, or far from the
   codeword of every language learnt (gibberish, other languages). Ambiguous ones hold two
   languages, are clean, and stay.
2. exact: of texts equal after lower-casing A-Z, the row with the largest doc_id stays.
3. near: of documents linked by word shingles, the one with the smallest doc_id stays.
4. leaks: documents that hold a benchmark item go.
5. packing: the documents left, as pieces of sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwake.llm import decontaminate, exact_dedup, language_id, ngram_join, packing


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_told(docs, language_id.fit(docs.select("text", "lang")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words and a similarity of 0.8, as for near duplicates in general."""
    return ngram_join.drop_near_duplicates(docs, k=5, percent=80)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    p = public_tokenizers.path
    return packing.pack(docs, str(p("byte_bpe_50k.json")), str(p("byte_bpe_50k.tiktoken")))


STAGES = [("language", language), ("exact", exact), ("near", near), ("leaks", leaks), ("packing", packed)]

#: The models, the join and the packing have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
