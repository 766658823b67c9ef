"""The corpus pipeline: from raw documents to packed sequences.

Stages run in order, each on all that the one before kept, written as Parquet in between: documents whose language
can't be told go, then toxic ones, then all but one of each group of near-duplicates (five words, similarity 0.8); byte
strings that an earlier document holds are cut out; what is left is packed. All stages but the last return the columns
of ``documents``. Null text doesn't pass the first stage; a text that is wholly cut out stays as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import language_id, near_duplicates, packing, substrings, toxicity
from labelloom.llm._common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), payload="crc32")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("packing", pack),
]
#: SQL has no context trees, random fields or tokenizer; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
