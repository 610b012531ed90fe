"""From raw documents to token ids: five stages over the whole table, each written as Parquet and read again.

Quality rules and the quality classifier reject documents, of each near-duplicate class the document with the
smallest id stays, documents with a benchmark window go, and what is left is encoded. All stages but the
last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import bpe_encode
from quire.llm.common import discard, staged
from quire.llm.decontamination import drop_contaminated
from quire.llm.near_duplicates import keep_firsts
from quire.llm.quality_model import keep_likely
from quire.llm.quality_rules import keep_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the rules before have taken most of the documents that are labelled 0
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return keep_likely(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn_from=labelled)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_firsts(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = staged(stage(spark, docs, sf_dir), name)
        discard(docs)  # what this stage read
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
