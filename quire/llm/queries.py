"""The thin queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import band_join, decontamination, near_duplicates as near, periodic_runs, quality_rules, source_schedule, warc
from quire.llm.bpe import bpe_digests
from quire.llm.common import fresh_dir
from quire.llm.html_text import main_text
from quire.llm.language_model import score_texts
from quire.llm.quality_model import quality_scores
from quire.llm.token_counts import token_counts
from quire.llm.training_order import document_parts, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "shards")
    return document_parts(materialise(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), out)
    return warc.read_warc(spark, out, payloads=False).drop("url")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.quality_rules(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_schedule.taken_words(source_schedule.mix(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), prepare=periodic_runs.planted))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join.near_prices(table(spark, sf_dir, "items"), table(spark, sf_dir, "sale_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_training_order": op1_training_order,
    "op2_token_counts": op2_token_counts,
    "op3_quality_model": op3_quality_model,
    "op4_warc": op4_warc,
    "op5_html_text": op5_html_text,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_bpe": op9_bpe,
    "op10_language_model": op10_language_model,
    "op11_source_schedule": op11_source_schedule,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_band_join": op13_band_join,
}
ORACLES: dict[str, str] = {
    "op4_warc": warc.SQL,
    "op6_ngram_jaccard": near.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_decontamination": decontamination.SQL,
    "op12_periodic_runs": periodic_runs.SQL,
    "op13_band_join": band_join.SQL,
}
