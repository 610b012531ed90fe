"""The pipeline's stages against the operators' own verdicts, on the small tables and on odd rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, decontamination, near_duplicates, quality_model, quality_rules
from quire.llm.common import staged

SF = "/root/testdata/sf0.001"


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_take_effect(spark):
    docs = docs_table = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    want = [
        lambda d: ids(quality_rules.quality_rules(d).filter("kept")),
        lambda d: ids(d) & ids(quality_model.quality_scores(docs_table, labels).filter("predicted = 1")),
        lambda d: {r.class_id for r in near_duplicates.near_duplicates(d).collect()},
        lambda d: ids(decontamination.digest(decontamination.find_benchmark(d, bench)).filter("not contaminated")),
    ]
    for (name, stage), keep in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        out = staged(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        assert ids(out) == keep(docs) and out.count() == len(ids(out)) <= docs.count(), name
        assert stage(spark, docs_table, SF).count() < docs_table.count(), name  # each rejects some by itself
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    library = {r.doc_id: r.ids for r in bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"), frequent=0).collect()}
    got = last.collect()
    assert {r.doc_id: r.ids for r in got} == library and all(r.n_tokens == len(r.ids) for r in got)
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()} == library


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.col("doc_id")).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows and columns with names that operators use."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clash = {c: F.lit("x") for c in ("host", "allowance", "n_words", "c0", "cls", "copies", "of", "rate", "label", "a.b", "tick`s", "__head_k1")}
    docs = docs.withColumns(clash)
    one = docs.filter("length(text) > 400").orderBy("doc_id").limit(1)
    null = lambda c: docs.schema[c].dataType
    odd = one.withColumn("text", F.lit(None).cast("string")).union(one.withColumn("text", F.lit(""))).union(one.withColumns({"doc_id": F.lit(None).cast(null("doc_id")), "source": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")}))
    long = one.withColumns({"doc_id": F.lit(10**9).cast(null("doc_id")), "text": F.repeat(F.concat("text", F.lit("\n")), 400)})
    docs = staged(docs.union(odd).union(one).union(one).union(long), "odd")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = staged(stage(spark, docs, SF), name)
        assert out.columns == before.columns
        assert out.exceptAll(docs).count() == 0, name  # rows stay as they are
        assert out.filter("text IS NULL OR text = ''").count() == 0
        docs = out
    assert docs.count() > 0
    same = docs.join(one.select("text").distinct(), "text", "left_semi")
    assert same.count() <= 1  # of equal rows and equal texts one at most
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert got.count() == docs.count()
