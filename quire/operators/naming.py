"""Names for tabs and files; only duplicates get a suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import safe_stem


def _named(df: DataFrame, name: Column, suffixed: Column, out: str) -> DataFrame:
    """A name that one row has stays; the others take the suffixed form. Names are counted before the join, so a
    name that very many rows share is no hot partition."""
    named = df.withColumn("__name", name)
    shared = named.groupBy("__name").agg(F.count("*").alias("__n")).filter("__n > 1")
    return named.join(shared, "__name", "left").withColumn(out, F.when(F.col("__n").isNull(), F.col("__name")).otherwise(suffixed)).drop("__name", "__n")


def tab_names(books: DataFrame) -> DataFrame:
    """``books``: id, title. Cut so that the suffix always stays, which keeps long names apart."""
    suffix = F.concat(F.lit(" ("), F.col("id").cast("string"), F.lit(")"))
    most = F.lit(fixed.NAME_CHARS)
    return _named(books, F.left("title", most), F.concat(F.left("title", most - F.length(suffix)), suffix), "tab")


def file_stems(books: DataFrame) -> DataFrame:
    stem = safe_stem(F.col("title"))
    return _named(books, stem, F.concat(stem, F.lit("_"), F.col("id").cast("string")), "stem")
