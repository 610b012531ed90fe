"""Sample pages of a book: the first text pages among the first inspected ones, with one fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fixed


def select_text_pages(pages: DataFrame, count: int = fixed.SAMPLES, start_after: int = fixed.FRONT_PAGES, scan_limit: int = fixed.SCAN_LIMIT) -> DataFrame:
    """``pages``: book_id, page_no, is_text (null where the page can't be read; it is still inspected). Returns book_id,
    pages (ascending), strategy. Only the first pages of each of the two ranges reach the second window."""
    book, order = W.partitionBy("book_id"), W.partitionBy("book_id").orderBy("page_no")
    ranked = pages.select("book_id", "page_no", "is_text", F.row_number().over(order).alias("from_start"), F.when(F.col("page_no") > start_after, F.row_number().over(W.partitionBy("book_id", F.col("page_no") > start_after).orderBy("page_no"))).alias("from_body"))
    seen = ranked.filter((F.col("from_start") <= scan_limit) | (F.col("from_body") <= scan_limit))
    text = F.coalesce("is_text", F.lit(False))
    seen = seen.withColumns({"body": text & F.coalesce(F.col("from_body") <= scan_limit, F.lit(False)), "any": text & (F.col("from_start") <= scan_limit)})
    seen = seen.withColumn("has_body", F.max("body").over(book)).withColumn("hit", F.when(F.col("has_body"), F.col("body")).otherwise(F.col("any")))
    per = seen.groupBy("book_id").agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("page_no")))), 1, count).alias("pages"), F.max("has_body").alias("has_body"))
    a, b, c = fixed.STRATEGIES
    return per.select("book_id", "pages", F.when(F.col("has_body"), a).when(F.size("pages") > 0, b).otherwise(c).alias("strategy"))
