"""Import of an earlier application's backups: match, plan, report; writing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import or_empty, strip


def match_books(backup: DataFrame, books: DataFrame) -> DataFrame:
    """``backup``: name, file_name, rel_path. Adds book_id (null if unmatched): by path, else by file name, where of
    several books with the name the last by path counts."""
    by_path = books.select(F.col("rel_path").alias("__path"), F.col("id").alias("__by_path"))
    by_name = books.groupBy(F.col("file_name").alias("__name")).agg(F.max_by("id", "rel_path").alias("__by_name"))
    out = backup.join(by_path, F.col("rel_path") == F.col("__path"), "left").join(by_name, backup["file_name"] == F.col("__name"), "left")
    return out.withColumn("book_id", F.coalesce("__by_path", "__by_name")).drop("__path", "__by_path", "__name", "__by_name")


def new_status(status: Column, page_type: Column, text: Column) -> tuple[Column, Column]:
    """(status, flag_reason) of a page of the earlier application."""
    carried = status.isin(*fixed.LEGACY_DONE)
    empty = carried & (or_empty(page_type) == "text") & (strip(or_empty(text)) == "")
    return F.when(empty, "flagged").when(carried, "done").otherwise("pending"), F.when(empty, fixed.LEGACY_EMPTY).otherwise("")


def plan(backup_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """``backup_pages``: book_id, n, status, page_type, text, note; ``pages``: book_id, page_no, status. Adds outcome (not
    present, already done here, left pending, done, flagged) and flag_reason. Finished pages are never
    overwritten; only done and flagged are to be written."""
    have = pages.select("book_id", F.col("page_no").alias("n"), F.col("status").alias("__now"))
    status, reason = new_status(F.col("status"), F.col("page_type"), F.col("text"))
    joined = backup_pages.join(have, ["book_id", "n"], "left")
    outcome = F.when(F.col("__now").isNull(), "not present").when(F.col("__now").isin(*fixed.FINISHED), "already done here").when(status == "pending", "left pending").otherwise(status)
    return joined.withColumn("outcome", outcome).withColumn("flag_reason", F.when(F.col("outcome") == "flagged", reason).otherwise("")).drop("__now")


def report(planned: DataFrame) -> DataFrame:
    """Counts per book and outcome; book_id null is the total."""
    return planned.rollup("book_id", "outcome").agg(F.count("*").alias("n"), F.grouping("outcome").alias("g")).filter("g = 0").select("book_id", "outcome", "n").union(planned.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(None).cast("long"), "outcome", "n"))


def suspicious(backup_pages: DataFrame, marker: str) -> DataFrame:
    """Failed pages whose note doesn't say what failures are expected to say."""
    return backup_pages.filter((F.col("status") == "error") & ~or_empty(F.col("note")).contains(marker))
