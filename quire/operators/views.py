"""Read-only views: listings, details, the status in one row, sheets read back, and progress of a stream."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quire.functions import fixed
from quire.operators import keys as K
from quire.operators.export import have
from quire.operators.queue import book_rollup

#: What a book's detail shows of each page.
PAGE_FIELDS = ("page_no", "status", "page_type", "printed_page_number", "transcription", "footnotes", "note", "flag_reason", "last_error", "attempts", "key_label", "model", "render_dpi", "media_resolution", "input_tokens", "output_tokens", "latency_ms")


def book_listing(books: DataFrame, pages: DataFrame) -> DataFrame:
    """id, title, rel_path, total_pages, pages_done, _pending, _flagged, _failed, profiled, by path."""
    rolled = book_rollup(books, pages)
    counts = [F.col(s).alias(f"pages_{s}") for s in ("done", "pending", "flagged", "failed")]
    return rolled.select("id", "title", have(rolled, "rel_path").alias("rel_path"), have(rolled, "total_pages", F.lit(0)).alias("total_pages"), *counts, F.coalesce(have(rolled, "profile_json") != "", F.lit(False)).alias("profiled")).orderBy("rel_path", "id")


def book_detail(books: DataFrame, pages: DataFrame, book_id: int) -> DataFrame:
    """One row: the book with its pages, in order, as an array; no row if there is no such book."""
    one = books.filter(F.col("id") == book_id)
    own = pages.filter(F.col("book_id") == book_id)
    item = F.struct(*[have(own, c).alias(c) for c in PAGE_FIELDS])
    nested = own.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(item), lambda a, b: (a["page_no"] - b["page_no"]).cast("int")).alias("pages"))
    return one.join(nested, "id", "left")


def status(pages: DataFrame, keys: DataFrame) -> DataFrame:
    """One row: the queue's counts, the keys' capacity, what a day allows and the days that are left (null if a day
    allows nothing)."""
    counts = pages.agg(*[F.count_if(F.col("status") == s).alias(s) for s in fixed.PAGE_STATUSES], F.count("*").alias("total"))
    daily = keys.filter(F.col("state") != "dead").agg(F.coalesce(F.sum("rpd_limit"), F.lit(0)).alias("daily"))
    joined = counts.crossJoin(K.capacity(keys)).crossJoin(daily)  # one row each
    return joined.withColumn("days_remaining", F.when(F.col("daily") > 0, F.bround(F.col("pending") / F.col("daily"), 1)))


def config_rows(spark: SparkSession, settings: dict[str, object]) -> DataFrame:
    """key, value of the settings that a run uses."""
    return spark.createDataFrame([(k, None if v is None else str(v)) for k, v in sorted(settings.items())], "key string, value string")


def sheet_status(rows: DataFrame) -> DataFrame:
    """Which pages of published rows (book_id, page_no, cells) have text."""
    return rows.filter(F.col("page_no").isNotNull()).select("book_id", "page_no", (F.length(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))) > 0).alias("has_text"))


def setting(settings: DataFrame, key: str) -> DataFrame:
    """value of one setting; no row if there is none. The key is pushed down to the files."""
    return settings.filter(F.col("key") == key).select("value")


def book_profile(books: DataFrame, book_id: int) -> DataFrame:
    """One row for a book that there is: profile_json (null: not profiled yet) and whether it was profiled."""
    return books.filter(F.col("id") == book_id).select("id", "profile_json", F.coalesce(F.col("profile_json") != "", F.lit(False)).alias("profiled"))


class Progress(StreamingQueryListener):
    """Counts of a running query, for a snapshot from any thread."""

    def __init__(self) -> None:
        self.lock, self.state, self.batches, self.rows, self.error = threading.Lock(), "idle", 0, 0, ""

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.state, self.batches, self.rows, self.error = "running", 0, 0, ""

    def onQueryProgress(self, event) -> None:
        with self.lock:
            self.batches += 1
            self.rows += event.progress.numInputRows or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.state, self.error = ("failed", event.exception) if event.exception else ("done", "")

    def snapshot(self) -> dict:
        with self.lock:
            return {"state": self.state, "batches": self.batches, "rows": self.rows, "error": self.error}
