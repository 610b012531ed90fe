"""Profiles of the books of a run: asked for once a book, before its pages, and kept beside the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.classify import PROFILE, RESPONSE, model_text, profile_fields, unfenced
from quire.functions.once import once
from quire.functions.text import truthy
from quire.sources.buckets import BucketTable

STORED = "book_id long, profile_json string, sample_pages array<int>, strategy string, attempts int, error string"


def profiled(answers: DataFrame, names: list[str]) -> DataFrame:
    """Classified answers to profile calls with ``profile_json``; one without a language is a bad response."""
    body = F.when(F.col("kind").isNull(), F.col("body"))
    a = once(answers.select(*names, F.from_json(body, RESPONSE).alias("response")), __text=unfenced(model_text(F.col("response"))))
    a = once(a, __profile=F.from_json("__text", PROFILE))
    bad = F.col("kind").isNull() & truthy(F.col("__profile.primary_language")).isNull()
    a = a.withColumns({"kind": F.when(bad, "BadResponse").otherwise(F.col("kind")), "message": F.when(bad, "no profile in the answer").otherwise(F.col("message"))})
    return a.select(*names, F.when(F.col("kind").isNull(), F.to_json(profile_fields(F.col("__profile")))).alias("profile_json"))


class Profiles:
    """``samples``: book_id, pages and strategy, as ``select_text_pages`` returns them. A book is settled once it has a profile, has no page
    to take one from (an empty profile), or its calls have failed ``PROFILE_TRIES`` times; its pages wait until then."""

    def __init__(self, spark: SparkSession, folder: str, samples: DataFrame):
        self.spark, self.samples = spark, samples
        self.table = BucketTable(spark, f"{folder.rstrip('/')}/profiles", ["book_id"], 16)

    def stored(self) -> DataFrame:
        return self.table.read() if self.table.commits.head()[1] else self.spark.createDataFrame([], STORED)

    @staticmethod
    def settled() -> Column:
        return F.col("profile_json").isNotNull() | (F.col("attempts") >= fixed.PROFILE_TRIES)

    def candidates(self, pending: DataFrame, near: int, asked: list[int]) -> DataFrame:
        """The pages that may be processed (book_id, page_no, bucket), and a page 0 for each of the next books that a profile is to be asked for.
        ``asked``: books whose call is out. Books without text pages among the next ones are settled at once."""
        next_books = pending.orderBy("book_id", "page_no").limit(near).select("book_id").distinct()
        open_books = next_books.join(self.stored().filter(self.settled()), "book_id", "left_anti").join(self.samples.select("book_id", "pages", "strategy"), "book_id", "left")
        found = open_books.collect()  # ``near`` books at most
        blank = [(r.book_id, "{}", [], r.strategy, 0, None) for r in found if not r.pages]
        if blank:
            self.table.upsert(self.spark.createDataFrame(blank, STORED))
        ask = [(r.book_id, 0, -1) for r in found if r.pages and r.book_id not in asked]
        pages = pending.join(self.stored().filter(self.settled()).select("book_id"), "book_id", "left_semi")
        return pages.unionByName(self.spark.createDataFrame(ask, "book_id long, page_no int, bucket int"))

    def known(self, books: list[int]) -> dict[int, dict]:
        """What calls of these books get: the profile of their pages, or the pages to take one from."""
        profiles = {r.book_id: r.profile_json for r in self.stored().filter(F.col("book_id").isin(books)).collect()}
        return {r.book_id: {"profile": profiles.get(r.book_id), "sample_pages": list(r.pages or [])} for r in self.samples.filter(F.col("book_id").isin(books)).collect()} | {b: {"profile": p, "sample_pages": []} for b, p in profiles.items() if p == "{}"}

    def save(self, answers: DataFrame) -> None:
        """Refusals and rejected keys don't count as tries."""
        rows = answers.join(self.samples.select("book_id", F.col("pages").alias("sample_pages"), "strategy"), "book_id", "left").join(self.stored().select("book_id", F.col("attempts").alias("before")), "book_id", "left")
        tried = F.coalesce("before", F.lit(0)) + F.col("kind").isin("TransientError", "BadResponse").cast("int")
        rows = rows.select("book_id", "profile_json", "sample_pages", "strategy", F.coalesce(tried, F.coalesce("before", F.lit(0))).cast("int").alias("attempts"), F.left("message", F.lit(fixed.LAST_ERROR)).alias("error"))
        self.table.upsert(rows)
