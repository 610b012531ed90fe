"""Work queue of pages: an append-only change log, its fold to the current state, and the queue's statements.

A statement is a projection of the current pages; what it returns is what has changed. ``now`` is a
parameter everywhere, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import or_empty
from quire.operators.numbering import numbered

KEY = ["book_id", "page_no"]
CHANGE = "book_id long, page_no int, seq long, kind string, ts double, status string, page_type string, transcription string, footnotes string, note string, input_tokens int, output_tokens int, reason string, error string"
STATE = "struct<status: string, attempts: int, flag_reason: string, last_error: string, claimed_at: double, updated_at: double>"


STATE_FIELDS = ["status", "attempts", "flag_reason", "last_error", "claimed_at", "updated_at"]
EMPTY = '{"status":"pending","attempts":0,"flag_reason":"","last_error":""}'


def stepped(s: Column, c: Column, max_attempts: int) -> Column:
    """A page's state after one change: struct(seq, kind, ts, status, reason, error)."""
    kind = c["kind"]
    failed = s["attempts"] + 1
    status = (
        F.when(kind == "claim", "in_progress")
        .when(kind == "commit", c["status"])
        .when(kind == "fail", F.when(failed >= max_attempts, "failed").otherwise("pending"))
        .when(kind.isin("create", "release", "requeue"), "pending")
        .when((kind == "stale_reset") & (s["status"] == "in_progress"), "pending")
        .otherwise(s["status"])
    )
    commit = kind == "commit"
    return F.struct(
        status.alias("status"),
        F.when(kind == "fail", failed).when(kind == "requeue", 0).otherwise(s["attempts"]).cast("int").alias("attempts"),
        F.when(commit, or_empty(c["reason"])).when(kind == "requeue", "").otherwise(s["flag_reason"]).alias("flag_reason"),
        F.when(commit | (kind == "requeue"), "").when(kind == "fail", F.left(or_empty(c["error"]), F.lit(fixed.LAST_ERROR))).otherwise(s["last_error"]).alias("last_error"),
        F.when(kind == "claim", c["ts"]).when(kind == "create", s["claimed_at"]).alias("claimed_at"),
        c["ts"].alias("updated_at"),
    ).cast(STATE)


def logs(changes: DataFrame) -> tuple[Column, Column]:
    """Aggregates of a page's changes: without texts in order of ``seq``, and the number of the last commit."""
    short = F.left("error", F.lit(fixed.LAST_ERROR)).alias("error")
    return F.array_sort(F.collect_list(F.struct("seq", "kind", "ts", "status", "reason", short))), F.max(F.when(F.col("kind") == "commit", F.col("seq")))


def fold(changes: DataFrame, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """The current pages: each page's few changes in order of ``seq``, whatever order the log is in. Texts are those of
    the last commit, chosen without collecting the others'."""
    log, _ = logs(changes)
    commit = F.when(F.col("kind") == "commit", F.col("seq"))
    result = F.max_by(F.struct("page_type", "transcription", "footnotes", "note", "input_tokens", "output_tokens"), commit)
    folded = changes.groupBy(*KEY).agg(F.aggregate(log, F.from_json(F.lit(EMPTY), STATE), lambda s, c: stepped(s, c, max_attempts)).alias("s"), result.alias("r"))
    return folded.select(*KEY, "s.status", "s.attempts", *texts_of("r"), "s.flag_reason", "s.last_error", "s.claimed_at", "s.updated_at")


def texts_of(result: str) -> list[Column]:
    """What a result holds, with the defaults of a page without one."""
    text = lambda name: F.when(F.col(result).isNotNull(), or_empty(F.col(f"{result}.{name}"))).alias(name)
    count = lambda name: F.coalesce(f"{result}.{name}", F.lit(0)).alias(name)
    return [F.col(f"{result}.page_type"), text("transcription"), text("footnotes"), text("note"), count("input_tokens"), count("output_tokens")]


def fold_onto(pages: DataFrame, changes: DataFrame, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """``pages`` (the states of a snapshot) after later changes, without texts; ``committed`` is the number of the change that
    holds a page's text. Changes of pages that the snapshot lacks begin them. Equal to the fold of all changes."""
    log, last = logs(changes)
    later = changes.groupBy(*KEY).agg(log.alias("__log"), last.alias("__last"))
    begun = F.when(F.col("status").isNotNull(), F.struct(*STATE_FIELDS).cast(STATE)).otherwise(F.from_json(F.lit(EMPTY), STATE))
    s = F.aggregate(F.coalesce("__log", F.array().cast("array<struct<seq: bigint, kind: string, ts: double, status: string, reason: string, error: string>>")), begun, lambda s, c: stepped(s, c, max_attempts))
    rest = [c for c in pages.columns if c not in (*KEY, *STATE_FIELDS, "committed")]
    return pages.join(later, KEY, "full").withColumn("__s", s).select(*KEY, *[F.col(f"__s.{c}").alias(c) for c in STATE_FIELDS], F.coalesce("__last", "committed").alias("committed"), *rest)


def with_texts(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """States with the text that they name, as ``fold`` returns them."""
    texts = changes.filter("kind = 'commit'").select(*KEY, F.col("seq").alias("committed"), F.struct("page_type", "transcription", "footnotes", "note", "input_tokens", "output_tokens").alias("r"))
    return pages.join(texts, [*KEY, "committed"], "left").select(*KEY, "status", "attempts", *texts_of("r"), "flag_reason", "last_error", "claimed_at", "updated_at")


def claim_batch(pages: DataFrame, books: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The next ``n`` pending pages with their book, in queue order."""
    waiting = pages.filter(F.col("status") == "pending")
    return waiting.join(books, waiting["book_id"] == books["id"]).drop("id").orderBy(*(order or KEY)).limit(n)


def claimed(pages: DataFrame, now: float) -> DataFrame:
    return pages.withColumns({"status": F.lit("in_progress"), "claimed_at": F.lit(now), "updated_at": F.lit(now)})


def release(pages: DataFrame, keys: DataFrame, now: float) -> DataFrame:
    """Claims given back; attempts don't change."""
    return pages.join(keys, KEY, "left_semi").withColumns({"status": F.lit("pending"), "claimed_at": F.lit(None).cast("double"), "updated_at": F.lit(now)})


def fail(pages: DataFrame, errors: DataFrame, now: float, max_attempts: int = fixed.MAX_ATTEMPTS) -> DataFrame:
    """``errors``: book_id, page_no, error, one each. A page is tried until its attempts reach the maximum."""
    attempts = F.col("attempts") + 1
    joined = pages.drop("last_error").join(errors, KEY)
    return joined.withColumns({"attempts": attempts, "status": escalated(attempts, max_attempts), "last_error": F.left(or_empty(F.col("error")), F.lit(fixed.LAST_ERROR)), "claimed_at": F.lit(None).cast("double"), "updated_at": F.lit(now)}).drop("error")


def escalated(attempts: Column, max_attempts: int | Column = fixed.MAX_ATTEMPTS) -> Column:
    return F.when(attempts >= max_attempts, "failed").otherwise("pending")


def requeue(pages: DataFrame, statuses: list[str], book_id: int | None = None, now: float = 0.0) -> DataFrame:
    """Pages of these statuses, pending again with their errors cleared and their text kept. No statuses: no pages."""
    chosen = pages.filter(F.col("status").isin(*statuses) if statuses else F.lit(False))
    chosen = chosen if book_id is None else chosen.filter(F.col("book_id") == book_id)
    return chosen.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "last_error": F.lit(""), "flag_reason": F.lit(""), "claimed_at": F.lit(None).cast("double"), "updated_at": F.lit(now)})


def reset_stale(pages: DataFrame, now: float = 0.0) -> DataFrame:
    return pages.filter(F.col("status") == "in_progress").withColumns({"status": F.lit("pending"), "claimed_at": F.lit(None).cast("double"), "updated_at": F.lit(now)})


def queue_summary(pages: DataFrame) -> DataFrame:
    """status, n: every known status, unknown ones that occur, and the total."""
    known = pages.sparkSession.createDataFrame([(s,) for s in fixed.PAGE_STATUSES], "status string")
    counts = pages.groupBy("status").agg(F.count("*").alias("n"))
    every = counts.join(known, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return every.union(every.agg(F.lit("total"), F.coalesce(F.sum("n"), F.lit(0))))


def book_rollup(books: DataFrame, pages: DataFrame, statuses: tuple[str, ...] = ("done", "flagged", "failed", "pending")) -> DataFrame:
    """books with ``pages`` and a count for each status; books without pages count 0. Pages are counted before the
    join, so it moves a row a book."""
    counts = pages.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("pages"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    return books.join(counts, "id", "left").na.fill(0, ["pages", *statuses])


def register_books(books: DataFrame, scanned: DataFrame, now: float) -> DataFrame:
    """All books after a scan, with ``created``. A known rel_path keeps id, title, profile and created_at; new ones get
    the next ids in order of rel_path."""
    meta = ["file_name", "fingerprint", "file_size", "total_pages"]
    fresh = scanned.select("rel_path", "title", *[F.col(c).alias(f"new_{c}") for c in meta])
    known = books.join(fresh.drop("title"), "rel_path", "left").select(
        "id", "rel_path", *[F.coalesce(f"new_{c}", c).alias(c) for c in meta], "title", "profile_json", "created_at", F.when(F.col("new_file_name").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"), F.lit(False).alias("created")
    )
    top = books.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = numbered(fresh.join(books.select("rel_path"), "rel_path", "left_anti"), "rel_path", "id", top).select(
        "id", "rel_path", *[F.col(f"new_{c}").alias(c) for c in meta], "title", F.lit(None).cast("string").alias("profile_json"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), F.lit(True).alias("created")
    )
    return known.unionByName(added)


def new_pages(books: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages 1..total_pages that aren't there yet; none is ever removed."""
    wanted = books.filter("total_pages > 0").select(F.col("id").alias("book_id"), F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_no"))
    return wanted.join(pages.select(*KEY), KEY, "left_anti").withColumn("status", F.lit("pending"))


def without_book(books: DataFrame, pages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``gone``: id. Both tables without these books; pages go with their book."""
    return books.join(gone, "id", "left_anti"), pages.join(gone.withColumnRenamed("id", "book_id"), "book_id", "left_anti")


def with_profiles(books: DataFrame, profiles: DataFrame) -> DataFrame:
    """``profiles``: id, profile_json, one each."""
    return books.withColumnRenamed("profile_json", "old").join(profiles, "id", "left").withColumn("profile_json", F.coalesce("profile_json", "old")).drop("old")
