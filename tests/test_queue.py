"""Queue: changes fold to the current state; statements return what they change."""

import random

from pyspark.sql import functions as F

from quire.operators import legacy, log, queue

FIELDS = [f.split(" ") for f in queue.CHANGE.split(", ")]


def changes(spark, *rows):
    names = [n for n, _ in FIELDS]
    return spark.createDataFrame([tuple({"book_id": 1, "page_no": 1, "ts": 1.0, **r}.get(n) for n in names) for r in rows], queue.CHANGE)


def log_of(*kinds, page=1):
    return [{"seq": i + 1, "kind": k[0] if isinstance(k, tuple) else k, "page_no": page, **(k[1] if isinstance(k, tuple) else {})} for i, k in enumerate(kinds)]


def state(spark, rows, **kw):
    return queue.fold(changes(spark, *rows), **kw).first()


def test_failures_escalate_and_requeue(spark):
    fail = ("fail", {"error": "x" * 2000})
    assert state(spark, log_of("create", "claim", fail)).status == "pending"
    s = state(spark, log_of("create", *["claim", fail] * 3))
    assert (s.status, s.attempts, len(s.last_error), s.claimed_at) == ("failed", 3, 1000, None)
    s = state(spark, log_of("create", *["claim", fail] * 3, "requeue"))
    assert (s.status, s.attempts, s.last_error) == ("pending", 0, "")


def test_release_keeps_attempts(spark):
    s = state(spark, log_of("create", *["claim", "release"] * 10))
    assert (s.status, s.attempts) == ("pending", 0)


def test_requeue_keeps_text_and_tokens(spark):
    commit = ("commit", {"status": "flagged", "transcription": "Hello", "input_tokens": 5, "reason": "short"})
    s = state(spark, log_of("create", "claim", commit, "requeue"))
    assert (s.status, s.transcription, s.input_tokens, s.flag_reason) == ("pending", "Hello", 5, "")


def test_stale_claims(spark):
    rows = [r for p in range(1, 6) for r in log_of("create", *(["claim"] if p <= 3 else []), page=p)]
    pages = queue.fold(changes(spark, *rows))
    assert pages.filter("status = 'in_progress'").count() == 3
    assert queue.reset_stale(pages).count() == 3
    again = [*rows, *({"seq": 9, "kind": "stale_reset", "page_no": p} for p in range(1, 6))]
    assert {(r.status, r.n) for r in queue.queue_summary(queue.fold(changes(spark, *again))).collect()} >= {("pending", 5), ("in_progress", 0), ("total", 5)}


def test_fold_ignores_the_order_of_the_log(spark):
    rows = [r for p in range(1, 8) for r in log_of("create", "claim", ("fail", {"error": "e"}), "claim", ("commit", {"status": "done", "transcription": f"t{p}"}), page=p)]
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    assert sorted(queue.fold(changes(spark, *rows)).collect()) == sorted(queue.fold(changes(spark, *shuffled)).collect())


def test_claims_are_distinct_and_in_order(spark):
    pages = spark.range(50).select(F.lit(1).cast("long").alias("book_id"), F.col("id").cast("int").alias("page_no"), F.lit("pending").alias("status"))
    books = spark.createDataFrame([(1, "b")], "id long, title string")
    taken = queue.claim_batch(pages, books, 20).collect()
    assert [r.page_no for r in taken] == list(range(20))
    rest = pages.join(spark.createDataFrame([(r.page_no,) for r in taken], "page_no int"), "page_no", "left_anti")
    assert not {r.page_no for r in queue.claim_batch(rest, books, 50).collect()} & {r.page_no for r in taken}


def test_statements_with_empty_inputs(spark):
    pages = spark.createDataFrame([(1, 1, "done"), (1, 2, "flagged")], "book_id long, page_no int, status string")
    assert queue.requeue(pages, []).count() == 0
    assert [r.page_no for r in queue.requeue(pages, ["flagged"], book_id=1).collect()] == [2]
    assert queue.requeue(pages, ["flagged"], book_id=2).count() == 0
    assert {(r.status, r.n) for r in queue.queue_summary(pages.limit(0)).collect()} == {(s, 0) for s in ("pending", "in_progress", "done", "flagged", "failed", "total")}
    books = spark.createDataFrame([(1, "a"), (2, "none")], "id long, title string")
    got = {r.id: r for r in queue.book_rollup(books, pages).collect()}
    assert (got[1].pages, got[1].done, got[2].pages, got[2].done) == (2, 1, 0, 0)


BOOK = "id long, rel_path string, file_name string, fingerprint string, file_size long, total_pages int, title string, profile_json string, created_at double, updated_at double"


def test_rescan_is_idempotent_and_books_grow(spark):
    none = spark.createDataFrame([], BOOK)
    scanned = lambda n: spark.createDataFrame([("a/b.pdf", "b.pdf", "quick:x", 1000, n, "b"), ("a/c.pdf", "c.pdf", "quick:y", 1, 2, "c")], "rel_path string, file_name string, fingerprint string, file_size long, total_pages int, title string")
    first = queue.register_books(none, scanned(10), 1.0)
    assert [(r.id, r.rel_path, r.created) for r in first.orderBy("id").collect()] == [(1, "a/b.pdf", True), (2, "a/c.pdf", True)]
    kept = first.drop("created").withColumn("title", F.concat(F.lit("my "), "title"))
    again = queue.register_books(kept, scanned(14), 2.0)
    assert [(r.id, r.title, r.total_pages, r.created, r.created_at, r.updated_at) for r in again.orderBy("id").collect()][0] == (1, "my b", 14, False, 1.0, 2.0)
    pages = queue.new_pages(kept, spark.createDataFrame([], "book_id long, page_no int"))
    assert pages.count() == 12
    assert queue.new_pages(kept, pages).count() == 0
    assert queue.new_pages(again, pages).count() == 4
    left, own = queue.without_book(kept, pages, spark.createDataFrame([(1,)], "id long"))
    assert left.count() == 1 and own.count() == 2


def test_log(spark):
    events = spark.createDataFrame([(i, "m") for i in range(1, 11)], "id long, message string")
    assert [r.id for r in log.tail(events, 0, 3).collect()] == [8, 9, 10]
    assert log.tail(events, 10).count() == 0
    assert log.tail(events, 0, 0).count() == 1
    kept, dropped = log.trim(events, 4)
    assert sorted(r.id for r in kept.collect()) == [7, 8, 9, 10] and dropped.count() == 6
    assert log.trim(events, 100)[1].count() == 0 and log.trim(events.limit(0), 5)[0].count() == 0
    s = spark.createDataFrame([("url", "a", 1.0, 1), ("url", "b", 2.0, 2), ("secret", "s", 1.0, 3), ("secret", " ", 2.0, 4)], "key string, value string, updated_at double, seq long")
    assert {r.key: r.value for r in log.latest_settings(s, ("secret",)).collect()} == {"url": "b", "secret": "s"}
    assert log.migrated(events, {"enabled": ("boolean", True)}).first().enabled is True


def test_legacy_plan(spark):
    backup = spark.createDataFrame(
        [(1, 1, "synced", "text", "hello"), (1, 2, "synced", "text", " "), (1, 3, "error", None, ""), (1, 4, "synced", "text", "x"), (1, 99, "synced", "text", "x"), (1, 5, "transcribed_unsynced", "blank", "")],
        "book_id long, n int, status string, page_type string, text string",
    ).withColumn("note", F.lit("could not be read"))
    pages = spark.createDataFrame([(1, k, "done" if k == 4 else "pending") for k in range(1, 6)], "book_id long, page_no int, status string")
    got = {r.n: (r.outcome, r.flag_reason) for r in legacy.plan(backup, pages).collect()}
    assert {n: o for n, (o, _) in got.items()} == {1: "done", 2: "flagged", 3: "left pending", 4: "already done here", 5: "done", 99: "not present"}
    assert got[2][1] and not got[1][1]
    assert legacy.suspicious(backup, "could not be read").count() == 0 and legacy.suspicious(backup, "revoked").count() == 1
    books = spark.createDataFrame([(1, "a/x.pdf", "x.pdf"), (2, "b/x.pdf", "x.pdf"), (3, "c/y.pdf", "y.pdf")], "id long, rel_path string, file_name string")
    old = spark.createDataFrame([("A", "x.pdf", "a/x.pdf"), ("B", "x.pdf", "moved/x.pdf"), ("C", "z.pdf", "z.pdf")], "name string, file_name string, rel_path string")
    assert {r.name: r.book_id for r in legacy.match_books(old, books).collect()} == {"A": 1, "B": 2, "C": None}
