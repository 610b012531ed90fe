"""Queries of the page queue, registration, the log and imports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import fixed
from quire.operators import legacy, log, queue, views
from quire.plans.roles import books, documents, keys, pages, table, with_roles

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(with_roles("SELECT id, title, CAST(count(page_no) AS BIGINT) AS pages, CAST(count(*) FILTER (status = 'done') AS BIGINT) AS done, CAST(count(*) FILTER (status = 'flagged') AS BIGINT) AS flagged, CAST(count(*) FILTER (status = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending FROM books LEFT JOIN pages ON id = book_id GROUP BY id, title", "books", "pages"))
def book_rollup(spark, sf_dir):
    return queue.book_rollup(books(spark, sf_dir), pages(spark, sf_dir)).orderBy("id")


@query(with_roles("SELECT s AS status, CAST(count(status) AS BIGINT) AS n FROM (SELECT unnest(['pending', 'in_progress', 'done', 'flagged', 'failed']) AS s) LEFT JOIN pages ON s = status GROUP BY s UNION ALL SELECT 'total', count(*) FROM pages", "pages"))
def queue_summary(spark, sf_dir):
    return queue.queue_summary(pages(spark, sf_dir))


@query(with_roles("SELECT book_id, page_no, title FROM pages JOIN books ON id = book_id WHERE status = 'pending' ORDER BY book_id, page_no LIMIT 100", "books", "pages"))
def claim_batch(spark, sf_dir):
    return queue.claim_batch(pages(spark, sf_dir), books(spark, sf_dir), 100).select("book_id", "page_no", "title")


@query(with_roles("SELECT book_id, page_no, 'pending' AS status, 0 AS attempts, '' AS last_error, '' AS flag_reason FROM pages WHERE status IN ('flagged', 'failed')", "pages"))
def requeue_pages(spark, sf_dir):
    return queue.requeue(pages(spark, sf_dir), ["flagged", "failed"]).select("book_id", "page_no", "status", "attempts", "last_error", "flag_reason")


@query(with_roles("SELECT book_id, page_no, 'pending' AS status, attempts FROM pages WHERE status = 'pending'", "pages"))
def stale_reset(spark, sf_dir):
    """All pending pages are claimed first, as by a run that then stopped."""
    waiting = pages(spark, sf_dir).filter("status = 'pending'")
    return queue.reset_stale(queue.claimed(waiting, 5.0), 6.0).select("book_id", "page_no", "status", "attempts")


@query(with_roles("SELECT book_id, page_no, 'pending' AS status, attempts FROM pages WHERE status = 'flagged'", "pages"))
def release_pages(spark, sf_dir):
    p = pages(spark, sf_dir)
    return queue.release(p, p.filter("status = 'flagged'").select("book_id", "page_no"), 2.0).select("book_id", "page_no", "status", "attempts")


@query(with_roles("SELECT book_id, page_no, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END AS status, 'render error' AS last_error FROM pages WHERE status = 'pending'", "pages"))
def failure_escalation(spark, sf_dir):
    p = pages(spark, sf_dir).filter("status = 'pending'")
    return queue.fail(p, p.select("book_id", "page_no", F.lit("render error").alias("error")), 3.0).select("book_id", "page_no", "attempts", "status", "last_error")


CHANGE_LOG_SQL = (
    """WITH e AS (SELECT user_id AS book_id, ts, event_id, event_type AS k FROM events),
    r AS (SELECT *, sum(CASE WHEN k = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY book_id ORDER BY ts, event_id) AS epoch FROM e),
    a AS (SELECT book_id, arg_max(k, (ts, event_id)) AS last, arg_max(event_id, (ts, event_id)) FILTER (k = 'purchase') AS text, floor(epoch(max(ts))) AS updated_at, count(*) FILTER (k = 'error' AND epoch = top) AS attempts,
      arg_max(CASE k WHEN 'error' THEN 'err ' || event_id ELSE '' END, (ts, event_id)) FILTER (k IN ('purchase', 'error', 'signup')) AS last_error, arg_max(CASE k WHEN 'purchase' THEN 'why ' || event_id ELSE '' END, (ts, event_id)) FILTER (k IN ('purchase', 'signup')) AS flag_reason
      FROM (SELECT *, max(epoch) OVER (PARTITION BY book_id) AS top FROM r) GROUP BY book_id)
    SELECT book_id, CAST(attempts AS INTEGER) AS attempts, CASE last WHEN 'purchase' THEN 'done' WHEN 'view' THEN 'in_progress' WHEN 'error' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END ELSE 'pending' END AS status,
      CAST(text AS VARCHAR) AS transcription, coalesce(flag_reason, '') AS flag_reason, coalesce(last_error, '') AS last_error, CASE last WHEN 'view' THEN updated_at END AS claimed_at, updated_at FROM a"""
)


def events_as_changes(spark, sf_dir):
    """Events as changes of one page a user: purchase commits, view claims, click releases, error fails, signup requeues."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for x in ("purchase", "commit", "view", "claim", "click", "release", "error", "fail", "signup", "requeue")])[F.col("event_type")]
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    named = lambda head, c: F.concat(F.lit(head), F.col("event_id").cast("string")).alias(c)
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    at = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    changes = e.select(F.col("user_id").alias("book_id"), F.lit(1).alias("page_no"), seq.alias("seq"), kind.alias("kind"), at.alias("ts"), F.lit("done").alias("status"), none("string", "page_type"), named("", "transcription"), *[none("string", c) for c in ("footnotes", "note")], none("int", "input_tokens"), none("int", "output_tokens"), named("why ", "reason"), named("err ", "error"))
    return changes


@query(CHANGE_LOG_SQL)
def change_log_fold(spark, sf_dir):
    """All changes at once."""
    return queue.fold(events_as_changes(spark, sf_dir)).select("book_id", "attempts", "status", "transcription", "flag_reason", "last_error", "claimed_at", "updated_at")


@query(
    """WITH k AS (SELECT max(c_custkey) AS top FROM customer WHERE c_acctbal >= 0)
    SELECT c_custkey AS id, c_name AS rel_path, false AS created, c_nationkey + 1 AS total_pages, 'old' AS title, 0.0 AS created_at, CASE WHEN c_nationkey > 3 THEN 9.0 ELSE 0.0 END AS updated_at FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT top + row_number() OVER (ORDER BY c_name), c_name, true, c_nationkey + 1, 'new', 9.0, 9.0 FROM customer, k WHERE c_acctbal < 0 AND c_nationkey > 3"""
)
def register_books(spark, sf_dir):
    """Customers with a balance are known; a scan sees those of all nations but the first four."""
    c = table(spark, sf_dir, "customer")
    meta = [F.col("c_name").alias("rel_path"), F.col("c_name").alias("file_name"), F.lit("f").alias("fingerprint"), F.lit(1).cast("long").alias("file_size"), (F.col("c_nationkey") + 1).alias("total_pages")]
    known = c.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"), *meta, F.lit("old").alias("title"), F.lit(None).cast("string").alias("profile_json"), F.lit(0.0).alias("created_at"), F.lit(0.0).alias("updated_at"))
    got = queue.register_books(known, c.filter("c_nationkey > 3").select(*meta, F.lit("new").alias("title")), 9.0)
    return got.select("id", "rel_path", "created", "total_pages", "title", "created_at", "updated_at")


@query(with_roles("SELECT id AS book_id, CAST(p AS INTEGER) AS page_no, 'pending' AS status FROM (SELECT id, unnest(range(1, 4)) AS p FROM books) WHERE NOT EXISTS (SELECT 1 FROM (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS n FROM pages) x WHERE x.book_id = id AND n = p)", "books", "pages"))
def register_pages(spark, sf_dir):
    """Books of three pages, of which each order stands for one that is there."""
    from pyspark.sql import Window as W

    p = pages(spark, sf_dir).select("book_id", F.row_number().over(W.partitionBy("book_id").orderBy("page_no")).alias("page_no"))
    return queue.new_pages(books(spark, sf_dir).withColumn("total_pages", F.lit(3)), p)


@query(with_roles("SELECT book_id, page_no FROM pages WHERE book_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "pages"))
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return queue.without_book(books(spark, sf_dir), pages(spark, sf_dir), gone)[1].select("book_id", "page_no")


@query("SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN '{\"segment\":\"' || c_mktsegment || '\"}' WHEN c_acctbal < 0 THEN 'old' END AS profile_json FROM customer")
def set_profiles(spark, sf_dir):
    """Building customers get a profile; of the others some have one."""
    c = table(spark, sf_dir, "customer")
    known = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "old").alias("profile_json"))
    found = c.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"))).alias("profile_json"))
    return queue.with_profiles(known, found).select("id", "profile_json")


@query("SELECT event_id AS id, event_type AS level FROM events WHERE event_id > 5000 ORDER BY event_id DESC LIMIT 200")
def event_tail(spark, sf_dir):
    return log.tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level")), 5000, 200)


@query("SELECT event_id AS id, event_type AS level FROM events WHERE event_id IN (SELECT event_id FROM events ORDER BY event_id DESC LIMIT 5000)")
def event_trim(spark, sf_dir):
    return log.trim(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level")))[0]


@query("SELECT user_id AS key, arg_max(event_type, (ts, event_id)) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id")
def settings_latest(spark, sf_dir):
    """Events as changes of a user's setting; errors are blank values of secrets and change nothing."""
    e = table(spark, sf_dir, "events")
    changes = e.select(F.lit("secret").alias("key"), F.col("user_id").alias("user"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"), F.lit(0.0).alias("updated_at"), F.struct("ts", "event_id").alias("seq"))
    return log.latest_settings(changes, ("secret",), by=("user",)).select(F.col("user").alias("key"), "value")


@query(
    with_roles(
        """--j AS (SELECT docs.book_id, page_no, CASE WHEN quality IS NULL THEN 'left pending' WHEN toxic = 1 THEN 'already done here' WHEN quality = 0 THEN 'flagged' ELSE 'done' END AS outcome FROM docs LEFT JOIN labels USING (doc_id))
        SELECT book_id, outcome, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY book_id, outcome UNION ALL SELECT -1, outcome, CAST(count(*) AS BIGINT) FROM j GROUP BY outcome""",
        "docs",
    )
)
def legacy_import(spark, sf_dir):
    """Labelled documents as synced backup pages (those of quality 0 without text), toxic ones as already finished here."""
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    backup = d.select("book_id", F.col("page_no").alias("n"), F.when(F.col("quality").isNotNull(), "synced").otherwise("error").alias("status"), F.lit("text").alias("page_type"), F.when(F.col("quality") == 1, "some text").otherwise(" ").alias("text"), F.lit("").alias("note"))
    here = d.select("book_id", "page_no", F.when(F.col("toxic") == 1, "done").otherwise("pending").alias("status"))
    return legacy.report(legacy.plan(backup, here)).na.fill(-1, ["book_id"])


@query(
    """WITH known AS (SELECT doc_id AS id, 'f' || doc_id % 300 AS file_name, CASE quality WHEN 1 THEN 'p/' ELSE 'q/' END || doc_id AS rel_path FROM labels)
    SELECT d.doc_id AS n, coalesce(k.id, m.id) AS book_id FROM documents d LEFT JOIN known k ON k.rel_path = 'p/' || d.doc_id
    LEFT JOIN (SELECT file_name, arg_max(id, rel_path) AS id FROM known GROUP BY file_name) m ON m.file_name = 'f' || d.doc_id % 300"""
)
def legacy_match(spark, sf_dir):
    """Books matched by path where labelled with quality 1, else by a file name that several books share."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    name = F.concat(F.lit("f"), F.col("doc_id") % 300)
    backup = d.select(F.col("doc_id").alias("name"), name.alias("file_name"), F.concat(F.lit("p/"), F.col("doc_id")).alias("rel_path"))
    known = lab.select(F.col("doc_id").alias("id"), name.alias("file_name"), F.concat(F.when(F.col("quality") == 1, "p/").otherwise("q/"), F.col("doc_id")).alias("rel_path"))
    return legacy.match_books(backup, known).select(F.col("name").alias("n"), "book_id")


@query("SELECT c_custkey AS id, c_name AS name, true AS enabled, CAST(250 AS INTEGER) AS rpd_limit FROM customer")
def migrated_columns(spark, sf_dir):
    return log.migrated(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), {"enabled": ("boolean", True), "rpd_limit": ("int", fixed.RPD), "name": ("string", "")})


@query(
    """SELECT c_custkey AS id, c_name AS title, c_name AS rel_path, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS pages_done, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS pages_pending, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS pages_flagged,
    CAST(0 AS BIGINT) AS pages_failed, c_mktsegment <> 'BUILDING' AS profiled FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name, c_mktsegment"""
)
def book_listing(spark, sf_dir):
    """Building customers have an empty profile, the others one."""
    c = table(spark, sf_dir, "customer")
    b = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_name").alias("rel_path"), F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise("{}").alias("profile_json"))
    return views.book_listing(b, pages(spark, sf_dir)).drop("total_pages")


@query(with_roles("SELECT page_no, status, attempts FROM pages WHERE book_id = 7", "pages"))
def book_detail(spark, sf_dir):
    got = views.book_detail(books(spark, sf_dir), pages(spark, sf_dir), 7)
    return got.select(F.explode("pages").alias("p")).select("p.page_no", "p.status", "p.attempts")


@query(
    with_roles(
        """SELECT CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending, CAST(count(*) FILTER (status = 'done') AS BIGINT) AS done, CAST(count(*) FILTER (status = 'flagged') AS BIGINT) AS flagged, CAST(count(*) AS BIGINT) AS total,
        (SELECT CAST(count(*) AS BIGINT) FROM keys) AS keys_total, (SELECT CAST(sum(rpd_limit) AS BIGINT) FROM keys WHERE state <> 'dead') AS daily FROM pages""",
        "pages",
        "keys",
    )
)
def run_status(spark, sf_dir):
    return views.status(pages(spark, sf_dir), keys(spark, sf_dir)).select("pending", "done", "flagged", "total", "keys_total", "daily")
