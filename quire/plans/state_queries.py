"""Queries of snapshots, paced leases, bucketed tables, ranges of one key, page images and whole records, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quire.functions import fixed, images
from quire.operators import counted, export, keys as K, queue, views
from quire.plans.key_queries import AVAILABLE, ELIGIBLE, NOW, now_of
from quire.plans.queue_queries import CHANGE_LOG_SQL, events_as_changes
from quire.plans.roles import books, keys, outcomes, pages, table, with_roles
from quire.sources.buckets import BucketTable
from quire.sources.shared import shared_dir, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(CHANGE_LOG_SQL)
def snapshot_fold(spark, sf_dir):
    """The change log in three parts: each is folded onto the snapshot of those before, and texts are looked up at the end."""
    changes = events_as_changes(spark, sf_dir)
    state = spark.createDataFrame([], SNAPSHOT)
    bounds = [0, 3, 9, None]  # numbers of changes of a page
    for a, b in zip(bounds, bounds[1:], strict=False):
        own = changes.filter((F.col("seq") > a) & (F.lit(True) if b is None else F.col("seq") <= b))
        state = written(queue.fold_onto(state, own), "snapshot")
    return queue.with_texts(state, changes).select("book_id", "attempts", "status", "transcription", "flag_reason", "last_error", "claimed_at", "updated_at")


SNAPSHOT = "book_id long, page_no int, status string, attempts int, flag_reason string, last_error string, claimed_at double, updated_at double, committed long"


@query(
    with_roles(
        f"""--w AS (SELECT *, CASE WHEN rpm_limit <= 0 THEN 0.0 ELSE 60.0 / rpm_limit END AS gap, greatest({AVAILABLE}, {NOW}) AS begins FROM (SELECT * FROM keys WHERE {ELIGIBLE} ORDER BY key_id LIMIT 40) WHERE {AVAILABLE} <= {NOW} + 20),
        s AS (SELECT *, begins + turn * gap AS due FROM (SELECT *, unnest(range(0, CAST(least(rpd_limit - used_today, 6, CASE WHEN gap > 0 THEN floor(({NOW} + 20 - begins) / gap) + 1 ELSE 6 END) AS BIGINT))) AS turn FROM w)),
        r AS (SELECT key_id, due, row_number() OVER (ORDER BY due, turn, last_used_at, key_id) AS rank FROM s),
        p AS (SELECT book_id, page_no, row_number() OVER (ORDER BY book_id, page_no) AS rank FROM pages WHERE status = 'pending') SELECT book_id, page_no, key_id, round(due - {NOW}, 3) AS seconds FROM p JOIN r USING (rank)""",
        "pages",
        "keys",
    )
)
def paced_leases(spark, sf_dir):
    """Pages with key and time: 40 keys, the next 20 seconds, at most six calls a key."""
    now = now_of(spark, sf_dir)
    got = K.paced_lease(pages(spark, sf_dir).filter("status = 'pending'").select("book_id", "page_no"), keys(spark, sf_dir), now, 20.0, 40, 6)
    return got.select("book_id", "page_no", "key_id", F.round(F.col("at") - now, 3).alias("seconds"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 97 = 0 THEN 'new' ELSE o_orderpriority END AS v FROM orders UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 97 = 0")
def bucket_upsert(spark, sf_dir):
    """One order in 97 changes and one is added for each: only buckets of these keys are read and written."""
    orders = BucketTable(spark, f"{shared_dir(spark)}/quire-orders-{uuid.uuid4().hex[:12]}", ["k"], 16)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    orders.upsert(rows)
    some = rows.filter(F.col("k") % 97 == 0)
    orders.upsert(some.select("k", F.lit("new").alias("v")).union(some.select(-F.col("k"), F.lit("added"))))
    return orders.read()


@query(with_roles("SELECT id AS book_id, title, CAST(count(page_no) AS BIGINT) AS total_pages, CAST(nullif(count(*) FILTER (status = 'done'), 0) AS BIGINT) AS done, CAST(nullif(count(*) FILTER (status = 'pending'), 0) AS BIGINT) AS pending FROM books LEFT JOIN pages ON id = book_id GROUP BY id, title", "books", "pages"))
def index_lines(spark, sf_dir):
    """The index line by line, each line read back."""
    p = pages(spark, sf_dir)
    b = books(spark, sf_dir).join(p.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("total_pages")), "id", "left").na.fill(0, ["total_pages"])
    lines = export.index_parts(export.manifests(p, b), queue.queue_summary(p)).filter((F.col("place") > -(2**63)) & (F.col("place") < 2**63 - 1))
    line = F.from_json(F.regexp_replace("value", "^,", ""), "book_id long, title string, total_pages long, page_status_counts map<string,long>")
    x = lines.select(line.alias("x"))
    return x.select("x.book_id", "x.title", "x.total_pages", F.col("x.page_status_counts")["done"].alias("done"), F.col("x.page_status_counts")["pending"].alias("pending"))


#: Pixels of a page whose text is drawn as bars: a row of the page a word, as long as the word. Its first pixel is a little lighter, so
#: it is where dark ends; ink is what is darker.
PAGE_ROWS, PAGE_WIDTH = 24, 16


@query(
    f"""WITH w AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS words FROM documents), r AS (SELECT doc_id, unnest(range(1, {PAGE_ROWS + 1})) AS n, words FROM w),
    l AS (SELECT doc_id, CASE WHEN n % 4 = 0 THEN 0 ELSE greatest(0, least({PAGE_WIDTH}, length(coalesce(words[n], ''))) - 1) END AS ink FROM r),
    m AS (SELECT doc_id, sum(ink) / {PAGE_ROWS * PAGE_WIDTH}.0 AS ink, count(*) FILTER (ink / {PAGE_WIDTH}.0 < {fixed.EMPTY_ROW_INK}) / {PAGE_ROWS}.0 AS blank FROM l GROUP BY doc_id)
    SELECT doc_id, CAST(round_even(ink, 5) AS DOUBLE) AS ink_ratio, CAST(round_even(blank, 4) AS DOUBLE) AS empty_row_fraction, NOT (ink < {fixed.BLANK_INK} OR ink > {fixed.HEAVY_INK} OR blank < {fixed.MIN_EMPTY_ROWS} OR blank > {fixed.MAX_EMPTY_ROWS}) AS looks_like_text FROM m"""
)
def page_images(spark, sf_dir):
    """Texts drawn as images, a word a row and every fourth row blank: threshold, ink and empty rows by the page analysis itself."""
    words = F.split(F.coalesce("text", F.lit("")), " ")
    bar = lambda n: F.when(n % 4 == 0, 0).otherwise(F.least(F.lit(PAGE_WIDTH), F.length(F.coalesce(F.get(words, n - 1), F.lit("")))))
    row = lambda n: F.left(F.concat(F.when(bar(n) > 0, "20").otherwise(""), F.repeat(F.lit("10"), F.greatest(F.lit(0), bar(n) - 1)), F.repeat(F.lit("F0"), F.lit(PAGE_WIDTH))), F.lit(2 * PAGE_WIDTH))
    rows = F.transform(F.sequence(F.lit(1), F.lit(PAGE_ROWS)), row)
    p = table(spark, sf_dir, "documents").select("doc_id", F.unhex(F.array_join(rows, "")).alias("pixels"))
    return p.withColumn("s", images.page_stats("pixels", F.lit(PAGE_ROWS), F.lit(PAGE_WIDTH))).select("doc_id", "s.ink_ratio", "s.empty_row_fraction", "s.looks_like_text")


@query(
    """SELECT o_orderkey AS page_no, o_custkey AS book_id, 'm' || o_custkey % 5 AS model, o_orderstatus AS machine_id, CAST(300 AS INTEGER) AS render_dpi, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS key_label, CAST(o_orderkey % 50 AS BIGINT) AS input_tokens, CAST(NULL AS VARCHAR) AS image_format,
    ['la', lower(left(o_orderpriority, 1))] AS languages, o_orderstatus = 'F' AS has_uncertain_text, '' AS footnotes, CASE WHEN o_orderstatus = 'P' THEN 'late' ELSE '' END AS flag_reason, c_name AS title, c_mktsegment AS rel_path FROM orders JOIN customer ON c_custkey = o_custkey"""
)
def export_provenance(spark, sf_dir):
    """All parts of the exported record, written as JSON and read back: the book's block, lists, defaults and provenance."""
    o = table(spark, sf_dir, "orders")
    late = F.when(F.col("o_orderstatus") == "P", "late")
    p = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("page_no"), F.lit("done").alias("status"), F.lit("text").alias("page_type"), F.lit("x").alias("transcription"), F.array(F.lit("la"), F.lower(F.left("o_orderpriority", F.lit(1)))).alias("languages"), (F.col("o_orderstatus") == "F").alias("has_uncertain_text"), late.alias("flag_reason"), F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model"), F.col("o_orderstatus").alias("machine_id"), F.lit(300).alias("render_dpi"), F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("key_label"), (F.col("o_orderkey") % 50).alias("input_tokens"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("rel_path"))
    text = export.json_lines(export.records(p, b))
    shape = "struct<book: struct<id: long, title: string, rel_path: string>, pdf_page_number: long, languages: array<string>, has_uncertain_text: boolean, footnotes: string, flag_reason: string, provenance: struct<model: string, machine_id: string, render_dpi: int, key_label: string, input_tokens: long, image_format: string>>"
    x = text.select(F.from_json("value", shape).alias("x"))
    return x.select(F.col("x.pdf_page_number").alias("page_no"), F.col("x.book.id").alias("book_id"), "x.provenance.model", "x.provenance.machine_id", "x.provenance.render_dpi", "x.provenance.key_label", "x.provenance.input_tokens", "x.provenance.image_format", "x.languages", "x.has_uncertain_text", "x.footnotes", "x.flag_reason", "x.book.title", "x.book.rel_path")


@query(with_roles("--i AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY key_id ORDER BY seq) AS island FROM outcomes) SELECT key_id, seq, CAST(sum(CASE WHEN outcome = 'rate_limited' THEN 1 ELSE 0 END) OVER (PARTITION BY key_id, island ORDER BY seq) AS BIGINT) AS run FROM i", "outcomes"))
def refusals_by_ranges(spark, sf_dir):
    """Refusals since the last success, for keys of any size."""
    return K.refusals_by_ranges(outcomes(spark, sf_dir).select("key_id", "seq", "outcome")).select("key_id", "seq", "run")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) ORDER BY ts, event_id) AS BIGINT) AS used_so_far FROM events")
def used_by_ranges(spark, sf_dir):
    """The day's count so far, for keys of any size."""
    return K.used_by_ranges(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id").select("event_id", "used_so_far")


@query("SELECT 'profile' AS what, CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS value FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'setting', p_name, p_type FROM part WHERE p_partkey = (SELECT max(p_partkey) FROM part)")
def point_lookups(spark, sf_dir):
    """A book's profile and a setting by their keys; a key that isn't there has no row."""
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("profile_json"))
    last = table(spark, sf_dir, "part").orderBy(F.desc("p_partkey")).select("p_name").first()[0]
    s = table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), F.col("p_type").alias("value"), "p_partkey")
    top = s.filter(F.col("p_partkey") == s.agg(F.max("p_partkey")).first()[0])
    profile = views.book_profile(b, 7).select(F.lit("profile").alias("what"), F.col("id").cast("string").alias("key"), F.col("profile_json").alias("value"))
    return profile.union(views.setting(top, last).select(F.lit("setting"), F.lit(last), "value")).union(views.setting(s, "no such key").select(F.lit("setting"), F.lit(""), "value"))


@query(with_roles("SELECT CAST(count(*) AS BIGINT) AS changed, CAST(count(*) FILTER (attempts > 0) AS BIGINT) AS tried FROM pages WHERE status IN ('flagged', 'failed')", "pages"))
def requeue_counts(spark, sf_dir):
    """How many pages a requeue has changed, seen while they are written."""
    p = pages(spark, sf_dir).withColumn("tries", F.col("attempts"))
    rows, seen = counted.counted(queue.requeue(p, ["flagged", "failed"]), tried=F.col("tries") > 0)
    written(rows, "requeued")
    return spark.createDataFrame([(seen.get["rows"], seen.get["tried"])], "changed long, tried long")


_NEW = "(w.day IS NULL OR w.day <> o.d)"
_USED, _RUNS = f"(CASE WHEN {_NEW} THEN 0 ELSE w.used END)", f"((CASE WHEN {_NEW} THEN 0 ELSE w.refusals END) + 1)"
_SPENT = f"(o.daily OR {_USED} >= w.lim OR {_RUNS} >= 4)"
_ROLLED = f"(CASE WHEN {_NEW} AND w.state = 'exhausted' THEN 'active' ELSE w.state END)"
_ERR = f"(CASE WHEN {_NEW} AND w.state = 'exhausted' THEN '' ELSE w.err END)"
_DEAD = "(w.state = 'dead' AND o.kind NOT IN ('revive', 'edit'))"
_WAIT = f"least(300.0, coalesce(o.retry_after, 15.0 * {_RUNS}))"


KEY_LIFE_SQL = (
    with_roles(
        f"""--o AS (SELECT key_id, seq, epoch_us(ts) / 1e6 AS at, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) AS d, daily, retry_after, CASE WHEN seq % 23 = 5 THEN 'dead' WHEN seq % 23 = 11 THEN 'revive' WHEN seq % 17 = 3 THEN 'edit' ELSE outcome END AS kind, CAST(4 + seq % 9 AS BIGINT) AS rpd FROM outcomes),
        w AS (SELECT DISTINCT key_id, CAST(0 AS BIGINT) AS seq, 'active' AS state, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS used, CAST(12 AS BIGINT) AS lim, 0 AS refusals, CAST(0.0 AS DOUBLE) AS cool, CAST(0.0 AS DOUBLE) AS last_used, '' AS err FROM o
          UNION ALL SELECT o.key_id, o.seq,
            CASE WHEN {_DEAD} THEN w.state WHEN o.kind = 'success' THEN CASE WHEN {_USED} + 1 >= w.lim THEN 'exhausted' ELSE {_ROLLED} END WHEN o.kind = 'rate_limited' THEN CASE WHEN {_SPENT} THEN 'exhausted' ELSE 'cooldown' END WHEN o.kind = 'transient' THEN 'cooldown' WHEN o.kind = 'dead' THEN 'dead' WHEN o.kind = 'revive' THEN 'active' WHEN {_ROLLED} = 'exhausted' AND {_USED} < o.rpd THEN 'active' ELSE {_ROLLED} END,
            CASE WHEN {_DEAD} THEN w.day ELSE o.d END, CASE WHEN {_DEAD} THEN w.used WHEN o.kind = 'success' THEN {_USED} + 1 ELSE {_USED} END,
            CASE WHEN {_DEAD} THEN w.lim WHEN o.kind = 'rate_limited' AND {_RUNS} >= 4 AND {_USED} < w.lim AND {_USED} >= 10 THEN {_USED} WHEN o.kind = 'edit' THEN o.rpd ELSE w.lim END,
            CAST(CASE WHEN {_DEAD} THEN w.refusals WHEN o.kind IN ('success', 'revive') THEN 0 WHEN o.kind = 'rate_limited' THEN {_RUNS} ELSE {_RUNS} - 1 END AS INTEGER),
            CASE WHEN {_DEAD} THEN w.cool WHEN o.kind = 'rate_limited' AND NOT {_SPENT} THEN o.at + {_WAIT} WHEN o.kind = 'transient' THEN o.at + 30 WHEN o.kind = 'revive' THEN 0.0 ELSE w.cool END,
            CASE WHEN {_DEAD} OR o.kind IN ('revive', 'edit') THEN w.last_used ELSE greatest(w.last_used, o.at) END,
            CASE WHEN {_DEAD} THEN w.err WHEN o.kind = 'success' THEN CASE WHEN {_USED} + 1 >= w.lim THEN '{fixed.SPENT}' ELSE '' END
              WHEN o.kind = 'rate_limited' THEN CASE WHEN {_SPENT} AND {_RUNS} >= 4 AND {_USED} < w.lim AND {_USED} >= 10 THEN replace('{fixed.LEARNED}', '{{}}', CAST({_USED} AS VARCHAR)) WHEN {_SPENT} AND {_RUNS} >= 4 AND {_USED} < w.lim THEN replace('{fixed.PARKED}', '{{}}', CAST({_USED} AS VARCHAR)) WHEN {_SPENT} THEN '{fixed.SPENT}' ELSE replace('{fixed.WAITING}', '{{}}', CAST(CAST(floor({_WAIT}) AS BIGINT) AS VARCHAR)) END
              WHEN o.kind = 'transient' THEN replace('{fixed.SERVER_ERROR}', '{{}}', 'said ' || o.seq) WHEN o.kind = 'dead' THEN replace('{fixed.REJECTED}', '{{}}', 'said ' || o.seq) WHEN o.kind = 'revive' THEN '' ELSE {_ERR} END
          FROM w JOIN o ON o.key_id = w.key_id AND o.seq = w.seq + 1)
        SELECT w.key_id AS key_id, state, strftime(day, '%Y-%m-%d') AS used_on, used AS used_today, lim AS rpd_limit, refusals, round(cool, 3) AS cooldown_until, round(last_used, 3) AS last_used_at, err AS last_error FROM w JOIN (SELECT key_id, max(seq) AS top FROM o GROUP BY key_id) t ON w.key_id = t.key_id AND w.seq = t.top""",
        "outcomes",
    )
)


def life_of_keys(spark, sf_dir):
    """Keys, and outcomes of every kind: rejected, revived and edited ones too."""
    s = F.col("seq")
    kind = F.when(s % 23 == 5, "dead").when(s % 23 == 11, "revive").when(s % 17 == 3, "edit").otherwise(F.col("outcome"))
    o = outcomes(spark, sf_dir).withColumns({"outcome": kind, "rpd": F.when(kind == "edit", 4 + s % 9)})
    o = o.withColumn("message", F.when(F.col("outcome").isin("transient", "dead"), F.concat(F.lit("said "), s.cast("string"))).otherwise(F.col("message")))
    return o.select("key_id").distinct().withColumn("rpd_limit", F.lit(12).cast("long")), o


def life(states):
    return states.select("key_id", "state", F.date_format("used_on", "yyyy-MM-dd").alias("used_on"), "used_today", "rpd_limit", "refusals", F.round("cooldown_until", 3).alias("cooldown_until"), F.round("last_used_at", 3).alias("last_used_at"), "last_error")


@query(KEY_LIFE_SQL)
def key_life(spark, sf_dir):
    """Every transition of a key, with all messages and times, on from a snapshot half way."""
    k, o = life_of_keys(spark, sf_dir)
    half = written(K.fold_outcomes(k, o.filter("seq <= 7")), "half")
    return life(K.fold_outcomes(half, o.filter("seq > 7")))


@query(KEY_LIFE_SQL)
def key_life_by_ranges(spark, sf_dir):
    """The same for keys of any number of outcomes."""
    return life(K.fold_by_ranges(*life_of_keys(spark, sf_dir)))
