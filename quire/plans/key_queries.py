"""Queries of keys, quotas and leases, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fixed, quota
from quire.functions import text as text_functions
from quire.operators import keys as K
from quire.plans.roles import keys, outcomes, pages, table, with_roles
from quire.streaming import pipeline

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Half a minute after the last event.
NOW = "(SELECT max(last_used_at) + 30 FROM keys)"
ELIGIBLE = "enabled AND state NOT IN ('dead', 'exhausted') AND used_today < rpd_limit"
AVAILABLE = "greatest(cooldown_until, last_used_at + CASE WHEN rpm_limit <= 0 THEN 0.0 ELSE 60.0 / rpm_limit END)"


def now_of(spark, sf_dir) -> float:
    return keys(spark, sf_dir).agg(F.max("last_used_at")).first()[0] + 30


@query("SELECT user_id AS key_id, CAST(CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS used FROM events GROUP BY 1, 2")
def pacific_usage(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key_id"), quota.quota_day(F.col("ts")).cast("string").alias("day")).agg(F.count("*").alias("used"))


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) ORDER BY ts, event_id) AS BIGINT) AS used_so_far FROM events")
def daily_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", K.used_so_far(e, "user_id", "ts", "event_id").alias("used_so_far"))


@query(
    """SELECT event_id, CAST(86400 - (hour(l) * 3600 + minute(l) * 60 + second(l)) AS BIGINT) AS wall, CAST(epoch(date_trunc('second', CAST((CAST(l AS DATE) + 1) AS TIMESTAMP) AT TIME ZONE 'America/Los_Angeles' AT TIME ZONE 'UTC')) - ceil(epoch(ts)) AS BIGINT) AS elapsed
    FROM (SELECT event_id, ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS l FROM events)"""
)
def quota_reset(spark, sf_dir):
    wall, elapsed = quota.seconds_to_reset(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", wall.alias("wall"), elapsed.alias("elapsed"))


@query(with_roles("--i AS (SELECT *, sum(CASE WHEN outcome = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY key_id ORDER BY seq) AS island FROM outcomes) SELECT event_id, CAST(sum(CASE WHEN outcome = 'rate_limited' THEN 1 ELSE 0 END) OVER (PARTITION BY key_id, island ORDER BY seq) AS BIGINT) AS run FROM (SELECT i.*, e.event_id FROM i JOIN (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) e ON e.user_id = key_id AND e.s = seq)", "outcomes"))
def consecutive_errors(spark, sf_dir):
    """Refusals since the last success."""
    return K.refusals_in_a_row(outcomes(spark, sf_dir)).select("event_id", "run")


@query(with_roles("--g AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before IS NOT NULL AND epoch_us(ts) - epoch_us(before) < 6000000 AS too_soon FROM g", "keys"))
def request_pacing(spark, sf_dir):
    """Requests closer to the one before than ten a minute allows."""
    return K.too_soon(table(spark, sf_dir, "events"), "user_id", "ts", F.lit(fixed.RPM), "event_id").select("event_id", "too_soon")


@query(with_roles("SELECT event_id, least(300.0, coalesce(CASE WHEN value > 10 THEN value END, 15.0 * (event_id % 30))) AS seconds FROM events", "keys"))
def backoff_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", quota.backoff(F.when(F.col("value") > 10, F.col("value")).otherwise(0.0), (F.col("event_id") % 30).cast("double")).alias("seconds"))


_NEW = "(w.day IS NULL OR w.day <> o.d)"
_USED, _RUNS = f"(CASE WHEN {_NEW} THEN 0 ELSE w.used END)", f"((CASE WHEN {_NEW} THEN 0 ELSE w.refusals END) + 1)"
_SPENT = f"(o.daily OR {_USED} >= w.lim OR {_RUNS} >= 4)"


@query(
    with_roles(
        f"""--o AS (SELECT *, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles' AS DATE) AS d FROM outcomes),
        w AS (SELECT DISTINCT key_id, CAST(0 AS BIGINT) AS seq, 'active' AS state, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS used, CAST(12 AS BIGINT) AS lim, 0 AS refusals FROM o
          UNION ALL SELECT o.key_id, o.seq,
            CASE o.outcome WHEN 'success' THEN CASE WHEN {_USED} + 1 >= w.lim THEN 'exhausted' WHEN {_NEW} AND w.state = 'exhausted' THEN 'active' ELSE w.state END WHEN 'rate_limited' THEN CASE WHEN {_SPENT} THEN 'exhausted' ELSE 'cooldown' END ELSE 'cooldown' END,
            o.d, CASE WHEN o.outcome = 'success' THEN {_USED} + 1 ELSE {_USED} END,
            CASE WHEN o.outcome = 'rate_limited' AND {_RUNS} >= 4 AND {_USED} < w.lim AND {_USED} >= 10 THEN {_USED} ELSE w.lim END,
            CAST(CASE o.outcome WHEN 'success' THEN 0 WHEN 'rate_limited' THEN {_RUNS} ELSE {_RUNS} - 1 END AS INTEGER) FROM w JOIN o ON o.key_id = w.key_id AND o.seq = w.seq + 1)
        SELECT w.key_id AS key_id, state, used AS used_today, lim AS rpd_limit, refusals FROM w JOIN (SELECT key_id, max(seq) AS top FROM o GROUP BY key_id) t ON w.key_id = t.key_id AND w.seq = t.top""",
        "outcomes",
    )
)
def key_state(spark, sf_dir):
    """Every key's outcomes folded in order, with a limit of 12 a day."""
    o = outcomes(spark, sf_dir)
    k = o.select("key_id").distinct().withColumn("rpd_limit", F.lit(12).cast("long"))
    return K.fold_outcomes(k, o).select("key_id", "state", "used_today", "rpd_limit", "refusals")


@query(with_roles(f"SELECT key_id, label FROM keys WHERE {ELIGIBLE} ORDER BY key_id LIMIT 5", "keys"))
def working_set(spark, sf_dir):
    return K.working_set(keys(spark, sf_dir)).select("key_id", "label")


@query(with_roles(f"--w AS (SELECT * FROM keys WHERE {ELIGIBLE} ORDER BY key_id LIMIT 5) SELECT key_id, label FROM w WHERE {AVAILABLE} <= {NOW} ORDER BY last_used_at, key_id LIMIT 1", "keys"))
def acquire_lru(spark, sf_dir):
    return K.acquire(keys(spark, sf_dir), now_of(spark, sf_dir)).select("key_id", "label")


@query(with_roles(f"--w AS (SELECT * FROM keys WHERE {ELIGIBLE} ORDER BY key_id LIMIT 5) SELECT round(min(greatest(0.0, {AVAILABLE} - {NOW})), 3) AS seconds FROM w", "keys"))
def next_available(spark, sf_dir):
    return K.next_available_in(keys(spark, sf_dir), now_of(spark, sf_dir)).select(F.round("seconds", 3).alias("seconds"))


@query(
    with_roles(
        f"""SELECT CAST(count(*) AS BIGINT) AS keys_total, CAST(count(*) FILTER (enabled AND state <> 'dead') AS BIGINT) AS keys_live, CAST(count(*) FILTER (state = 'dead') AS BIGINT) AS keys_dead, CAST(count(*) FILTER (NOT enabled) AS BIGINT) AS keys_disabled,
        CAST(least(5, count(*) FILTER ({ELIGIBLE})) AS BIGINT) AS keys_in_use, CAST(sum(used_today) AS BIGINT) AS used_today, CAST(sum(greatest(0, rpd_limit - used_today)) FILTER (enabled AND state <> 'dead') AS BIGINT) AS remaining_today,
        CAST(sum(greatest(0, rpd_limit - used_today)) FILTER (enabled AND state NOT IN ('dead', 'exhausted')) AS BIGINT) AS usable_remaining, count(*) FILTER (enabled AND state <> 'dead') > 0 AS has_live_keys FROM keys""",
        "keys",
    )
)
def capacity(spark, sf_dir):
    return K.capacity(keys(spark, sf_dir))


@query(with_roles(f"--w AS (SELECT key_id FROM keys WHERE {ELIGIBLE} ORDER BY key_id LIMIT 5) SELECT key_id, '…' || right(secret, 4) AS secret, key_id IN (SELECT key_id FROM w) AS in_use, greatest(0, rpd_limit - used_today) AS remaining, CAST(greatest(0, trunc(cooldown_until - {NOW})) AS INTEGER) AS cooldown_seconds FROM keys", "keys"))
def key_snapshot(spark, sf_dir):
    return K.snapshot(keys(spark, sf_dir), now_of(spark, sf_dir)).select("key_id", "secret", "in_use", "remaining", "cooldown_seconds")


@query(
    with_roles(
        f"""--w AS (SELECT * FROM keys WHERE {ELIGIBLE} ORDER BY key_id LIMIT 5), s AS (SELECT key_id, row_number() OVER (ORDER BY turn, key_id) AS rank FROM (SELECT key_id, unnest(range(1, rpd_limit - used_today + 1)) AS turn FROM w)),
        p AS (SELECT book_id, page_no, row_number() OVER (ORDER BY book_id, page_no) AS rank FROM pages WHERE status = 'pending') SELECT book_id, page_no, key_id FROM p JOIN s USING (rank)""",
        "pages",
        "keys",
    )
)
def lease_assignment(spark, sf_dir):
    return K.lease(pages(spark, sf_dir).filter("status = 'pending'"), keys(spark, sf_dir))


@query(with_roles("SELECT CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending, (SELECT CAST(sum(rpd_limit) AS BIGINT) FROM keys WHERE state <> 'dead') AS daily, round(count(*) FILTER (status = 'pending') / (SELECT sum(rpd_limit) FROM keys WHERE state <> 'dead'), 1) AS days FROM pages", "pages", "keys"))
def eta_days(spark, sf_dir):
    """Disabled keys count, dead ones don't."""
    daily = keys(spark, sf_dir).filter("state <> 'dead'").agg(F.sum("rpd_limit").alias("daily"))
    waiting = pages(spark, sf_dir).agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return waiting.crossJoin(daily).withColumn("days", F.when(F.col("daily") > 0, F.round(F.col("pending") / F.col("daily"), 1)))


@query(with_roles("SELECT count(secret) <> count(DISTINCT secret) AS has_duplicates, CAST(count(secret) - count(DISTINCT secret) AS BIGINT) AS extra FROM keys", "keys"))
def duplicate_secrets(spark, sf_dir):
    return K.duplicate_secrets(keys(spark, sf_dir))


@query(with_roles("SELECT key_id, label, CASE WHEN state = 'cooldown' THEN 'new' ELSE secret END AS secret, enabled OR state = 'cooldown' AS enabled FROM keys UNION ALL SELECT (SELECT max(key_id) FROM keys) + 1, 'zz-new', 'fresh', true", "keys"))
def key_upsert(spark, sf_dir):
    """Cooling keys get a new secret, and one label is new."""
    every = keys(spark, sf_dir)
    k = every.select("key_id", "label", "secret", "rpm_limit", "rpd_limit", "enabled")
    entries = every.filter("state = 'cooldown'").select("label", F.lit("new").alias("secret"), "rpm_limit", "rpd_limit").union(spark.createDataFrame([("zz-new", "fresh", 1, 1)], "label string, secret string, rpm_limit int, rpd_limit long"))
    return K.upsert_keys(k, entries).select("key_id", "label", "secret", "enabled")


@query(with_roles("SELECT label, greatest(0, rpm_limit - 15) AS rpm_limit, greatest(1, rpd_limit - 3) AS rpd_limit FROM keys WHERE key_id % 4 <> 0", "keys"))
def key_entries(spark, sf_dir):
    """Every fourth entry has a blank label; limits are clamped."""
    e = keys(spark, sf_dir).select(F.when(F.col("key_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "label")).alias("label"), "secret", (F.col("rpm_limit") - 15).alias("rpm_limit"), (F.col("rpd_limit") - 3).alias("rpd_limit"))
    return K.valid_entries(e)[0].select("label", "rpm_limit", "rpd_limit")


@query(
    with_roles(
        """--e AS (SELECT *, key_id % 3 = 0 AS edited, CASE WHEN key_id % 3 = 0 THEN greatest(0, rpm_limit - 15) ELSE rpm_limit END AS rpm, CASE WHEN key_id % 6 = 0 THEN greatest(1, rpd_limit - 4) ELSE rpd_limit END AS rpd FROM keys)
        SELECT key_id, label, CASE WHEN key_id % 9 = 0 THEN 'changed' ELSE secret END AS secret, rpm AS rpm_limit, rpd AS rpd_limit, CASE WHEN edited AND state = 'exhausted' AND used_today < rpd THEN 'active' ELSE state END AS state, CASE WHEN key_id % 6 = 3 THEN false ELSE enabled END AS enabled, used_today FROM e""",
        "keys",
    )
)
def key_edit(spark, sf_dir):
    """Every third key: a lower pace, some with a lower allowance, a blank or a new secret, or switched off."""
    every, i = keys(spark, sf_dir), F.col("key_id")
    edits = every.filter(i % 3 == 0).select("label", (F.col("rpm_limit") - 15).alias("rpm_limit"), F.when(i % 6 == 0, F.col("rpd_limit") - 4).alias("rpd_limit"), F.when(i % 6 == 3, False).alias("enabled"), F.when(i % 9 == 0, " changed ").otherwise("  ").alias("secret"))
    return K.edit(every, edits).select("key_id", "label", "secret", "rpm_limit", "rpd_limit", "state", "enabled", "used_today")


@query(with_roles("SELECT key_id, label FROM keys WHERE state <> 'dead'", "keys"))
def key_delete(spark, sf_dir):
    every = keys(spark, sf_dir)
    return K.without(every, every.filter("state = 'dead'").select("label")).select("key_id", "label")


@query(
    with_roles(
        f"""--d AS (SELECT *, key_id % 4 = 1 AS fresh, CASE WHEN key_id % 4 = 1 THEN 0 ELSE used_today END AS used, CASE WHEN key_id % 4 = 1 AND state = 'exhausted' THEN 'active' WHEN state = 'cooldown' AND cooldown_until <= {NOW} THEN 'active' ELSE state END AS s,
        CASE WHEN key_id % 4 = 1 AND state = 'exhausted' OR state = 'cooldown' AND cooldown_until <= {NOW} THEN '' ELSE 'was ' || state END AS e FROM keys)
        SELECT key_id, CASE WHEN s = 'active' AND used >= rpd_limit THEN 'exhausted' ELSE s END AS state, CAST(used AS BIGINT) AS used_today, CAST(CASE WHEN fresh THEN 0 ELSE 2 END AS INTEGER) AS refusals, CASE WHEN s = 'active' AND used >= rpd_limit THEN '{fixed.SPENT}' ELSE e END AS last_error FROM d""",
        "keys",
    )
)
def expired_keys(spark, sf_dir):
    """Every fourth key was last used the day before."""
    day = F.lit("2024-05-02").cast("date")
    before = keys(spark, sf_dir).withColumns({"used_on": F.when(F.col("key_id") % 4 == 1, F.date_sub(day, 1)).otherwise(day), "refusals": F.lit(2), "last_error": F.concat(F.lit("was "), "state")})
    return K.expire(before, now_of(spark, sf_dir), day).select("key_id", "state", "used_today", "refusals", "last_error")


@query(
    """SELECT user_id, event_id, CAST((epoch_us(ts) - epoch_us(before)) // 1000 AS BIGINT) AS latency_ms, CAST((epoch_us(ts) - epoch_us(before)) // 3600000000 AS BIGINT) AS hours
    FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)"""
)
def event_latency(spark, sf_dir):
    """Whole milliseconds and hours since the user's event before."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(20, 0)") / F.lit(1_000_000).cast("decimal(7, 0)")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("at"))
    e = e.withColumn("before", F.lag("at").over(W.partitionBy("user_id").orderBy("at", "event_id")))
    return e.select("user_id", "event_id", quota.latency_ms(F.col("before"), F.col("at")).alias("latency_ms"), quota.whole_hours(F.col("at") - F.col("before")).alias("hours"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Extension: tumbling windows."""
    got = pipeline.tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS sessions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) WHERE before IS NULL OR ts - before >= INTERVAL '30 minutes' GROUP BY user_id")
def event_sessions(spark, sf_dir):
    """Extension: sessions closed by half an hour of rest."""
    return pipeline.session_counts(table(spark, sf_dir, "events"), "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("SELECT event_id, '…' || right('tok-' || event_id, 4) AS shown FROM events")
def masked_secrets(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text_functions.masked(F.concat(F.lit("tok-"), "event_id")).alias("shown"))
