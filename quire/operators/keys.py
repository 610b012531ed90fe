"""Metered keys: the fold of their outcomes, the working set, acquisition, capacity and leases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import fixed, quota
from quire.functions.text import has_any, masked, or_empty, strip, truthy
from quire.operators.numbering import RANGES, along, dealt, numbered, running, split_by

STATE = "struct<state: string, used_on: date, used_today: long, rpd_limit: long, refusals: int, cooldown_until: double, last_used_at: double, last_error: string>"


def rolled(s: Column, day: Column) -> Column:
    """The state on ``day``: a new day clears usage and revives an exhausted key, never a dead one."""
    new = s["used_on"].isNull() | (s["used_on"] != day)
    revived = new & (s["state"] == "exhausted")
    return F.struct(
        F.when(revived, "active").otherwise(s["state"]).alias("state"),
        day.alias("used_on"),
        F.when(new, 0).otherwise(s["used_today"]).cast("long").alias("used_today"),
        s["rpd_limit"].alias("rpd_limit"),
        F.when(new, 0).otherwise(s["refusals"]).cast("int").alias("refusals"),
        s["cooldown_until"].alias("cooldown_until"),
        s["last_used_at"].alias("last_used_at"),
        F.when(revived, "").otherwise(s["last_error"]).alias("last_error"),
    ).cast(STATE)


def filled(message: str, value: Column) -> Column:
    head, tail = message.split("{}")
    return F.concat(F.lit(head), value.cast("string"), F.lit(tail))


def stepped(before: Column, o: Column) -> Column:
    """One outcome: struct(seq, ts, day, daily, outcome, message, retry_after, rpd)."""
    s = rolled(before, o["day"])
    kind = o["outcome"]
    dead = (before["state"] == "dead") & ~kind.isin("revive", "edit")
    used, limit = s["used_today"], s["rpd_limit"]
    counted = used + 1
    runs = s["refusals"] + 1
    at_limit, refused = used >= limit, runs >= fixed.REFUSALS
    spent = o["daily"] | at_limit | refused
    learned = refused & ~at_limit & (used >= fixed.LEARN_FROM)
    wait = quota.backoff(o["retry_after"], runs.cast("double"))
    success, limited, transient = kind == "success", kind == "rate_limited", kind == "transient"
    edited = kind == "edit"
    state = (
        F.when(success, F.when(counted >= limit, "exhausted").otherwise(s["state"]))
        .when(limited, F.when(spent, "exhausted").otherwise("cooldown"))
        .when(transient, "cooldown")
        .when(kind == "dead", "dead")
        .when(kind == "revive", "active")
        .when(edited & (s["state"] == "exhausted") & (used < o["rpd"]), "active")
        .otherwise(s["state"])
    )
    error = (
        F.when(success, F.when(counted >= limit, fixed.SPENT).otherwise(""))
        .when(limited & spent & learned, filled(fixed.LEARNED, used))
        .when(limited & spent & refused & ~at_limit, filled(fixed.PARKED, used))
        .when(limited & spent, fixed.SPENT)
        .when(limited, filled(fixed.WAITING, wait.cast("int")))
        .when(transient, filled(fixed.SERVER_ERROR, F.left(or_empty(o["message"]), F.lit(120))))
        .when(kind == "dead", filled(fixed.REJECTED, F.left(or_empty(o["message"]), F.lit(200))))
        .when(kind == "revive", "")
        .otherwise(s["last_error"])
    )
    after = F.struct(
        state.alias("state"),
        s["used_on"].alias("used_on"),
        F.when(success, counted).otherwise(used).alias("used_today"),
        F.when(limited & spent & learned, used).when(edited, o["rpd"]).otherwise(limit).alias("rpd_limit"),
        F.when(success | (kind == "revive"), 0).when(limited, runs).otherwise(s["refusals"]).cast("int").alias("refusals"),
        F.when(limited & ~spent, o["ts"] + wait).when(transient, o["ts"] + fixed.TRANSIENT_COOLDOWN).when(kind == "revive", 0.0).otherwise(s["cooldown_until"]).alias("cooldown_until"),
        F.greatest(s["last_used_at"], F.when(kind.isin("revive", "edit"), s["last_used_at"]).otherwise(o["ts"])).alias("last_used_at"),
        error.alias("last_error"),
    ).cast(STATE)
    return F.when(dead, before).otherwise(after)


STATE_FIELDS = ["state", "used_on", "used_today", "rpd_limit", "refusals", "cooldown_until", "last_used_at", "last_error"]


def fresh(rpd_limit: Column) -> Column:
    """The state of a key that has had no outcome."""
    return F.struct(F.lit("active").alias("state"), F.lit(None).cast("date").alias("used_on"), F.lit(0).cast("long").alias("used_today"), rpd_limit.cast("long").alias("rpd_limit"), F.lit(0).alias("refusals"), F.lit(0.0).alias("cooldown_until"), F.lit(0.0).alias("last_used_at"), F.lit("").alias("last_error")).cast(STATE)


def fold_outcomes(keys: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Key states after their outcomes, in order of ``seq``. ``keys``: key_id, rpd_limit (and any others); with the columns of a
    state they go on from it. ``outcomes``: key_id, seq, ts (timestamp), outcome, message, retry_after, rpd. A key's outcomes are few:
    its daily allowance bounds them."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    own = outcomes.withColumn("o", F.struct("seq", seconds.alias("ts"), quota.quota_day(F.col("ts").cast("timestamp_ntz")).alias("day"), has_any(F.col("message"), fixed.DAILY_MARKERS).alias("daily"), "outcome", "message", "retry_after", F.col("rpd").cast("long").alias("rpd")))
    logs = own.groupBy("key_id").agg(F.array_sort(F.collect_list("o")).alias("log"))
    known = [c for c in STATE_FIELDS if c in keys.columns]
    start = F.struct(*STATE_FIELDS).cast(STATE) if len(known) == len(STATE_FIELDS) else fresh(F.col("rpd_limit"))
    joined = keys.join(logs, "key_id", "left")
    folded = joined.withColumn("s", F.when(F.col("log").isNull(), start).otherwise(F.aggregate("log", start, stepped)))
    return folded.drop("log", *(known if len(known) == len(STATE_FIELDS) else ["rpd_limit"])).select("*", "s.*").drop("s")


def fold_by_ranges(keys: DataFrame, outcomes: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``fold_outcomes`` for keys of any number of outcomes, whose times follow ``seq``: no key's outcomes are on one task or in one array.

    What an outcome does depends on few numbers, each of them running: whether the key was dead (the last of dead and
    revive), the day's successes, the day's refusals since the last success, and the limit, which is the smaller of what was
    given last and what was learned since. Outcomes are dealt to ranges once, after a row that gives the key its first limit; only keys
    in several ranges carry numbers on. With these each outcome says by itself what it sets, and a key is what was set last; a spent one
    is back after a later day's outcome or an edit above its use."""
    c, kind = F.col, F.col("outcome")
    by_hand = kind.isin("revive", "edit")
    o = outcomes.select("key_id", c("seq").cast("long").alias("seq"), (F.unix_micros(c("ts").cast("timestamp")) / 1e6).alias("at"), quota.quota_day(c("ts").cast("timestamp_ntz")).alias("day"), has_any(c("message"), fixed.DAILY_MARKERS).alias("daily"), "outcome", F.left("message", F.lit(200)).alias("message"), "retry_after", c("rpd").cast("long").alias("rpd"), F.lit(False).alias("begins"))
    first = keys.select("key_id", F.lit(-(2**63)).alias("seq"), c("rpd_limit").cast("long").alias("rpd"), F.lit(True).alias("begins"))
    o = dealt(o.unionByName(first, allowMissingColumns=True), ["key_id", "day", "seq"], ranges)
    split = split_by(o, "key_id")
    # days follow seq, so all of these have one order
    o = o.withColumns({"mark": F.when(kind.isin("dead", "revive"), 2 * c("seq") + (kind == "dead").cast("int")), "grant": F.when(c("begins") | (kind == "edit"), F.struct("seq", "rpd"))})
    o = along(o, ["key_id"], ["day", "seq"], split, tops={"marked": "mark", "given": "grant"}, own=False)
    o = o.filter(c("begins") | (c("given").isNotNull() & (by_hand | ~F.coalesce(c("marked") % 2 == 1, F.lit(False)))))  # a dead key only answers to hands
    o = o.withColumns({"is_success": F.coalesce(kind == "success", F.lit(False)).cast("long"), "is_refusal": F.coalesce(kind == "rate_limited", F.lit(False)).cast("long")})
    o = along(o, ["key_id", "day"], ["seq"], split, sums={"used": "is_success", "refused": "is_refusal"})
    o = along(o.withColumn("base", F.when(kind.isin("success", "revive"), c("refused"))), ["key_id", "day"], ["seq"], split, tops={"based": "base"})
    o = o.withColumn("runs", c("refused") - F.coalesce("based", F.lit(0)))
    o = o.withColumn("lesson", F.when((kind == "rate_limited") & (c("runs") >= fixed.REFUSALS) & (c("used") >= fixed.LEARN_FROM), F.struct(c("given.seq").alias("since"), (-c("used")).alias("minus"))))
    o = along(o, ["key_id"], ["day", "seq"], split, tops={"lessons": "lesson"}, own=False).filter(~c("begins"))
    learned_since = (c("lessons.since") == c("given.seq")) & (-c("lessons.minus") < c("given.rpd"))
    o = o.withColumn("limit", F.when(learned_since, -c("lessons.minus")).otherwise(c("given.rpd")))
    refused, at_limit = c("runs") >= fixed.REFUSALS, c("used") >= c("limit")
    success, limited, transient = kind == "success", kind == "rate_limited", kind == "transient"
    spent, few = c("daily") | at_limit | refused, refused & ~at_limit
    learned, wait = few & (c("used") >= fixed.LEARN_FROM), quota.backoff(c("retry_after"), c("runs").cast("double"))
    o = o.withColumns(
        {
            "sets": F.when(success, F.when(at_limit, "exhausted")).when(limited, F.when(spent, "exhausted").otherwise("cooldown")).when(transient, "cooldown").when(kind == "dead", "dead").when(kind == "revive", "active"),
            "says": F.when(success, F.when(at_limit, fixed.SPENT).otherwise(""))
            .when(limited & spent & learned, filled(fixed.LEARNED, c("used")))
            .when(limited & spent & few, filled(fixed.PARKED, c("used")))
            .when(limited & spent, fixed.SPENT)
            .when(limited, filled(fixed.WAITING, wait.cast("int")))
            .when(transient, filled(fixed.SERVER_ERROR, F.left(or_empty(c("message")), F.lit(120))))
            .when(kind == "dead", filled(fixed.REJECTED, F.left(or_empty(c("message")), F.lit(200))))
            .when(kind == "revive", ""),
            "cools": F.when(limited & ~spent, c("at") + wait).when(transient, c("at") + fixed.TRANSIENT_COOLDOWN).when(kind == "revive", 0.0),
            "leaves": F.when(limited & spent & learned, c("used")).when(kind == "edit", c("rpd")).otherwise(c("limit")),
            "frees": (kind == "edit") & (c("used") < c("rpd")),
        }
    )
    latest = {
        "set": F.when(c("sets").isNotNull(), F.struct("seq", "sets", "day")),
        "said": F.when(c("says").isNotNull(), F.struct("seq", "says", "day")),
        "freed": F.when(c("frees"), F.struct("seq", "day")),
        "cool": F.when(c("cools").isNotNull(), F.struct("seq", "cools")),
        "last_at": F.when(~by_hand, c("at")),
        "end": F.struct("seq", "used", "runs", "day", "leaves"),
    }
    # first where a key's outcomes already are, so that a row for each range and key is shuffled
    ends = o.groupBy("__range", c("key_id").alias("of")).agg(*[F.max(value).alias(name) for name, value in latest.items()])
    ends = ends.groupBy("of").agg(*[F.max(name).alias(name) for name in latest])
    was_spent = F.coalesce(c("set.sets") == "exhausted", F.lit(False))
    freed = F.coalesce((c("freed.seq") > c("set.seq")) & (c("freed.day") == c("set.day")), F.lit(False))
    rolled = was_spent & ~freed & (c("end.day") != c("set.day"))
    after = F.struct(
        F.when(was_spent & (freed | rolled), "active").otherwise(F.coalesce("set.sets", F.lit("active"))).alias("state"),
        c("end.day").alias("used_on"),
        c("end.used").alias("used_today"),
        c("end.leaves").alias("rpd_limit"),
        c("end.runs").cast("int").alias("refusals"),
        F.coalesce("cool.cools", F.lit(0.0)).alias("cooldown_until"),
        F.coalesce("last_at", F.lit(0.0)).alias("last_used_at"),
        F.when(rolled & (c("said.day") == c("set.day")), "").otherwise(F.coalesce("said.says", F.lit(""))).alias("last_error"),
    ).cast(STATE)
    out = keys.join(ends, c("key_id") == c("of"), "left").withColumn("s", F.when(c("of").isNull(), fresh(c("rpd_limit"))).otherwise(after))
    return out.select(*[x for x in keys.columns if x not in STATE_FIELDS], "s.*")


def expire(keys: DataFrame, now: float, day: Column) -> DataFrame:
    """The states at ``now``: day rolled over, cooldowns ended, spent allowances noticed."""
    names = STATE_FIELDS
    s = rolled(F.struct(*names).cast(STATE), day)
    df = keys.withColumn("s", s).drop(*names).select("*", "s.*").drop("s")
    over = (F.col("state") == "cooldown") & (F.col("cooldown_until") <= now)
    df = df.withColumns({"state": F.when(over, "active").otherwise(F.col("state")), "last_error": F.when(over, "").otherwise(F.col("last_error"))})
    spent = (F.col("state") == "active") & (F.col("used_today") >= F.col("rpd_limit"))
    return df.withColumns({"state": F.when(spent, "exhausted").otherwise(F.col("state")), "last_error": F.when(spent, fixed.SPENT).otherwise(F.col("last_error"))})


def eligible(keys: DataFrame) -> DataFrame:
    return keys.filter(F.col("enabled") & ~F.col("state").isin("dead", "exhausted") & (quota.remaining(F.col("rpd_limit"), F.col("used_today")) > 0))


def working_set(keys: DataFrame, size: int = fixed.WORKING_KEYS) -> DataFrame:
    """The first eligible keys by id."""
    return eligible(keys).orderBy("key_id").limit(size)


def with_availability(keys: DataFrame) -> DataFrame:
    c = F.col
    return keys.withColumn("available_at", quota.available_at(c("enabled"), c("state"), c("used_today"), c("rpd_limit"), c("cooldown_until"), c("last_used_at"), c("rpm_limit")))


def acquire(keys: DataFrame, now: float, size: int = fixed.WORKING_KEYS, day: Column | None = None) -> DataFrame:
    """The ready key of the working set that rested longest, ties by id; no row if none is ready. With ``day``, what has
    expired by ``now`` is applied first, so after midnight spent keys are handed out again."""
    keys = keys if day is None else expire(keys, now, day)
    return with_availability(working_set(keys, size)).filter(F.col("available_at") <= now).orderBy("last_used_at", "key_id").limit(1).withColumn("last_used_at", F.lit(now))


def next_available_in(keys: DataFrame, now: float, size: int = fixed.WORKING_KEYS) -> DataFrame:
    """Seconds until a key of the working set is ready; null if none will be."""
    return with_availability(working_set(keys, size)).agg(F.min(F.greatest(F.lit(0.0), F.col("available_at") - now)).alias("seconds"))


def capacity(keys: DataFrame, size: int = fixed.WORKING_KEYS) -> DataFrame:
    """One row. Spending counts all keys, what remains only those that are enabled and not dead; ``usable`` leaves out
    exhausted ones too."""
    live = F.col("enabled") & (F.col("state") != "dead")
    left = quota.remaining(F.col("rpd_limit"), F.col("used_today"))
    in_use = F.count_if(live & (F.col("state") != "exhausted") & (left > 0))
    return keys.agg(
        F.count("*").alias("keys_total"),
        F.count_if(live).alias("keys_live"),
        F.count_if(F.col("state") == "dead").alias("keys_dead"),
        F.count_if(~F.col("enabled")).alias("keys_disabled"),
        F.least(in_use, F.lit(size).cast("long")).alias("keys_in_use"),
        F.coalesce(F.sum("used_today"), F.lit(0)).alias("used_today"),
        F.coalesce(F.sum(F.when(live, left)), F.lit(0)).alias("remaining_today"),
        F.coalesce(F.sum(F.when(live & (F.col("state") != "exhausted"), left)), F.lit(0)).alias("usable_remaining"),
        (F.count_if(live) > 0).alias("has_live_keys"),
    )


def snapshot(keys: DataFrame, now: float, size: int = fixed.WORKING_KEYS) -> DataFrame:
    """Per key: in_use, remaining, cooldown_seconds, and the secret's last four characters if it has one."""
    window = working_set(keys, size).select("key_id", F.lit(True).alias("in_window"))
    out = keys.join(F.broadcast(window), "key_id", "left")  # at most ``size`` rows
    out = out.withColumns({"in_use": F.coalesce("in_window", F.lit(False)), "remaining": quota.remaining(F.col("rpd_limit"), F.col("used_today")), "cooldown_seconds": F.greatest(F.lit(0), (F.col("cooldown_until") - now).cast("int"))})
    return (out.withColumn("secret", masked(F.col("secret"))) if "secret" in keys.columns else out).drop("in_window")


def lease(pages: DataFrame, keys: DataFrame, size: int = fixed.WORKING_KEYS) -> DataFrame:
    """Pages with the key that may process them: keys take turns until each has used up what remains of its day.
    Ranks are only given to as many pages as there are slots, and slots are few."""
    slots = working_set(keys, size).select("key_id", F.explode(F.sequence(F.lit(1).cast("long"), quota.remaining(F.col("rpd_limit"), F.col("used_today")))).alias("turn"))
    slots = slots.select("key_id", F.row_number().over(W.orderBy("turn", "key_id")).alias("rank"))
    total = slots.count()
    ranked = pages.orderBy("book_id", "page_no").limit(total).select("book_id", "page_no", F.row_number().over(W.orderBy("book_id", "page_no")).alias("rank"))
    return ranked.join(slots, "rank").drop("rank")


def paced_slots(keys: DataFrame, now: float, horizon: float, size: int = fixed.WORKING_KEYS, most: int = 10) -> DataFrame:
    """key_id, at, spacing, rank: the times from ``now`` to ``now + horizon`` at which keys of the working set may be used, ``most`` of a
    key, as many as remain of its day and each its spacing after the one before, in order of time; of equal times
    the key that rested longest is first."""
    c = F.col
    first = F.greatest(c("available_at"), F.lit(now))
    own = with_availability(working_set(keys, size)).filter(c("available_at") <= now + horizon).withColumns({"spacing": quota.spacing(c("rpm_limit")), "first": first})
    in_time = F.when(c("spacing") > 0, F.floor((now + horizon - c("first")) / c("spacing")) + 1).otherwise(F.lit(most))
    n = F.least(quota.remaining(c("rpd_limit"), c("used_today")), in_time.cast("long"), F.lit(most).cast("long"))
    slots = own.filter(n > 0).select("key_id", "first", "spacing", "last_used_at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("turn")).withColumn("at", c("first") + c("turn") * c("spacing"))
    return slots.select("key_id", "at", "spacing", F.row_number().over(W.orderBy("at", "turn", "last_used_at", "key_id")).alias("rank"))


def paced_lease(pages: DataFrame, keys: DataFrame, now: float, horizon: float, size: int = fixed.WORKING_KEYS, most: int = 10) -> DataFrame:
    """Pages with the key that may process them and the time at which it may: ``size * most`` of them at most."""
    ranked = pages.orderBy("book_id", "page_no").limit(size * most).withColumn("rank", F.row_number().over(W.orderBy("book_id", "page_no")))
    return ranked.join(paced_slots(keys, now, horizon, size, most), "rank").drop("rank")


def upsert_keys(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """``entries``: label, secret, rpm_limit, rpd_limit. Known labels keep id and usage and are enabled again; others get
    the next ids in order of label."""
    fresh = entries.select("label", *[F.col(c).alias(f"new_{c}") for c in ("secret", "rpm_limit", "rpd_limit")])
    known = keys.join(fresh, "label", "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in ("secret", "rpm_limit", "rpd_limit")}).withColumn("enabled", F.col("enabled") | F.col("new_secret").isNotNull())
    known = known.select(*keys.columns)
    top = keys.agg(F.coalesce(F.max("key_id"), F.lit(0))).first()[0]
    added = numbered(fresh.join(keys.select("label"), "label", "left_anti"), "label", "key_id", top).select("key_id", "label", F.col("new_secret").alias("secret"), F.col("new_rpm_limit").alias("rpm_limit"), F.col("new_rpd_limit").alias("rpd_limit"), F.lit(True).alias("enabled"))
    return known.unionByName(added, allowMissingColumns=True)


def valid_entries(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, skipped): an entry needs a label and a secret that aren't blank."""
    e = entries.withColumns({"label": strip(or_empty(F.col("label"))), "secret": strip(or_empty(F.col("secret")))})
    good = (F.col("label") != "") & (F.col("secret") != "")
    clean = e.withColumns({"rpm_limit": F.greatest(F.lit(0), F.coalesce("rpm_limit", F.lit(fixed.RPM))), "rpd_limit": F.greatest(F.lit(1), F.coalesce("rpd_limit", F.lit(fixed.RPD)))})
    return clean.filter(good), e.filter(~good)


def edit(keys: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits``: label, rpm_limit, rpd_limit, enabled, secret (null or blank: as before), one a label. Limits are clamped, what
    was used today stays, and an exhausted key whose new limit isn't reached is active again."""
    e = edits.select("label", *[F.col(c).alias(f"new_{c}") for c in ("rpm_limit", "rpd_limit", "enabled", "secret")], F.lit(True).alias("edited"))
    k = keys.join(e, "label", "left").withColumns(
        {"rpm_limit": F.when(F.col("new_rpm_limit").isNull(), F.col("rpm_limit")).otherwise(F.greatest(F.lit(0), "new_rpm_limit")), "rpd_limit": F.when(F.col("new_rpd_limit").isNull(), F.col("rpd_limit")).otherwise(F.greatest(F.lit(1), "new_rpd_limit")), "enabled": F.coalesce("new_enabled", "enabled"), "secret": F.coalesce(truthy(strip(F.col("new_secret"))), "secret")}
    )
    back = F.col("edited") & (F.col("state") == "exhausted") & (F.col("used_today") < F.col("rpd_limit"))
    k = k.withColumns({"state": F.when(back, "active").otherwise(F.col("state")), **({"last_error": F.when(back, "").otherwise(F.col("last_error"))} if "last_error" in keys.columns else {})})
    return k.select(*keys.columns)


def without(keys: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone``: label. The keys that stay."""
    return keys.join(gone, "label", "left_anti")


def duplicate_secrets(keys: DataFrame) -> DataFrame:
    """One row: whether a secret is there twice, and how many keys are too many."""
    return keys.agg((F.count("secret") != F.count_distinct("secret")).alias("has_duplicates"), (F.count("secret") - F.count_distinct("secret")).alias("extra"))


def used_so_far(requests: DataFrame, key: str, ts: str, *ties: str) -> Column:
    """The number of a request among its key's of the quota day, as a column of ``requests``."""
    return F.row_number().over(W.partitionBy(key, quota.quota_day(F.col(ts))).orderBy(ts, *ties)).cast("long")


def refusals_in_a_row(outcomes: DataFrame) -> DataFrame:
    """``outcomes`` with ``run``, the refusals since the key's last success: islands by a running count of successes, a
    running count inside each."""
    order = W.partitionBy("key_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    inside = W.partitionBy("key_id", "__island").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    islands = outcomes.withColumn("__island", F.sum((F.col("outcome") == "success").cast("long")).over(order))
    return islands.withColumn("run", F.sum((F.col("outcome") == "rate_limited").cast("long")).over(inside)).drop("__island")


def refusals_by_ranges(outcomes: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``refusals_in_a_row`` for keys of any number of outcomes: the refusals so far less those by the last success, both
    running numbers that ranges of one key carry on."""
    o = outcomes.withColumn("__refused", (F.col("outcome") == "rate_limited").cast("long"))
    o = dealt(o, ["key_id", "seq"], ranges)
    split = split_by(o, "key_id")
    o = along(o, ["key_id"], ["seq"], split, sums={"__so_far": "__refused"})
    o = o.withColumn("__by_success", F.when(F.col("outcome") == "success", F.col("__so_far")))
    o = along(o, ["key_id"], ["seq"], split, tops={"__before": "__by_success"})
    return o.withColumn("run", F.col("__so_far") - F.coalesce("__before", F.lit(0))).select(*outcomes.columns, "run")


def used_by_ranges(requests: DataFrame, key: str, ts: str, *ties: str, ranges: int = RANGES) -> DataFrame:
    """``requests`` with ``used_so_far``, the number of each among its key's of the quota day, however many one key has."""
    r = requests.withColumns({"__day": quota.quota_day(F.col(ts)), "__one": F.lit(1).cast("long")})
    return running(r, [key, "__day"], [ts, *ties], sums={"used_so_far": "__one"}, ranges=ranges).select(*requests.columns, "used_so_far")


def too_soon(requests: DataFrame, key: str, ts: str, rpm: Column, *ties: str) -> DataFrame:
    """``requests`` with ``too_soon``: closer to the key's one before than its limit a minute allows."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    before = F.lag(ts).over(W.partitionBy(key).orderBy(ts, *ties))
    gap = micros(F.col(ts)) - micros(F.col("__before"))
    return requests.withColumn("__before", before).withColumn("too_soon", F.coalesce(gap < quota.spacing(rpm) * 1e6, F.lit(False))).drop("__before")
