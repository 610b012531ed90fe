"""Keys: the fold of outcomes, windows, acquisition, capacity, leases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.functions import quota
from quire.operators import keys as K

T0 = dt.datetime(2026, 8, 27, 19, 0, 0)  # noon where quotas reset
OUT = "key_id long, seq long, ts timestamp, outcome string, message string, retry_after double, rpd long"


def fold(spark, limit, *outcomes):
    rows = []
    for i, o in enumerate(outcomes):
        kind, more = (o, {}) if isinstance(o, str) else o
        rows.append((1, i, more.get("ts", T0 + dt.timedelta(seconds=i)), kind, more.get("message", ""), more.get("retry_after"), more.get("rpd")))
    keys = spark.createDataFrame([(1, limit)], "key_id long, rpd_limit long")
    return K.fold_outcomes(keys, spark.createDataFrame(rows, OUT)).first()


LIMITED = "rate_limited"


def test_exhaustion_and_rollover(spark):
    s = fold(spark, 3, *["success"] * 3)
    assert (s.state, s.used_today, s.last_error) == ("exhausted", 3, "Daily allowance spent")
    next_day = ("success", {"ts": T0 + dt.timedelta(days=1)})
    assert (lambda s: (s.state, s.used_today))(fold(spark, 3, *["success"] * 3, next_day)) == ("active", 1)
    assert fold(spark, 3, "dead", next_day).state == "dead"


def test_refusals(spark):
    assert fold(spark, 100, (LIMITED, {"message": "GenerateRequestsPerDayPerProject"})).state == "exhausted"
    s = fold(spark, 100, (LIMITED, {"message": "Too many requests"}))
    assert s.state == "cooldown" and s.cooldown_until - T0.timestamp() - s.last_used_at + T0.timestamp() == pytest.approx(15)
    s = fold(spark, 100, (LIMITED, {"retry_after": 42.0}))
    assert s.cooldown_until - s.last_used_at == pytest.approx(42) and s.last_error == "Rate limited, waiting 42s"
    assert fold(spark, 100, LIMITED, "success", LIMITED).refusals == 1


def test_limit_is_learned_only_after_enough_requests(spark):
    s = fold(spark, 5000, *["success"] * 12, *[LIMITED] * 4)
    assert (s.state, s.rpd_limit) == ("exhausted", 12) and "learned" in s.last_error
    s = fold(spark, 250, *["success"] * 2, *[LIMITED] * 4)
    assert (s.state, s.rpd_limit) == ("exhausted", 250) and "only 2" in s.last_error
    s = fold(spark, 250, *["success"] * 2, *[LIMITED] * 4, ("success", {"ts": T0 + dt.timedelta(days=1)}))
    assert (s.state, s.refusals) == ("active", 0)


def test_dead_is_terminal_for_automatic_outcomes(spark):
    for outcome in ("transient", LIMITED, "success"):
        s = fold(spark, 10, "dead", outcome)
        assert (s.state, s.used_today) == ("dead", 0)
    assert fold(spark, 10, ("dead", {"message": "API_KEY_INVALID"}), "revive").state == "active"
    assert fold(spark, 2, "success", "success", ("edit", {"rpd": 5})).state == "active"
    assert fold(spark, 10, "transient").cooldown_until > 0


def test_key_without_outcomes(spark):
    keys = spark.createDataFrame([(7, 5)], "key_id long, rpd_limit long")
    s = K.fold_outcomes(keys, spark.createDataFrame([], OUT)).first()
    assert (s.state, s.used_today, s.rpd_limit, s.used_on) == ("active", 0, 5, None)


KEY = "key_id long, label string, secret string, rpm_limit int, rpd_limit long, state string, enabled boolean, used_today long, cooldown_until double, last_used_at double"


def keys(spark, n, **over):
    base = {"rpm_limit": 0, "rpd_limit": 2, "state": "active", "enabled": True, "used_today": 0, "cooldown_until": 0.0, "last_used_at": 0.0}
    rows = [{"key_id": i, "label": f"k{i:02}", "secret": f"secret{i:04}", **base, **over.get(f"k{i}", {})} for i in range(1, n + 1)]
    return spark.createDataFrame([tuple(r[f.split(" ")[0]] for f in KEY.split(", ")) for r in rows], KEY)


def window(df):
    return [r.key_id for r in K.working_set(df).collect()]


def test_window_moves_up(spark):
    assert window(keys(spark, 8)) == [1, 2, 3, 4, 5]
    assert window(keys(spark, 8, k2={"enabled": False})) == [1, 3, 4, 5, 6]
    spent = {"used_today": 2, "state": "exhausted"}
    rotated = keys(spark, 10, k1=spent, k2=spent)
    assert window(rotated) == [3, 4, 5, 6, 7]
    c = K.capacity(rotated).first()
    assert (c.keys_total, c.keys_live, c.keys_in_use, c.used_today, c.remaining_today) == (10, 10, 5, 4, 16)
    assert window(keys(spark, 3, k1={"state": "cooldown", "cooldown_until": 9e9})) == [1, 2, 3]


def test_acquire_rotates_and_paces(spark):
    df, got = keys(spark, 3), []
    for now in (1.0, 2.0, 3.0):
        k = K.acquire(df, now).first()
        got.append(k.key_id)
        df = df.withColumn("last_used_at", F.when(F.col("key_id") == k.key_id, now).otherwise(F.col("last_used_at")))
    assert got == [1, 2, 3]
    paced = keys(spark, 1, k1={"rpm_limit": 60, "last_used_at": 100.0})
    assert K.acquire(paced, 100.2).count() == 0
    assert K.next_available_in(paced, 100.2).first().seconds == pytest.approx(0.8)
    dead = keys(spark, 2, k1={"state": "dead"}, k2={"state": "dead"})
    assert K.acquire(dead, 1.0).count() == 0 and K.next_available_in(dead, 1.0).first().seconds is None
    assert K.capacity(dead).first().has_live_keys is False
    assert K.capacity(dead.limit(0)).first().remaining_today == 0


def test_expire(spark):
    df = keys(spark, 3, k1={"state": "cooldown", "cooldown_until": 5.0}, k2={"used_today": 2}, k3={"state": "exhausted", "used_today": 2})
    df = df.withColumns({"used_on": F.lit("2026-01-01").cast("date"), "refusals": F.lit(1), "last_error": F.lit("e")})
    same = {r.key_id: r for r in K.expire(df, 6.0, F.lit("2026-01-01").cast("date")).collect()}
    assert [same[i].state for i in (1, 2, 3)] == ["active", "exhausted", "exhausted"]
    later = {r.key_id: r for r in K.expire(df, 6.0, F.lit("2026-01-02").cast("date")).collect()}
    assert [(later[i].state, later[i].used_today) for i in (1, 2, 3)] == [("active", 0)] * 3


def test_leases_take_turns(spark):
    pages = spark.range(10).select(F.lit(1).cast("long").alias("book_id"), F.col("id").alias("page_no"))
    got = K.lease(pages, keys(spark, 3, k1={"rpd_limit": 3}, k3={"rpd_limit": 1})).orderBy("page_no").collect()
    assert [(r.page_no, r.key_id) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 1), (4, 2), (5, 1)]


def test_upsert_and_entries(spark):
    k = keys(spark, 2, k1={"enabled": False, "used_today": 2})
    entries = spark.createDataFrame([("k01", "new", 5, 9), ("z", "s", 1, 1)], "label string, secret string, rpm_limit int, rpd_limit long")
    got = {r.label: r for r in K.upsert_keys(k, entries).collect()}
    assert (got["k01"].secret, got["k01"].used_today, got["k01"].enabled, got["k01"].rpd_limit) == ("new", 2, True, 9)
    assert got["z"].key_id == 3 and got["k02"].secret == "secret0002"
    good, bad = K.valid_entries(spark.createDataFrame([(" a ", "s", -3, 0), ("", "s", 1, 1), ("b", None, 1, 1)], "label string, secret string, rpm_limit int, rpd_limit int"))
    assert [(r.label, r.rpm_limit, r.rpd_limit) for r in good.collect()] == [("a", 0, 1)] and bad.count() == 2
    shown = K.snapshot(k, 1.0).filter("key_id = 1").first()
    assert shown.secret == "…0001" and shown.in_use is False and shown.remaining == 0


def test_quota_days_and_resets(spark):
    rows = [("2026-08-28 00:00:00", "2026-08-27"), ("2026-08-28 08:30:00", "2026-08-28")]
    got = spark.createDataFrame(rows, "t string, day string").select(quota.quota_day(F.col("t").cast("timestamp_ntz")).cast("string").alias("got"), "day").collect()
    assert all(r.got == r.day for r in got)
    wall, elapsed = quota.seconds_to_reset(F.col("t").cast("timestamp_ntz"))
    r = spark.createDataFrame([("2026-03-08 08:30:00",)], "t string").select(wall.alias("w"), elapsed.alias("e")).first()
    assert (r.w, r.e) == (84600, 81000)  # half past midnight on the day clocks go forward
