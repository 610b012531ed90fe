"""The stream of key states against the batch fold."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import fixed, quota
from quire.operators import keys as K
from quire.streaming import key_states

OUT = "key_id long, seq long, ts timestamp, outcome string, message string, retry_after double, rpd long"


def outcomes(n=400):
    rng = random.Random(6)
    now, rows = dt.datetime(2026, 8, 27, 12), []
    for seq in range(n):
        now += dt.timedelta(minutes=rng.choice([1, 2, 30, 200]))
        kind = rng.choices(["success", "rate_limited", "transient", "dead", "revive", "edit"], [60, 30, 5, 1, 2, 2])[0]
        rows.append((rng.randint(1, 4), seq, now, kind, rng.choice(["", "per day", "slow down"]) if kind == "rate_limited" else "m", rng.choice([None, 0.0, 42.0]), rng.randint(5, 30) if kind == "edit" else None))
    return rows


NAMES = ["key_id", "state", "used_on", "used_today", "rpd_limit", "refusals", "cooldown_until", "last_used_at", "last_error"]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def add(spark, rows, src):
    spark.createDataFrame(rows, OUT).coalesce(1).write.mode("append").parquet(src)


def run_stream(spark, src, tmp_path, name, **more):
    """Reads what is new; each start goes on from the checkpoint."""
    out = str(tmp_path / f"{name}.out")
    stream = spark.readStream.schema(OUT).option("maxFilesPerTrigger", 1).parquet(src)

    def keep(df, n):
        df.write.mode("overwrite").parquet(f"{out}/batch={n}")

    key_states.key_states(stream, 12, late="10 minutes", **more).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def latest(df):
    return df.groupBy("key_id").agg(F.max_by(F.struct("*"), F.struct("at", F.col("why") == "outcome", "seq")).alias("s")).select("s.*")


def test_stream_equals_batch_and_goes_on_from_its_checkpoint(rocks, tmp_path):
    spark, rows, src = rocks, outcomes(), str(tmp_path / "in")
    for a in range(0, 200, 100):
        add(spark, rows[a : a + 100], src)
    run_stream(spark, src, tmp_path, "cp")
    for a in range(200, 400, 100):
        add(spark, rows[a : a + 100], src)
    got = run_stream(spark, src, tmp_path, "cp").collect()
    keys = spark.createDataFrame([(k, 12) for k in range(1, 5)], "key_id long, rpd_limit long")
    # at each row of the stream, the fold of the outcomes so far, expired by then
    checked = {"outcome": 0, "midnight": 0, "cooldown": 0}
    for r in [r for r in got if r.seq >= 0 and r.why in checked]:
        checked[r.why] += 1
        if checked[r.why] > 4:
            continue
        before = [x for x in rows if x[0] == r.key_id and x[1] <= r.seq]
        want = K.fold_outcomes(keys.filter(F.col("key_id") == r.key_id), spark.createDataFrame(before, OUT))
        if r.why != "outcome":
            want = K.expire(want, r.at, quota.quota_day(F.timestamp_seconds(F.lit(r.at)).cast("timestamp_ntz")))
        w = want.withColumn("used_on", F.col("used_on").cast("string")).select(*NAMES).first()
        assert tuple(r[c] for c in NAMES) == tuple(w), r.why
    assert checked["outcome"] and checked["midnight"]


def test_a_key_without_outcomes_rolls_over_at_midnight(rocks, tmp_path):
    """Key 1 spends its allowance and is heard of no more; key 2 moves the time on, over two midnights."""
    spark, src = rocks, str(tmp_path / "in")
    noon = dt.datetime(2026, 8, 27, 19)  # 12:00 where quotas reset
    add(spark, [(1, n, noon + dt.timedelta(minutes=n), "success", "", None, None) for n in range(12)], src)
    add(spark, [(2, 100, noon + dt.timedelta(hours=1), "success", "", None, None), (3, 101, noon + dt.timedelta(hours=1), "dead", "gone", None, None), (4, 102, noon + dt.timedelta(hours=1), "transient", "busy", None, None)], src)
    first = run_stream(spark, src, tmp_path, "cp")
    assert {r.key_id: r.state for r in latest(first).collect()} == {1: "exhausted", 2: "active", 3: "dead", 4: "cooldown"}
    add(spark, [(2, 102, noon + dt.timedelta(hours=13), "success", "", None, None)], src)  # the next day, 01:00
    add(spark, [(2, 103, noon + dt.timedelta(hours=14), "success", "", None, None)], src)
    again = run_stream(spark, src, tmp_path, "cp")
    rolled = [r for r in again.collect() if r.key_id == 1 and r.why == "midnight"]
    cooled = [r for r in again.collect() if r.key_id == 4 and r.why == "cooldown"]
    assert [(r.state, r.last_error, r.at - r.last_used_at) for r in cooled] == [("active", "", fixed.TRANSIENT_COOLDOWN)]
    midnight = dt.datetime(2026, 8, 28, 7, tzinfo=dt.timezone.utc).timestamp()
    assert [(r.state, r.used_today, r.used_on, r.at, r.seq) for r in rolled] == [("active", 0, "2026-08-28", midnight, 11)]
    add(spark, [(2, 104, noon + dt.timedelta(hours=40), "success", "", None, None)], src)
    add(spark, [(2, 105, noon + dt.timedelta(hours=41), "success", "", None, None)], src)
    last = run_stream(spark, src, tmp_path, "cp").collect()
    assert [r.at - midnight for r in last if r.key_id == 1 and r.why == "forgotten"] == [86400.0]  # a whole day without an outcome
    assert {r.key_id: r.state for r in latest(spark.read.parquet(str(tmp_path / "cp.out"))).collect()}[3] == "dead"


def test_a_stream_goes_on_from_a_batch(rocks, tmp_path):
    spark, src = rocks, str(tmp_path / "in")
    noon = dt.datetime(2026, 8, 27, 19)
    rows = [(1, n, noon + dt.timedelta(minutes=n), "success", "", None, None) for n in range(8)]
    keys = spark.createDataFrame([(1, 12)], "key_id long, rpd_limit long")
    folded = K.fold_outcomes(keys, spark.createDataFrame(rows[:5], OUT)).withColumns({"seq": F.lit(4).cast("long"), "at": F.col("last_used_at")})
    add(spark, rows[5:], src)
    got = run_stream(spark, src, tmp_path, "cp", initial=folded)
    want = K.fold_outcomes(keys, spark.createDataFrame(rows, OUT)).withColumn("used_on", F.col("used_on").cast("string"))
    assert [tuple(r) for r in latest(got).select(*NAMES).collect()] == [tuple(r) for r in want.select(*NAMES).collect()]


def test_midnights_where_clocks_change():
    assert key_states.day_at(dt.datetime(2026, 3, 8, 9, tzinfo=dt.timezone.utc).timestamp(), "America/Los_Angeles") == ("2026-03-08", dt.datetime(2026, 3, 9, 7, tzinfo=dt.timezone.utc).timestamp())
    assert key_states.day_at(dt.datetime(2026, 11, 1, 7, tzinfo=dt.timezone.utc).timestamp(), "America/Los_Angeles") == ("2026-11-01", dt.datetime(2026, 11, 2, 8, tzinfo=dt.timezone.utc).timestamp())


def test_dead_keys_only_answer_to_hands():
    dead = key_states.Key(state="dead", used_on="d")
    assert key_states.advance(dead, "success", 1.0, "e") == dead
    assert key_states.advance(dead, "revive", 1.0, "d").state == "active"
