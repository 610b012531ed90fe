"""Running sums and maxima over ranges: groups larger than a range, groups of one row, ties of values."""

import datetime as dt
import random

from quire.operators import keys as K, numbering
from quire.operators.numbering import dealt, ranged, running, split_by


def test_running_equals_a_plain_one(spark):
    rng = random.Random(2)
    rows = [("hot", k, rng.randrange(5), rng.choice([None, rng.randrange(99)])) for k in range(700)] + [(f"g{k % 40}", k, rng.randrange(5), rng.randrange(99)) for k in range(400)] + [(None, k, 1, None) for k in range(5)]
    df = spark.createDataFrame(rows, "g string, k long, n long, top long").repartition(4)
    assert df.transform(lambda d: ranged(d, ["g", "k"])).select("__range").distinct().count() > 30
    got = {(r.g, r.k): (r.s, r.m) for r in running(df, ["g"], ["k"], {"s": "n"}, {"m": "top"}).collect()}
    sums, tops = {}, {}
    assert len(got) == len(rows)
    for g, k, n, top in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        sums[g] = sums.get(g, 0) + n
        tops[g] = max([x for x in (tops.get(g), top) if x is not None], default=None)
        assert got[g, k] == (sums[g], tops[g]), (g, k)
    assert running(df.limit(0), ["g"], ["k"], {"s": "n"}).count() == 0


def test_one_key_with_most_outcomes(spark):
    rng = random.Random(7)
    rows = [(1, s, rng.choice(["success", "rate_limited", "rate_limited", "transient"])) for s in range(900)] + [(k, s, "rate_limited") for k in range(2, 30) for s in range(3)]
    o = spark.createDataFrame(rows, "key_id long, seq long, outcome string").repartition(5)
    want = {(r.key_id, r.seq): r.run for r in K.refusals_in_a_row(o).collect()}
    assert {(r.key_id, r.seq): r.run for r in K.refusals_by_ranges(o).collect()} == want


def test_the_fold_of_a_key_over_ranges(spark):
    """Every kind of outcome, over many days, most of one key: equal to the fold that holds a key's outcomes in order."""
    rng, now, rows = random.Random(11), dt.datetime(2026, 3, 1, 12), []
    for seq in range(1500):
        now += dt.timedelta(minutes=rng.choice([1, 2, 2, 5, 30, 200]))
        kind = rng.choices(["success", "rate_limited", "transient", "dead", "revive", "edit"], [62, 30, 3, 0.4, 1.5, 2])[0]
        if seq % 200 > 170:  # refusals in a row, so that limits are learned
            kind = "rate_limited"
        rows.append((rng.choices([1, 2, 3, 4, 5], [70, 10, 10, 5, 5])[0], seq, now, kind, rng.choice(["", "per day", "slow down", None]) if kind == "rate_limited" else "m", rng.choice([None, 0.0, 42.0, 900.0]), rng.randint(5, 40) if kind == "edit" else None))
    keys = spark.createDataFrame([(k, 30 if k < 4 else 12) for k in range(1, 8)], "key_id long, rpd_limit long")
    schema = "key_id long, seq long, ts timestamp, outcome string, message string, retry_after double, rpd long"
    names = ["key_id", *K.STATE_FIELDS]
    learned = 0
    for n in (1500, 1180, 391, 60, 0):
        o = spark.createDataFrame(rows[:n], schema).repartition(4)
        want = sorted(tuple(r) for r in K.fold_outcomes(keys, o).select(*names).collect())
        assert sorted(tuple(r) for r in K.fold_by_ranges(keys, o).select(*names).collect()) == want
        learned += sum(r[4] not in (12, 30) for r in want)
    assert learned


def test_a_range_is_found_by_halving(spark):
    df = spark.range(500).repartition(3).withColumnRenamed("id", "k")
    cut = ranged(df, ["k"])
    assert cut._jdf.queryExecution().optimizedPlan().toString().count(">=") == 1  # not one for each cut
    found = sorted((r["k"], r["__range"]) for r in cut.collect())
    assert [r for _, r in found] == sorted(r for _, r in found) and {r for _, r in found} == set(range(64))


def test_rows_are_dealt_in_order(spark):
    rows = [(None, k) for k in range(9)] + [(k // 100, k) for k in range(600)]
    cut = dealt(spark.createDataFrame(rows, "g long, k long").repartition(5), ["g", "k"])
    found = sorted((r["__range"], -1 if r.g is None else r.g, r.k) for r in cut.collect())
    assert [r[1:] for r in found] == sorted((-1 if g is None else g, k) for g, k in rows) and len({r[0] for r in found}) > 30
    assert cut.filter(split_by(cut, "g")).filter("g IS NOT NULL").count() == 600
    single = dealt(spark.createDataFrame([(k, 0) for k in range(100)], "g long, k long"), ["g", "k"])
    assert split_by(single, "g") is None


def test_a_fold_deals_its_outcomes_once(spark, monkeypatch):
    """One table, whatever is carried on, and equal to the other fold: where a key isn't known, an edit has no limit, keys are in several ranges."""
    start, made = dt.datetime(2026, 3, 1, 12), []
    kinds = [*["success"] * 11, "edit", *["rate_limited"] * 5, "dead", "transient", "revive"]
    rows = [(k, s, start + dt.timedelta(minutes=20 * s), kinds[(s + k) % len(kinds)], "m", None, 30 if s % 3 else None) for k in range(6) for s in range(90 + k)]
    o = spark.createDataFrame(rows, "key_id long, seq long, ts timestamp, outcome string, message string, retry_after double, rpd long").repartition(4)
    keys = spark.createDataFrame([(k, 12) for k in (0, 1, 2, 4, 5, 9)], "key_id long, rpd_limit long")
    keep = numbering.written
    monkeypatch.setattr(numbering, "written", lambda df, name: made.append(name) or keep(df, name))
    names = ["key_id", *K.STATE_FIELDS]
    got = K.fold_by_ranges(keys, o)
    want = sorted((tuple(r) for r in K.fold_outcomes(keys, o).select(*names).collect()), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want and len(want) == 6
    assert made == ["dealt"]
