"""The source schedule, periodic runs and the band join against brute-force versions, on odd and ordinary rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import band_join, periodic_runs, source_schedule
from quire.llm.training_order import Permutation

SF = "/root/testdata/sf0.001"
CLASH = ("number", "row", "at", "block", "prefix", "u", "mark", "lines", "runs", "n", "of", "part", "p")
DOC = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASH)


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], DOC).repartition(3)


# --- op11


def mixed_plainly(rows, weights, share, most, block, seed):
    """Taken words of each (key, doc) in plain Python; ``rows``: (place, name, source, size)."""
    names = sorted({r[2] for r in rows if r[2] is not None}) + ([None] if any(r[2] is None for r in rows) else [])
    size = Counter()
    for r in rows:
        size[r[2]] += r[3]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), Fraction(share) * sum(size.values())
    while free:
        level = budget / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > most * size[s]}
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: Fraction(most * size[s]) for s in above}
        budget -= sum(target[s] for s in above)
        free -= above
    visits = {}  # per source the words of its blocks in order of their turns
    stream = {}
    for number, s in enumerate(names):
        words = int(target[s] + Fraction(1, 2))
        stream[s] = [i for i, r in sorted(((i, r) for i, r in enumerate(rows) if r[2] == s), key=lambda x: (x[1][0], x[1][1], x[0])) for _ in range(r[3])]
        blocks = [stream[s][k : k + block] for k in range(0, size[s], block)]
        visits[s], turn = [], 0
        while words > 0:
            for k in Permutation(len(blocks), [seed, number, turn]).numbers(np.arange(len(blocks))):
                if words > 0:
                    visits[s].append(blocks[k][:words])
                    words -= len(visits[s][-1])
            turn += 1
    slots = sum(map(len, visits.values()))
    edges, at = [], 0
    for s in names:
        edges.append((at, at + len(visits[s]), s))
        at += len(visits[s])
    order, used = [], Counter()
    for i in range(slots):
        x = Fraction(int(f"{i:053b}"[::-1], 2), 2**53) * slots
        s = next(s for a, b, s in edges if a <= x < b)
        if used[s] < len(visits[s]):
            order.append((i, s, visits[s][used[s]]))
        used[s] += 1
    late = slots
    for s in names:
        for part in visits[s][used[s] :]:
            order.append((late, s, part))
            late += 1
    return target, order


def check_mix(spark, docs, block, weights=(5, 2, 1), share=1.5, most=2.0, seed=3):
    mixed = source_schedule.mix(docs, weights=weights, share=share, most=most, block=block, seed=seed)
    name = F.col("doc_id").cast("string")
    rows = [(r.h, r.name or "", r.source, r.n, r.doc_id) for r in docs.select("doc_id", name.alias("name"), "source", F.xxhash64(F.lit(seed), name, "text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(source_schedule.WORD)), F.lit(0)).alias("n")).collect()]
    target, order = mixed_plainly(rows, weights, share, most, block, seed)
    got = source_schedule.taken_words(mixed).collect()
    size = Counter()
    for r in rows:
        size[r[2]] += r[3]
    taken = Counter(i for _, _, words in order for i in words)
    want = sorted(((r[4], r[3], size[r[2]], taken[i]) for i, r in enumerate(rows)), key=repr)
    assert sorted(((r.doc_id, r["size"], r.source_size, r.taken) for r in got), key=repr) == want
    assert all(r.taken <= most * r["size"] for r in got)
    by_source = {r.source: r for r in mixed.sources.collect()}
    for s, t in target.items():
        assert by_source[s].target == pytest.approx(float(t))
        assert abs(sum(taken[i] for i, r in enumerate(rows) if r[2] == s) - t) <= 0.5
    # each slot has the words of its turn
    slots = defaultdict(Counter)
    for r in source_schedule.slices(mixed).collect():
        slots[r.slot][r.doc_id] += r.n_words
    assert slots == {i: Counter(rows[k][4] for k in words) for i, _, words in order}
    return got, order


def test_mix_equals_a_plain_one(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 90]))), rng.choice(["a", "a", "a", "b", "é", "z", None, "\U0001f600"])) for i in range(150)]
    rows += [(1000, None, "a"), (None, "no id here", "b"), (1001, "", "only empty"), (7, "same same", "b"), (7, "same same", "b"), (1002, "x\x85y z\x1cq " * 300, "b")]
    docs = documents(spark, rows)
    got, order = check_mix(spark, docs, 16)
    again = source_schedule.taken_words(source_schedule.mix(docs.repartition(5), block=16, seed=3)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)
    # sources lie evenly: any stretch has each near its share
    every = Counter(s for _, s, _ in order)
    for a in range(0, len(order) - 64, 37):
        part = Counter(s for i, s, _ in order if a <= i < a + 64)
        assert all(abs(part[s] - 64 * every[s] / len(order)) <= 8 for s in every)


def test_mix_of_one_source_and_of_none(spark):
    one = documents(spark, [(i, "a b c d e f g", None) for i in range(10)])
    check_mix(spark, one, 1024)
    check_mix(spark, one, 1, share=0.3)
    assert source_schedule.taken_words(source_schedule.mix(one.limit(0))).count() == 0
    empty = documents(spark, [(1, "", "a"), (2, None, "b")])
    assert [(r.taken, r.target) for r in source_schedule.taken_words(source_schedule.mix(empty)).collect()] == [(0, 0.0)] * 2
    with pytest.raises(ValueError, match="more is asked"):
        source_schedule.mix(one, share=3.0)


def test_points_below_a_bound():
    i = np.arange(300)
    x = source_schedule.mirrored(i)
    for bound in (0, 1, 2**40, 2**52, 3 * 2**51, 2**53):
        want = [int((x[:k] < bound).sum()) for k in i]
        assert source_schedule.points_below(i, np.full(300, bound)).tolist() == want


# --- op12


def runs_plainly(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            b = words[i : i + q]
            if j - i + q >= max(6, 4 * q) and not any(q % r == 0 and b[r:] + b[:r] == b for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng, found = random.Random(5), 0
    for _ in range(1500):
        n, k = rng.randrange(0, 90), rng.choice([1, 2, 2, 3, 5, 30])
        w = [b"%d" % rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randrange(3) if n else 0):
            a, p = rng.randrange(n), rng.randrange(1, 8)
            for i in range(a + p, a + rng.randrange(n - a + 1)):
                w[i] = w[i - p]
        want = runs_plainly(w)
        found += len(want)
        assert [tuple(r) for r in periodic_runs.runs_of(w)] == want
        # without the search for stretches the automaton finds the same
        assert sorted((tuple(r) for r in periodic_runs.runs_within(w, 0)), key=lambda r: (r[0], r[2])) == want
    assert found > 500


def digest_plainly(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = [w.decode() for w in periodic_runs.planted(key, [w.encode() for w in words])]
    runs = runs_plainly(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (key, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark):
    line = "the same line again\n"
    rows = [(None, "a " * 20, None), (1, None, "s"), (2, "", "s"), (3, line * 9, "s"), (3, line * 9, "s"), (4, "x\x85 " * 7 + "y", "s"), (5, "a b c d e " * 4000, "s"), (6, "one", "s"), (7, "\x1c é é é é é é\n\n", "s")]
    rows += [(100 + i, " ".join(random.Random(i).choice("abc") for _ in range(60)), "s") for i in range(40)]
    docs = documents(spark, rows)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = periodic_runs.digest(periodic_runs.periodic_runs(docs, prepare=periodic_runs.planted))
    assert got.columns == names
    plain = {r[0]: digest_plainly(*r[:2]) for r in rows if r[0] != 5}
    collected = got.collect()
    assert sorted(str(r.doc_id) for r in collected) == sorted(str(r[0]) for r in rows)
    for r in collected:
        assert r.doc_id == 5 or tuple(r) == plain[r.doc_id]
        assert r.doc_id != 5 or (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 20000, 5, 4000000)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.collapsed for r in periodic_runs.periodic_runs(docs).collect()}
    assert kept[3] == line.strip() and kept[5] == "a b c d e" and kept[1] == ""


# --- op13


def joined_plainly(items, lines, k, near, per_mille):
    from zlib import crc32

    points = []
    for sale, place, item, q, amount in lines:
        if None not in (sale, item, q, amount) and q:
            a = int(np.floor(100 * amount + 0.5))
            points.append((sale, place, item, Fraction(2 * a + q, 2 * q).__floor__(), crc32(f"{sale},{'' if place is None else place},{item}".encode())))
    out = []
    for item, price in items:
        pairs = []
        if price is not None:
            p = int(np.floor(100 * price + 0.5))
            pairs = sorted(((abs(u - p), u, s, -1 if n is None else n, i, crc) for s, n, i, u, crc in points if i != item and (abs(u - p) <= near or 1000 * abs(u - p) <= per_mille * p)))
        sums = (len(pairs), sum(x[0] for x in pairs), sum(x[5] for x in pairs))
        out += [(item, r, x[0], x[1], x[2], None if x[3] < 0 else x[3], x[4], *sums) for r, x in enumerate(pairs[:k], 1)] or [(item, 0, *[None] * 5, *sums)]
    return sorted(out, key=repr)


ITEM = "item_id long, price double, " + ", ".join(f"{c} string" for c in CLASH)
SALE = "sale_id long, line_no int, item_id long, quantity int, amount double, " + ", ".join(f"{c} string" for c in CLASH)


def test_near_prices_equal_a_plain_join(spark):
    rng = random.Random(8)
    prices = [0.0, 0.05, 3.0, 3.0, 3.07, 9.99, 10.0, 99.9, 100.0, 123.45, 999.99, 1000.0, 10050.5, 99999.0, 1e6, -2.0, None]
    items = [(i, rng.choice(prices)) for i in range(60)] + [(None, 3.0), (5, 3.0), (5, 3.0), (6, 100.0)]
    lines = [(rng.randrange(20), rng.choice([1, 2, None]), rng.choice([5, 5, 5, rng.randrange(60)]), q := rng.choice([1, 2, 3, 7]), 0.0 + q * ((rng.choice(prices) or 0) * rng.choice([1, 1, 1.001, 0.998, 1.003])) + rng.choice([0, 0.01, 0.03, -0.1])) for _ in range(900)]
    lines += lines[:30] + [(None, 1, 1, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 1, None, 3.0), (1, 1, 1, 1, None), (1, 1, 1, 0, 3.0), (1, 1, 2, -1, -3.0)]
    a = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in items], ITEM).repartition(2)
    b = spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in lines], SALE).repartition(3)
    for k, near, per_mille in ((5, 10, 2), (1, 0, 0), (3, 2, 50)):
        got = sorted(map(tuple, band_join.near_prices(a, b, k, near, per_mille).collect()), key=repr)
        assert got == joined_plainly(items, lines, k, near, per_mille)
    none = band_join.near_prices(a, b.limit(0)).collect()
    assert len(none) == len(items) and all((r.rank, r.n_pairs, r.gap) == (0, 0, None) for r in none)
    assert band_join.near_prices(a.limit(0), b).count() == 0


def test_prices_that_are_no_numbers(spark):
    items = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 3.0)], "item_id long, price double")
    lines = spark.createDataFrame([(1, 1, 9, 1, float("nan")), (1, 2, 9, 1, 1e300), (1, 3, 9, 1, 3.0)], "sale_id long, line_no int, item_id long, quantity int, amount double")
    got = {r.item_id: (r.rank, r.n_pairs, r.line_no) for r in band_join.near_prices(items, lines).collect()}
    assert got == {1: (0, 0, None), 2: (0, 0, None), 3: (1, 1, 3)}


def test_prefixes_are_in_order_and_of_the_same_digits(spark):
    values = [-(10**7), -12345, -10001, -10000, -101, -100, -99, -1, 0, 1, 99, 100, 9999, 10000, 10099, 10100, 99999, 100000, 100999, 101000, 10**9]
    got = [r.x for r in spark.createDataFrame([(v,) for v in values], "u long").select("u", band_join.prefix_of(F.col("u")).alias("x")).orderBy("u").collect()]
    assert got == sorted(got)
    floor = [v // 10 ** band_join.low_digits(v) for v in values]
    for i in range(len(values) - 1):
        same = floor[i] == floor[i + 1] and band_join.low_digits(values[i]) == band_join.low_digits(values[i + 1])
        assert (got[i] == got[i + 1]) == same


def test_trie_descents():
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(1000, 140, replace=False)).astype(np.int64)
    n, marks = rng.integers(1, 9, 140), rng.integers(0, 99, 140)
    trie = band_join.Trie(at, n, marks, 3)
    x = np.arange(-3, 1200)
    want = [[int(s[at <= v].sum()) for v in x] for s in (n, n * at, marks)]
    assert trie.up_to(x).tolist() == want
    for p in (-5, 0, 333, 999, 1500):
        assert [(g, int(at[i])) for g, i in trie.nearest(p, p - 60, p + 300)] == sorted((abs(int(v) - p), int(v)) for v in at if p - 60 <= v <= p + 300)
