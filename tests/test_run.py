"""The whole run against a stub client: refusals, dead keys, time-outs, answers that aren't JSON, and a run that dies."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import classify, quota
from quire.operators import export, keys as K, numbering, publish, queue
from quire.sources import buckets, commits, files, store
from quire.streaming import profiles, run

START = 1_700_000_000.0


def client():
    """A function of its own, so that workers needn't import this module."""
    import json

    def answer(row):
        """Page 3 times out at first, page 4 is never JSON, page 5 is flagged, key 2 is refused, key 3 is dead."""
        page, key = row["page_no"], row["key_id"]
        mark = f"{row['secret']}/{row['book_id']}-{page}"
        import os

        with open(f"{row['secret']}/calls", "a") as f:
            f.write(f"{key} {row['book_id']} {page}\n")
        if key == 3:
            return row | {"status": 403, "body": '{"error":{"status":"PERMISSION_DENIED"}}', "headers": {}}
        if key == 2:
            return row | {"status": 429, "body": "quota per day", "headers": {"RETRY-after": "7"}}
        if page == 3 and not os.path.exists(mark):
            open(mark, "w").close()
            raise TimeoutError("no answer in time")
        if page == 4:
            raise ValueError("not JSON: <html>")
        text = "short" if page == 5 else f"The whole text of page {page}, long enough."
        result = json.dumps({"page_type": "text", "transcription": text})
        body = {"steps": [{"type": "model_output", "content": [{"type": "text", "text": f"```json\n{result}\n```"}]}], "usage": {"input_tokens": 12.7, "output_tokens": 3}}
        return row | {"status": 200, "body": json.dumps(body), "headers": {}}

    return answer


def clock_at(start=START):
    """A clock that only waiting moves. Of no module, so that tasks get copies that go on from the driver's time."""

    class Clock:
        now = start

        def __call__(self):
            return self.now

        def wait(self, seconds):
            self.now += seconds

    return Clock()


def follows(clock, also=lambda what, number, rows: None):
    """A ``log`` that takes the driver's clock to the last call of a batch."""

    def hear(what, number, rows):
        if what == "results":
            clock.now = max(clock.now, rows.agg(F.max("called_at")).first()[0] or 0.0)
        also(what, number, rows)

    return hear


KEYS = "key_id long, secret string, rpm_limit int, rpd_limit long, enabled boolean"


def answered():
    """Every page is read."""
    import json

    def answer(row):
        result = json.dumps({"page_type": "text", "transcription": f"The whole text of page {row['page_no']} by {row['secret']}."})
        body = {"steps": [{"type": "model_output", "content": [{"type": "text", "text": result}]}], "usage": {"input_tokens": 1, "output_tokens": 2}}
        return {"status": 200, "body": json.dumps(body), "headers": {}}

    return answer


def outcomes_in(spark, folder):
    return run.Folder(spark, folder).log("outcomes", run.OUTCOME)


def test_a_run_to_the_end(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    pages = spark.createDataFrame([*((1, p) for p in range(1, 6)), (2, 1)], "book_id long, page_no int")
    keys = spark.createDataFrame([(k, str(tmp_path), 0, 50 if k != 4 else 4, True) for k in (1, 2, 3, 4)], KEYS)
    run.start(spark, folder, pages, START, bucket_pages=4)
    run.start(spark, folder, pages.limit(1), START)  # it has a queue
    clock, heard = clock_at(), Counter()

    def dies(what, number, rows):
        heard[what] += 1
        if what == "results" and heard[what] == 2:
            raise RuntimeError("the driver is lost")

    with pytest.raises(RuntimeError):
        run.run_queue(spark, folder, keys, client(), clock, clock.wait, calls_a_key=1, log=follows(clock, dies))
    before = (tmp_path / "calls").read_text().splitlines()
    assert run.progress(spark, folder)["batches_out"] == 1
    clock.now += 1
    assert run.run_queue(spark, folder, keys, client(), clock, clock.wait, calls_a_key=2, stop=lambda: True) == "stopped"
    assert (tmp_path / "calls").read_text().splitlines() == before  # the answers that were there counted
    run.cancel(spark.newSession(), folder)
    assert run.run_queue(spark, folder, keys, client(), clock, clock.wait) == "cancelled"
    run.cancel(spark, folder, on=False)
    assert run.run_queue(spark, folder, keys, client(), clock, clock.wait, calls_a_key=2, log=follows(clock, lambda w, b, r: heard.update([w]))) == "done"
    calls = (tmp_path / "calls").read_text().splitlines()
    assert calls[: len(before)] == before and heard["outcomes"] == heard["changes"] >= 3 and heard["keys"] >= 3
    assert run.progress(spark, folder) == {"pending": 0, "in_progress": 0, "done": 4, "flagged": 1, "failed": 1, "total": 6, "batches_out": 0}

    got = {(r.book_id, r.page_no): r for r in run.pages_of(spark, folder).collect()}
    assert len(got) == 6 and {r.status for r in got.values()} == {"done", "flagged", "failed"}
    for (_, p), r in got.items():
        assert (r.status, r.attempts) == {4: ("failed", 3), 5: ("flagged", 0)}.get(p, ("done", 0))
        assert p in (4, 5) or (r.transcription == f"The whole text of page {p}, long enough." and (r.input_tokens, r.output_tokens) == (12, 3))
        assert p != 4 or (r.last_error.startswith("not JSON") and r.transcription is None)
    # every call is one outcome of its key
    outcomes = outcomes_in(spark, folder).collect()
    assert Counter(o.key_id for o in outcomes) == Counter(int(c.split()[0]) for c in calls)
    state = {r.key_id: r for r in states_in(spark, folder)}
    assert state[3].state == "dead" and state[2].state == "exhausted" and state[2].used_today == 0
    assert state[4].used_today <= 4 and state[1].used_today + state[4].used_today == sum(o.outcome == "success" for o in outcomes)
    assert all(r.out == 0 for r in state.values())
    # the next day the exhausted key is handed out again, the dead one isn't
    later = clock.now + 2 * 86400
    tomorrow = quota.quota_day(F.timestamp_seconds(F.lit(later)).cast("timestamp_ntz"))
    tables = run.Folder(spark, folder)
    only = run.key_states(tables.read(run.KEYS, [tables.commits.head()[1]["keys"]]), keys).filter("key_id IN (2, 3)")
    assert K.acquire(only, later).count() == 0 and [r.key_id for r in K.acquire(only, later, day=tomorrow).collect()] == [2]


def states_in(spark, folder):
    tables = run.Folder(spark, folder)
    return tables.read(run.KEYS, [tables.commits.head()[1]["keys"]]).collect()


def test_a_run_without_usable_keys_ends(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    run.start(spark, folder, spark.createDataFrame([(1, 1)], "book_id long, page_no int"), START)
    keys = spark.createDataFrame([(3, str(tmp_path), 0, 50, True)], KEYS)
    clock = clock_at()
    assert run.run_queue(spark, folder, keys, client(), clock, clock.wait) == "no keys"
    assert [(r.status, r.attempts) for r in run.pages_of(spark, folder).collect()] == [("pending", 0)]


def test_a_run_keeps_the_pace_and_grows_with_its_changes_only(spark, tmp_path):
    """Ten calls a minute at most, in any minute; what a batch writes and keeps doesn't depend on how many came before."""
    folder, secret = f"file://{tmp_path}/run", "SECRET-of-the-key-0123456789"
    run.start(spark, folder, spark.createDataFrame([(b, p) for b in (1, 2) for p in range(1, 24)], "book_id long, page_no int"), START, bucket_pages=12)
    keys = spark.createDataFrame([(1, secret, 10, 100, True), (2, secret + "x", 7, 100, True)], KEYS)
    clock, sizes = clock_at(), []

    def size(what, number, rows):
        if what == "keys":
            files = [f for f in (tmp_path / "run").rglob("*") if f.is_file()]
            sizes.append((sum(f.stat().st_size for f in files if "/pages/" in str(f) or "/keys/" in str(f)), len(files)))

    spark.conf.set("spark.sql.parquet.compression.codec", "uncompressed")
    try:
        assert run.run_queue(spark, folder, keys, answered(), clock, clock.wait, horizon=30.0, log=follows(clock, size)) == "done"
    finally:
        spark.conf.unset("spark.sql.parquet.compression.codec")
    at = {k: sorted(o.ts.timestamp() for o in outcomes_in(spark, folder).collect() if o.key_id == k) for k in (1, 2)}
    assert len(at[1]) + len(at[2]) == 46
    for key, rpm in ((1, 10), (2, 7)):
        assert all(b - a >= 60 / rpm - 0.001 for a, b in zip(at[key], at[key][1:], strict=False))
        assert max(sum(a <= t < a + 59.99 for t in at[key]) for a in at[key]) <= rpm
        assert at[key][-1] - at[key][0] <= 60 / rpm * len(at[key]) + 31  # and it doesn't dawdle
    assert len(sizes) >= 5 and sizes[-1][0] <= 1.5 * sizes[len(sizes) // 2][0]
    for f in (tmp_path / "run").rglob("*"):
        assert not f.is_file() or secret.encode() not in f.read_bytes(), f
    texts = run.pages_of(spark, folder).filter("status = 'done'").collect()
    assert len(texts) == 46 and all(r.transcription.endswith("by ….") or r.transcription.endswith("by …x.") for r in texts)


def test_drivers_share_a_queue(spark, tmp_path):
    """Two drivers claim from one folder at once: no page is out twice, none is lost."""
    import threading

    folder = f"file://{tmp_path}/run"
    run.start(spark, folder, spark.createDataFrame([(1, p) for p in range(1, 25)], "book_id long, page_no int"), START, bucket_pages=6)
    said = {}

    def drive(name, key):
        session = spark.newSession()
        keys = session.createDataFrame([(key, f"s{key}", 0, 100, True)], KEYS)
        clock = clock_at()
        said[name] = run.run_queue(session, folder, keys, answered(), clock, clock.wait, calls_a_key=4, owner=name)

    threads = [threading.Thread(target=drive, args=(n, k)) for k, n in enumerate(("a", "b"), 1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert said == {"a": "done", "b": "done"}
    changes = run.Folder(spark, folder).log("changes", queue.CHANGE)
    assert sorted(r.page_no for r in changes.collect()) == list(range(1, 25))  # each page once
    outcomes = Counter(o.key_id for o in outcomes_in(spark, folder).collect())
    assert sum(outcomes.values()) == 24 and {r.key_id: r.used_today for r in states_in(spark, folder)} == dict(outcomes)
    numbers = run.Folder(spark, folder).commits.numbers()
    assert numbers == list(range(numbers[0], numbers[-1] + 1))


def test_pages_of_a_lost_driver_are_given_back(spark, tmp_path):
    folder = f"file://{tmp_path}/run"
    run.start(spark, folder, spark.createDataFrame([(1, p) for p in range(1, 4)], "book_id long, page_no int"), START)
    keys = spark.createDataFrame([(1, "s", 0, 3, True)], KEYS)  # too short to be told from text
    tables = run.Folder(spark, folder)
    assert run.claim(tables, keys, START, "lost", 60.0, 2, 5, 3) == ("claimed", None)
    assert run.progress(spark, folder)["in_progress"] == 2 and states_in(spark, folder)[0].out == 2
    assert run.reset_stale(spark, folder, START, START + 9) == 0
    assert run.reset_stale(spark, folder, START + 1, START + 9) == 2
    assert run.progress(spark, folder)["pending"] == 3 and states_in(spark, folder)[0].out == 0
    clock = clock_at(START + 10)
    assert run.run_queue(spark, folder, keys, answered(), clock, clock.wait) == "done"


def test_books_are_profiled_before_their_pages(spark, tmp_path):
    """Book 1 has a profile, book 2 no text pages, book 3 fails three times, book 4 is refused once; pages wait for it."""

    def profiler(path):
        import json
        import os

        def answer(row):
            book, page = row["book_id"], row["page_no"]
            with open(f"{path}/calls", "a") as f:
                f.write(json.dumps([book, page, row.get("sample_pages"), row.get("profile")]) + "\n")
            text = json.dumps({"page_type": "text", "transcription": f"Page {page} of book {book}, at some length."})
            if page == 0:
                if book == 3:
                    raise ValueError("not JSON")
                if book == 4 and not os.path.exists(f"{path}/refused"):
                    open(f"{path}/refused", "w").close()
                    return {"status": 429, "body": "slow down", "headers": {}}
                text = json.dumps({"primary_language": "Latin", "era": "unknown", "script": "latin"})
            return {"status": 200, "body": json.dumps({"steps": [{"type": "model_output", "content": [{"type": "text", "text": text}]}]}), "headers": {}}

        return answer

    folder = f"file://{tmp_path}/run"
    run.start(spark, folder, spark.createDataFrame([(b, p) for b in (1, 2, 3, 4) for p in (1, 2)], "book_id long, page_no int"), START)
    keys = spark.createDataFrame([(1, "a-secret-of-one", 0, 100, True), (2, "a-secret-of-two", 0, 100, True)], KEYS)
    samples = spark.createDataFrame([(1, [16, 17], "after front matter"), (2, [], "no text pages found"), (3, [1], "whole book (fallback)"), (4, [2], "whole book (fallback)")], "book_id long, pages array<int>, strategy string")
    clock = clock_at()
    assert run.run_queue(spark, folder, keys, profiler(str(tmp_path)), clock, clock.wait, log=follows(clock), samples=samples) == "done"
    calls = [json.loads(x) for x in (tmp_path / "calls").read_text().splitlines()]
    asked = Counter(b for b, p, _, _ in calls if p == 0)
    assert asked == {1: 1, 3: 3, 4: 2} and [s for b, p, s, _ in calls if (b, p) == (1, 0)] == [[16, 17]]
    for b in (1, 4):
        last = max(i for i, c in enumerate(calls) if c[:2] == [b, 0])
        assert all(i > last and json.loads(c[3]) == {"primary_language": "Latin", "era": "", "script": "latin"} for i, c in enumerate(calls) if c[0] == b and c[1] > 0)
    assert {c[3] for c in calls if c[0] == 2} == {"{}"} and {c[3] for c in calls if c[0] == 3 and c[1]} == {None}
    assert run.progress(spark, folder)["done"] == 8
    outcomes = outcomes_in(spark, folder).collect()
    assert len(outcomes) == len(calls)  # profile calls count for the keys
    stored = {r.book_id: (r.profile_json is not None, r.attempts, r.sample_pages) for r in profiles.Profiles(spark, folder, samples).stored().collect()}
    assert stored == {1: (True, 0, [16, 17]), 2: (True, 0, []), 3: (False, 3, [1]), 4: (True, 0, [2])}


def test_the_first_commit_of_a_number_stays(spark, tmp_path):
    log = commits.Commits(spark, f"file://{tmp_path}/c")
    assert log.head() == (-1, {}) and log.put(0, {"a": 1}) and not log.put(0, {"a": 2})
    seen = []

    def step(number, head):
        seen.append(number)
        if len(seen) == 1:  # another is faster
            log.put(number + 1, {"a": "other"})
        return {"a": [head["a"], "mine"]}

    assert log.change(step) == (2, {"a": ["other", "mine"]}) and seen == [0, 1]
    assert log.change(lambda number, head: None) is None and log.numbers() == [0, 1, 2]

    def late(number, head):
        if number == 2:  # its files went when others moved on
            log.put(3, {"a": "moved on"})
            raise FileNotFoundError("retired")
        return {"a": "late"}

    assert log.change(late) == (4, {"a": "late"})
    with pytest.raises(ZeroDivisionError):
        log.change(lambda number, head: {"a": 1 / 0})
    assert not [f for f in (tmp_path / "c").iterdir() if f.name.endswith(".tmp")]


def test_an_upsert_touches_the_buckets_of_its_keys(spark, tmp_path):
    table = buckets.BucketTable(spark, f"file://{tmp_path}/t", ["book_id", "page_no"], 16)
    rows = [(b, p, f"v{b}.{p}") for b in range(40) for p in range(50)]
    schema = "book_id long, page_no int, text string"
    table.upsert(spark.createDataFrame(rows, schema))
    before = table.commits.head()[1]["files"]
    new = [(3, 7, "new"), (99, 1, "added")]
    version = table.upsert(spark.createDataFrame(new, schema))
    after = table.commits.head()[1]["files"]
    assert version == 1 and 1 <= sum(before.get(b) != d for b, d in after.items()) <= 2
    want = {(b, p): t for b, p, t in [*rows, *new]}
    assert {(r.book_id, r.page_no): r.text for r in table.read().collect()} == want
    assert {(r.book_id, r.page_no): r.text for r in table.read(0).collect()} == {(b, p): t for b, p, t in rows}  # as it was
    assert [r.text for r in table.lookup(book_id=3, page_no=7).collect()] == ["new"] and table.lookup(book_id=3, page_no=777).count() == 0

    def fails(x):
        raise RuntimeError("no")

    bad = spark.createDataFrame(new, schema).withColumn("text", F.udf(fails, "string")("text"))
    with pytest.raises(Exception, match="no"):
        table.upsert(bad)
    assert table.commits.head()[0] == 1 and not [f for f in (tmp_path / "t").iterdir() if f.name.startswith("_new")]
    # a faster writer: what it wrote stays
    real = table.commits.put

    def slow(number, content):
        table.commits.put = real
        buckets.BucketTable(spark, table.path, table.keys).upsert(spark.createDataFrame([(3, 7, "theirs"), (3, 8, "theirs")], schema))
        return real(number, content)

    table.commits.put = slow
    assert table.upsert(spark.createDataFrame([(3, 7, "mine")], schema)) == 3
    got = {(r.book_id, r.page_no): r.text for r in table.read().collect()}
    assert got == want | {(3, 7): "mine", (3, 8): "theirs"}
    table.retire(1)
    assert {(r.book_id, r.page_no): r.text for r in table.read().collect()} == got and table.commits.numbers() == [3]


def test_errors_of_a_client_have_a_kind(spark):
    from http.client import IncompleteRead

    class BothWays(OSError, ValueError):
        pass

    kinds = [files.kind_of(e) for e in (TimeoutError(), BothWays(), ValueError(), IncompleteRead(b""), KeyError("x"))]
    assert kinds == ["TransientError", "BadResponse", "BadResponse", "TransientError", "BadResponse"]

    def profile(book, pages):
        if book == 2:
            raise TimeoutError("no answer")
        return {"book_id": book, "n": len(pages)}

    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "book_id long, page_no int")
    got = {r.book_id: (r.n, r.kind, r.message) for r in files.call_books(rows, profile, "book_id long, n long, kind string, message string").collect()}
    assert got == {1: (2, None, None), 2: (None, "TransientError", "no answer")}


def test_numbers_are_consecutive_in_order(spark):
    names = sorted(f"path/{(k * 7919) % 5003:05d}" for k in range(400))
    got = numbering.numbered(spark.createDataFrame([(n,) for n in reversed(names)], "name string").repartition(5), "name", "id", 10)
    assert [r.name for r in got.orderBy("id").collect()] == names and [r.id for r in got.orderBy("id").collect()] == list(range(11, 411))
    for n in (0, 1, 2):
        assert numbering.numbered(spark.createDataFrame([(x,) for x in names[:n]], "name string"), "name").count() == n


def test_edits_by_label(spark):
    keys = spark.createDataFrame([(1, "a", "s", 10, 5, "exhausted", True, 5, "spent"), (2, "b", "s", 10, 5, "exhausted", True, 9, "spent"), (3, "c", "s", 10, 5, "dead", True, 0, "gone")], "key_id long, label string, secret string, rpm_limit int, rpd_limit long, state string, enabled boolean, used_today long, last_error string")
    edits = spark.createDataFrame([("a", -4, 8, None, "  "), ("b", None, -1, False, " new "), ("zz", 1, 1, True, "x")], "label string, rpm_limit int, rpd_limit long, enabled boolean, secret string")
    got = {r.label: r for r in K.edit(keys, edits).collect()}
    assert tuple(got["a"]) == (1, "a", "s", 0, 8, "active", True, 5, "")
    assert tuple(got["b"]) == (2, "b", "new", 10, 1, "exhausted", False, 9, "spent")
    assert got["c"].state == "dead" and len(got) == 3
    assert {r.label for r in K.without(keys, edits.select("label")).collect()} == {"c"}


def test_small_functions(spark):
    row = spark.range(1).select(quota.whole_hours(F.lit(7199)).alias("h"), quota.latency_ms(F.lit(1.0), F.lit(2.5)).alias("ms")).first()
    assert tuple(row) == (1, 1500)
    usage = lambda text: tuple(spark.range(1).select(classify.token_usage(F.lit(text)).alias("u")).first().u)
    assert usage('{"usage":"{no object}","usageMetadata":{"promptTokenCount":4}}') == (4, 0)
    assert usage('{"usage":{"input_tokens":12.7,"output_tokens":"9"}}') == (12, 9)
    assert usage("no JSON") == (0, 0)


def test_a_page_that_cannot_be_rendered_has_an_error(spark):
    def render(path, page, scale):
        if page == 2:
            raise RuntimeError("broken page")
        return f"{path} {page} {scale:.2f}".encode()

    got = {r.page_no: r for r in files.render_pages(spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "book_id long, page_no int, path string"), render, 150, 2).collect()}
    assert bytes(got[1].image) == b"x 1 2.08" and got[1].error is None
    assert got[2].image is None and got[2].error == "broken page"


def test_the_index_is_written_line_by_line(spark, tmp_path):
    pages = spark.createDataFrame([(b, p, "done" if p % 2 else "failed") for b in range(1, 31) for p in range(3)], "book_id long, page_no int, status string")
    books = spark.createDataFrame([(b, f'book "{b}"', 3) for b in range(1, 31)], "id long, title string, total_pages int")
    manifest, summary = export.manifests(pages, books), queue.queue_summary(pages)
    store.write_named(export.index_parts(manifest, summary), f"file://{tmp_path}/out").collect()
    got = json.loads((tmp_path / "out" / "index.json").read_text())
    assert got == json.loads(export.index(manifest, summary).first().value) and [b["book_id"] for b in got["books"]] == list(range(1, 31))
    none = export.index_parts(manifest.limit(0), summary)
    store.write_named(none, f"file://{tmp_path}/none").collect()
    assert json.loads((tmp_path / "none" / "index.json").read_text())["books"] == []


def chunks_plainly(rows, most_rows, most_chars):
    """``rows``: (book, page, chars)."""
    out, last = {}, {}
    for b, p, c in sorted(rows):
        chunk, n, held = last.get(b, (0, 0, 0))
        if n >= most_rows or n and held + c > most_chars:
            chunk, n, held = chunk + 1, 0, 0
        last[b] = (chunk, n + 1, held + c)
        out[b, p] = chunk
    return {(b, p, c, out[b, p], out[b, p] == last[b][0]) for b, p, c in rows}


def test_chunks_of_books_of_any_size(spark):
    """One book over many ranges, books of one row, rows over the bound, rows of no length; ranges shorter than a chunk."""
    import random

    rng = random.Random(3)
    one = [(1, k + 1, (k * 37) % 900) for k in range(2000)]
    few = [(b, p, rng.choice([0, 0, 5, 300, 2500])) for b in range(90) for p in range(rng.choice([1, 2, 9, 40]))]
    flat = [(7, p, 0) for p in range(700)]
    for rows, most_rows, most_chars, ranges in ((one, 9, 2000, 64), (one, 500, 10**9, 64), (few, 7, 2000, 16), (few + [(200, p, 10) for p in range(900)], 150, 2000, 64), (flat, 150, 10, 64), (few[:1], 5, 5, 64), ([], 5, 5, 64)):
        df = spark.createDataFrame(rows, "book_id long, page_no int, chars long").repartition(3)
        got = publish.chunks(df, most_rows, most_chars, ranges).select("book_id", "page_no", "chars", "chunk", "is_final").collect()
        assert len(got) == len(rows) and set(map(tuple, got)) == chunks_plainly(rows, most_rows, most_chars)
