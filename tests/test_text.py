"""Text, quality, naming, publishing, export, classification, images, sources and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import classify, fixed, images, prompts, quality, text
from quire.operators import export, naming, publish, selection, views
from quire.sources import files, store
from quire.streaming import pipeline


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


GATE = [
    ("text", "Dit is een volledige bladzijde met veel tekst erop geschreven.", "", True), ("text", "ab", "", False), ("blank", "", "", True), ("illustration_only", "", "", True), ("unreadable", "", "", True), (" blank ", None, None, True),
    ("text", "de heer van den berg en zijne vrouwe " * 40, "", False), ("text", "[illegible] [illegible] [illegible] [illegible] abc", "", False), ("text", "Goede tekst hier\x00met een nulbyte erin verstopt.", "", False), ("text", "", "a footnote of some fifty-eight characters, give or take one", True),
    ("text", "x" * 19, "", False), ("text", "abcdefghij0123456789", "", True), ("partial", "ab", "", True), ("text", "abcd" * 39 + "abc", "", True), ("text", "abcd" * 40, "", False), ("text", "\x0cplain text with odd edges\x0b", "", True), ("text", "plain \x0c text with odd middle", "", False),
    ("text", "[illegible]" + "y" * 33, "", True), ("text", "[illegible]" + "yz" * 16, "", False), (None, None, None, True),
]


def test_quality_gate(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GATE)], "i int, page_type string, transcription string, footnotes string, ok boolean")
    for r in quality.gate(df).collect():
        assert (r.status == "done") == r.ok == (r.flag_reason == ""), GATE[r.i]
    short = quality.gate(df.filter("i = 1")).first()
    assert short.flag_reason == fixed.TOO_SHORT.format(2)


def test_string_functions(spark):
    for s in ("", "  a b ", "\x1c a　", "x\n\ny", "no"):
        assert one(spark, s, text.strip) == s.strip()
        assert one(spark, s, text.squeeze) == " ".join(s.split())
        assert one(spark, s, lambda c: text.last_index(c, "\n")) == s.rfind("\n")
    assert one(spark, "aaaaa", lambda c: text.occurrences(c, F.lit("aa"))) == "aaaaa".count("aa")
    for s, want in (("a/b:c*", "a_b_c_"), ("  ", "book"), ("ગુજરાતી પાઠ", None), ("x" * 200, "x" * 120), ("a   b", "a b")):
        want = want or " ".join("".join(c if c.isalnum() or c in " ._-" else "_" for c in s).strip().split())
        assert one(spark, s, text.safe_stem) == want
    assert one(spark, "a:b\\c/d?e*f[g]", text.sheet_title) == "abcdefg" and one(spark, " / ", text.sheet_title) == "Book"
    assert one(spark, "d\\e/f.x.pdf", text.stem_of) == "f.x" and one(spark, ".hidden", text.stem_of) == ".hidden"


def cells(spark, s, columns=4, limit=45_000):
    parts, left = text.split_cells(F.col("x"), columns, limit)
    return spark.createDataFrame([(s,)], "x string").select(parts.alias("p"), left.alias("l")).first()


def test_split_cells(spark):
    assert cells(spark, "short") == (["short", "", "", ""], False)
    assert cells(spark, None) == (["", "", "", ""], False)
    lines = "\n".join(f"line {i} of a long page" for i in range(3000))
    r = cells(spark, lines)
    assert "\n".join(p for p in r.p if p) == lines and len([p for p in r.p if p]) == 2 and not r.l
    r = cells(spark, "x" * 90_100)
    assert "".join(r.p) == "x" * 90_100 and [len(p) for p in r.p] == [45_000, 45_000, 100, 0]
    r = cells(spark, "y" * 190_000)
    assert r.l and r.p[3].endswith(fixed.TRUNCATED) and all(len(p) <= 45_000 for p in r.p)
    r = cells(spark, "aaaa bbbb\n\n\ncccc dddd", 4, 10)
    assert r.p[:2] == ["aaaa bbbb", "cccc dddd"]


def test_names(spark):
    books = spark.createDataFrame([(1, "010"), (2, "010"), (3, "011"), (4, "z" * 200), (5, "z" * 96)], "id long, title string")
    tabs = {r.id: r.tab for r in naming.tab_names(books).collect()}
    assert tabs[1] == "010 (1)" and tabs[2] == "010 (2)" and tabs[3] == "011"
    assert len(set(tabs.values())) == 5 and all(len(t) <= 95 for t in tabs.values())
    assert {r.id: r.stem for r in naming.file_stems(books).collect()}[2] == "010_2"


def test_chunks(spark):
    rows = [(1, i, 160_000) for i in range(60)] + [(2, i, 2_000) for i in range(400)] + [(3, 1, 3_000_000), (3, 2, 1)]
    got = publish.chunks(spark.createDataFrame(rows, "book_id long, page_no int, chars long")).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        groups.setdefault((r.book_id, r.chunk), []).append(r)
    assert all(len(g) <= 150 and (sum(r.chars for r in g) <= 2_000_000 or len(g) == 1) for g in groups.values())
    assert max(c for b, c in groups if b == 1) == 4 and max(c for b, c in groups if b == 2) == 2
    assert all(r.is_final == (r.chunk == max(c for b, c in groups if b == r.book_id)) for r in got)


PAGE = "book_id long, page_no int, status string, page_type string, transcription string, footnotes string, note string, flag_reason string, printed_page_number string, input_tokens long, output_tokens long"
PAGES = [(1, 1, "done", "text", "ગુજરાતી પાઠ — æthelred", "1 note", "", "", "xii", 2400, 900), (1, 2, "flagged", "blank", "", None, "", "odd", "", 0, 0), (1, 3, "pending", None, None, None, None, None, None, 0, 0), (1, 4, "done", "illustration_only", "", "", "n", "", "", 0, 0)]
BOOK = "id long, title string, file_name string, rel_path string, fingerprint string, total_pages int"


def test_publish_rows_keep_their_page(spark):
    rows = publish.publish_rows(spark.createDataFrame(PAGES, PAGE)).orderBy("page_no").collect()
    assert [(r.page_no, r.cells[0], r.note) for r in rows] == [(1, PAGES[0][4], ""), (2, "[BLANK]", "odd"), (4, "[IMAGE]", "n")]
    sheet = spark.createDataFrame([(1, 1, "old"), (1, 9, "kept")], "book_id long, page_no int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (1, 3, "new")], "book_id long, page_no int, v string")
    assert {(r.page_no, r.v) for r in publish.upsert(sheet, new, ["book_id", "page_no"]).collect()} == {(1, "new"), (3, "new"), (9, "kept")}


def test_export(spark, tmp_path):
    pages, books = spark.createDataFrame(PAGES, PAGE), spark.createDataFrame([(1, "Boek", "b.pdf", "d/b.pdf", "quick:x", 4), (2, "Leeg", "l.pdf", "l.pdf", "q", 0)], BOOK)
    lines = export.json_lines(export.records(pages, books))
    got = {r.page_no: json.loads(r.value) for r in lines.collect()}
    assert len(got) == 4 and got[1]["printed_page_number"] == "xii" and got[2]["printed_page_number"] is None and got[1]["provenance"]["input_tokens"] == 2400
    assert "ગુજરાતી" in lines.filter("page_no = 1").first().value and got[1]["book"]["title"] == "Boek" and got[3]["footnotes"] == ""
    shown = {r.book_id: r.text for r in export.plain_text(pages, books).collect()}
    assert shown[1].startswith("Boek\n====\nSource: d/b.pdf\n4 pages\n\n\n--- PDF page 1 ---\n") and "\n\n[Footnotes]\n1 note\n" in shown[1]
    assert "--- PDF page 2 ---\n[BLANK]" in shown[1] and "[not transcribed: pending]" in shown[1] and "[ILLUSTRATION_ONLY]" in shown[1]
    assert shown[2] == "Leeg\n====\nSource: l.pdf\n0 pages\n"
    parts = export.plain_text_parts(pages, books).select(F.concat(F.lit("t"), "book_id").alias("file"), "place", "value")
    store.write_named(parts, f"file://{tmp_path}/t").collect()
    assert (tmp_path / "t" / "t1").read_text() == shown[1] + "\n" and (tmp_path / "t" / "t2").read_text() == shown[2] + "\n"
    m = export.manifests(pages, books)
    by = {r.book_id: r for r in m.collect()}
    assert by[1].page_status_counts == {"done": 2, "flagged": 1, "pending": 1} and by[1].input_tokens == 2400 and by[2].page_status_counts == {}
    from quire.operators.queue import queue_summary

    index = json.loads(export.index(m, queue_summary(pages)).first().value)
    assert index["book_count"] == 2 and index["queue"]["done"] == 2 and [b["book_id"] for b in index["books"]] == [1, 2]
    assert json.loads(m.select(export.manifest_json(m).alias("j")).first().j)["tokens"]
    named = lines.join(naming.file_stems(books).select(F.col("id").alias("book_id"), "stem"), "book_id").select(F.concat("stem", F.lit(".jsonl")).alias("file"), F.col("page_no").alias("place"), "value")
    done = store.write_named(named, f"file://{tmp_path}/x").collect()
    assert [(r.file, r.lines) for r in done] == [("Boek.jsonl", 4)]
    assert [json.loads(x)["pdf_page_number"] for x in (tmp_path / "x" / "Boek.jsonl").read_text().splitlines()] == [1, 2, 3, 4]


def test_failures(spark):
    cases = [
        (429, "RESOURCE_EXHAUSTED", {"Retry-After": "30"}, "RateLimited", 30.0), (429, "x", {"retry-after": "soon"}, "RateLimited", None), (403, "PERMISSION_DENIED", {}, "KeyRejected", None), (401, "API_KEY_INVALID", None, "KeyRejected", None), (400, "API_KEY_INVALID: not valid", {}, "KeyRejected", None),
        (403, "Host not in allowlist: x", {}, "TransientError", None), (403, "<html>blocked</html>", {}, "TransientError", None), (500, "", {}, "TransientError", None), (503, None, {}, "TransientError", None), (400, "Unknown name 'thinking_level'", {}, "BadResponse", None), (404, "", {}, "BadResponse", None),
    ]
    df = spark.createDataFrame(cases, "status int, body string, headers map<string,string>, kind string, wait double")
    for r in df.withColumn("f", classify.failure(F.col("status"), F.col("body"), F.col("headers"))).collect():
        assert (r.f.kind, r.f.retry_after) == (r.kind, r.wait)


def response(output, kind="model_output", block="text"):
    return json.dumps({"steps": [{"type": "thought", "content": [{"type": "text", "text": "hm"}]}, {"type": kind, "content": [{"type": block, "text": output}]}]})


def test_payloads(spark):
    cases = [(response('{"page_type":"text","languages":["nl"]}'), None), (response('```json\n{"page_type":"blank"}\n```'), None), ("{}", "no output step"), (response("x", kind="other"), "no output step"), (response("x", block="image"), "no text in the output"), (response("{oops"), "not valid JSON"), (response("[1]"), "not an object"), (response('{"transcription":"a"}'), "no page type")]
    df = classify.with_payload(spark.createDataFrame(cases, "r string, error string"), F.from_json("r", classify.RESPONSE), "p")
    assert all(r.p.error == r.error and (r.p.result is None) == (r.error is not None) for r in df.collect())
    usage = [('{"usage":{"input_tokens":5,"output_tokens":6}}', 5, 6), ('{"usage_metadata":{"prompt_token_count":5,"candidates_token_count":0,"candidatesTokenCount":2}}', 5, 2), ('{"usageMetadata":{"promptTokenCount":1}}', 1, 0), ('{"usage":{},"usageMetadata":{"promptTokenCount":1}}', 0, 0), ("{}", 0, 0), ('{"usage":7}', 0, 0)]
    df = spark.createDataFrame(usage, "r string, i long, o long").withColumn("u", classify.token_usage(F.col("r")))
    assert all((r.u.input, r.u.output) == (r.i, r.o) for r in df.collect())


def test_request_and_mime(spark):
    df = spark.createDataFrame([('m "x"', "p", [bytearray(b"\x01" * 100), bytearray(b"b")], "jpg", None, "low"), ("m", "p", [], "png", "high", "")], "m string, p string, i array<binary>, f string, r string, t string")
    c = F.col
    got = [json.loads(r.b) for r in df.select(classify.request_body(c("m"), c("p"), c("i"), c("f"), c("r"), '{"type":"object"}', c("t")).alias("b")).collect()]
    assert got[0]["model"] == 'm "x"' and got[0]["store"] is False and got[0]["input"][0] == {"type": "text", "text": "p"} and len(got[0]["input"]) == 3
    assert got[0]["input"][1]["mime_type"] == "image/jpeg" and "resolution" not in got[0]["input"][1] and got[0]["thinking_level"] == "low"
    assert got[0]["response_format"] == {"type": "text", "mime_type": "application/json", "schema": {"type": "object"}}
    assert got[1]["input"] == [{"type": "text", "text": "p"}] and "thinking_level" not in got[1]
    assert one(spark, "tiff", classify.mime_type) == "image/png"


def test_prompts(spark):
    kind = classify.PROFILE
    ask = lambda p, **k: one(spark, p, lambda c: prompts.page_prompt(F.from_json(c, kind), **k))
    assert "century" not in ask(None) and "None" not in ask(None)
    full = ask('{"primary_language":"Gujarati","script":"Gujarati","era":"","other_languages":["Latin","Greek"]}')
    assert "Gujarati script" in full and "mainly in Gujarati" in full and "Latin, Greek" in full and "None" not in full and " a  book" not in full
    assert "Reflow" in ask(None, preserve_layout=False) and "script" not in ask('{"script":"Latin"}').split("follows.")[0]
    cleaned = one(spark, '{"era":" Unknown ","script":"N/A"}', lambda c: classify.profile_fields(F.from_json(c, kind)))
    assert (cleaned.era, cleaned.script) == ("", "")


def test_selection(spark):
    def pick(flags, **k):
        df = spark.createDataFrame([(1, i + 1, f) for i, f in enumerate(flags)], "book_id long, page_no int, is_text boolean")
        r = selection.select_text_pages(df, **k).first()
        return r.pages, r.strategy

    after, whole, none = fixed.STRATEGIES
    assert pick([False] * 15 + [True] * 15) == ([16, 17, 18], after)
    assert pick([True] * 8) == ([1, 2, 3], whole)
    assert pick([False] * 40) == ([], none)
    assert pick([False] * 120 + [True] * 20, count=2, scan_limit=10) == ([], none)
    assert pick([False] * 120 + [True] * 20, count=2, scan_limit=200) == ([121, 122], after)
    assert pick([False] * 15 + [None] * 3 + [True] * 5, scan_limit=4) == ([19], after)  # unreadable pages count as inspected
    assert pick([True] * 2 + [False] * 13 + [None] * 3 + [True], scan_limit=3) == ([1, 2], whole)


def page(rows, ink=0, paper=255, height=595, width=420, every=14):
    a = np.full((height, width), paper, np.uint8)
    for k in range(rows):
        y = 40 + k * every
        a[y : y + 6, 40 : width - 40 : 2] = ink
        a[y : y + 6, 41 : width - 40 : 2] = (ink + paper) // 2
    return a


def test_page_analysis():
    look = lambda a: images.analyse(a.tobytes(), *a.shape)
    assert look(page(34))[2:] == (True, "text") and not look(page(2))[2] and look(np.full((50, 50), 255, np.uint8))[3] == "blank"
    plate = np.random.default_rng(0).integers(0, 255, (400, 300)).astype(np.uint8)
    assert not look(plate)[2]
    assert abs(look(page(34))[0] - look(page(34, ink=40, paper=180))[0]) < 0.01
    two = np.where(page(34) < 255, 0, 255).astype(np.uint8)
    assert images.otsu(two) == 0 and look(two)[3] == "blank"  # a purely black and white page has no ink below level 0
    assert images.analyse(b"abc", 2, 2)[3] == "unreadable pixel buffer" and images.analyse(b"", 0, 0)[2] is False


def test_skew():
    straight = page(30, height=400, width=400, every=12)
    assert images.skew_angle(straight) == 0.0 and images.deskewed(straight) is straight
    tilted = (255 - images.rotated(255 - straight.astype(np.float32), 2.0)).astype(np.uint8)
    assert images.skew_angle(tilted) == pytest.approx(-2.0, abs=0.3)
    assert images.skew_angle(images.deskewed(tilted)) == pytest.approx(0, abs=0.3)


def test_page_stats_udf(spark):
    a = page(34)
    df = spark.createDataFrame([(bytearray(a.tobytes()), *a.shape)], "samples binary, height int, width int")
    r = df.select(images.page_stats("samples", "height", "width").alias("s"), images.page_skew("samples", "height", "width").alias("k")).first()
    assert r.s.looks_like_text and r.k == 0.0
    again = spark.createDataFrame([(r.s.ink_ratio, r.s.empty_row_fraction)], "i double, e double").select(images.page_reason(F.col("i"), F.col("e")).alias("r")).first().r
    assert again == r.s.reason


def test_scan(spark, tmp_path):
    for name, n in (("dutch/eerste.pdf", 4), ("dutch/tweede.PDF", 2), (".git/ignored.pdf", 1), ("broken.pdf", 0)):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(struct.pack("b", n) + name.encode())
    (tmp_path / "notes.txt").write_text("x")

    def count(data):
        if not data[0]:
            raise ValueError("not a document")
        return data[0]

    got = files.scan(spark, str(tmp_path), count).collect()
    assert [(r.rel_path, r.title, r.total_pages) for r in got] == [("broken.pdf", "broken", 0), ("dutch/eerste.pdf", "eerste", 4), ("dutch/tweede.PDF", "tweede", 2)]
    assert got[0].error == "not a document" and got[1].error is None and got[1].fingerprint.startswith("quick:") and got[1].fingerprint != got[2].fingerprint
    assert files.scan(spark, str(tmp_path), count, full=True).first().fingerprint.startswith("sha256:")


def test_fingerprint_never_sees_the_middle(spark):
    fp = lambda b: one(spark, bytearray(b), lambda c: files.fingerprint(c, head=10), "binary")
    assert fp(b"a" * 10 + b"b" * 5) == fp(b"a" * 10 + b"c" * 5) and fp(b"a" * 25) != fp(b"a" * 24 + b"b") and fp(b"") != fp(b"a")


def test_readers(spark, tmp_path):
    (tmp_path / "keys.json").write_text('[{"label": "a", "secret": "s"}, {"label": "b", "secret": "t", "rpd_limit": 9}]')
    assert [(r.label, r.rpd_limit) for r in files.read_keys(spark, str(tmp_path / "keys.json")).orderBy("label").collect()] == [("a", None), ("b", 9)]
    (tmp_path / "b.json").write_text(json.dumps({"exportedAt": "x", "books": [{"name": "A", "fileName": "a.pdf", "relativePath": ["d", "a.pdf"], "pages": [{"n": 1, "status": "synced", "pageType": "text", "text": "t"}]}, {"name": "B", "fileName": "b.pdf", "pages": []}]}))
    books, pages = files.read_backup(spark, str(tmp_path / "b.json"))
    assert {(r.name, r.rel_path) for r in books.collect()} == {("A", "d/a.pdf"), ("B", "b.pdf")} and pages.first().page_type == "text"
    (tmp_path / "no.json").write_text('{"x": 1}')
    with pytest.raises(ValueError, match="not a backup"):
        files.read_backup(spark, str(tmp_path / "no.json"))
    (tmp_path / ".env").write_text("# c\nA=1\nB='two words'\nC=\n\nbad\n")
    assert files.read_env(str(tmp_path / ".env"), {"A": "9"}) == {"A": "9", "B": "two words", "C": ""} and files.read_env(str(tmp_path / "none")) == {}


def test_pluggable_calls(spark):
    pages = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "book_id long, page_no int")
    got = files.call_pages(pages, lambda r: {"book_id": r["book_id"], "page_no": r["page_no"], "out": f"p{r['page_no']}"}, "book_id long, page_no int, out string", 2)
    assert sorted(r.out for r in got.collect()) == ["p1", "p1", "p2"]
    assert {(r.book_id, r.n) for r in files.call_books(pages, lambda b, g: {"book_id": b, "n": len(g)}, "book_id long, n int").collect()} == {(1, 2), (2, 1)}


def test_stream_of_pages_resumes(spark, tmp_path):
    src, out, cp = (str(tmp_path / d) for d in ("in", "out", "cp"))
    rows = [(1, "text", "a page with quite enough text on it", ""), (2, "text", "ab", "")]
    kind = "page_no int, page_type string, transcription string, footnotes string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(src)
    run = lambda: pipeline.run_pages(spark, src, kind, pipeline.gated, out, cp)
    run()
    run()
    assert {(r.page_no, r.status) for r in spark.read.parquet(out).collect()} == {(1, "done"), (2, "flagged")}
    spark.createDataFrame([(3, "blank", "", "")], kind).coalesce(1).write.mode("append").parquet(src)
    run()
    assert sorted(r.page_no for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_keyed_state_equals_batch(spark, tmp_path):
    rows = [(k, i, "rate_limited" if (i * k) % 3 else "success") for k in (1, 2) for i in range(12)]
    src = str(tmp_path / "in")
    kind = "key_id long, seq long, outcome string"
    for a, b in ((0, 12), (12, 24)):
        spark.createDataFrame(sorted(rows, key=lambda r: r[1])[a:b], kind).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    q = pipeline.refusal_runs(stream).writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want, run = {}, {}
    for k, i, o in sorted(rows, key=lambda r: r[1]):
        run[k] = run.get(k, 0) + 1 if o == "rate_limited" else 0
        want[k, i] = run[k]
    assert {(r.key_id, r.seq): r.run for r in spark.table("runs").collect()} == want


def test_log_tail_misses_nothing(spark, tmp_path):
    src, seen = str(tmp_path / "log"), []
    write = lambda a, b: spark.range(a, b).coalesce(1).write.mode("append").parquet(src)
    tail = lambda: pipeline.tail_log(spark, src, "id long", lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "cp"))
    write(0, 50)
    tail()
    write(50, 55)
    tail()
    assert sorted(seen) == list(range(55))


def test_windows_of_a_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "e"))
    q = pipeline.tumbling_counts(stream, "ts", "1 day", "1 hour", "event_type").writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {tuple(r) for r in pipeline.tumbling_counts(spark.read.parquet(str(tmp_path / "e")), "ts", "1 day", "1 hour", "event_type").collect()}
    got = {tuple(r) for r in spark.table("win").collect()}
    assert got and got <= batch  # the last window isn't closed yet


def test_chunks_are_sent_once_each(spark):
    rows = publish.publish_rows(spark.createDataFrame([(1, i, "done", "text", f"t{i}", "", "", "", "", 0, 0) for i in range(7)], PAGE))
    at = publish.chunks(rows.withColumn("chars", publish.row_chars(rows)), 3)
    sent = publish.send_chunks(rows.join(at.drop("chars"), ["book_id", "page_no"]), lambda b, c, final, g: {"chunk": c, "final": final, "pages": ",".join(map(str, g["page_no"]))}, "chunk int, final boolean, pages string")
    assert sorted(tuple(r) for r in sent.collect()) == [(0, False, "0,1,2"), (1, False, "3,4,5"), (2, True, "6")]


def test_views(spark):
    pages, books = spark.createDataFrame(PAGES, PAGE), spark.createDataFrame([(1, "Boek", "b.pdf", "d/b.pdf", "quick:x", 4), (2, "Leeg", "l.pdf", "a.pdf", "q", 0)], BOOK)
    assert [(r.id, r.pages_done, r.profiled) for r in views.book_listing(books, pages).collect()] == [(2, 0, False), (1, 2, False)]
    d = views.book_detail(books, pages, 1).first()
    assert [p.page_no for p in d.pages] == [1, 2, 3, 4] and d.pages[0].key_label is None and len(d.pages[0]) == 17
    assert views.book_detail(books, pages, 9).count() == 0 and views.book_detail(books, pages, 2).first().pages is None
    assert {(r.page_no, r.has_text) for r in views.sheet_status(publish.publish_rows(pages)).collect()} == {(1, True), (2, True), (4, True)}
    assert [(r.key, r.value) for r in views.config_rows(spark, {"dpi": 300, "model": None}).collect()] == [("dpi", "300"), ("model", None)]


def test_progress_of_a_stream(spark, tmp_path):
    import time

    watch = views.Progress()
    assert watch.snapshot()["state"] == "idle"
    spark.streams.addListener(watch)
    try:
        spark.range(30).write.parquet(str(tmp_path / "in"))
        pipeline.tail_log(spark, str(tmp_path / "in"), "id long", lambda df, n: df.count(), str(tmp_path / "cp"))
        for _ in range(100):
            if watch.snapshot()["state"] == "done":
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(watch)
    assert watch.snapshot() == {"state": "done", "batches": 1, "rows": 30, "error": ""}


def test_tables_are_made_once(spark, tmp_path):
    from quire.operators import log

    log.append(spark.range(3), str(tmp_path / "log"))
    log.append(spark.range(3, 5), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5
