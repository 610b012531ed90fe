"""Each operator against a library, a brute-force version or a round trip, on odd and ordinary rows."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, decontamination, html_text, language_model, near_duplicates, quality_model, quality_rules, token_counts, training_order, warc
from quire.llm.common import by_bytes, gathered, most_frequent
from quire.llm.components import components

LONG = "lorem ipsum dolor sit amet " * 3000
TEXTS = [
    None, "", "   ", "\n\n", "one", "one two three four", "a\x1cb \x85 c", "no breaks" * 2000, LONG, "ΑΣ Σ İstanbul ﬁ ½", "日本語 テキスト 123４５", "👩‍👩‍👧 ok", "<|endoftext|> in <|startoftext|> text", "<s> </s> <unk> <0x41>",
    "▁ x ▁▁ y  z", "don't we'll I'M", "line one\nline one\nline two\n", "The end.", "The end.", "日本語テキスト" * 60, "ab" * 400, "a1b2--c..d9'x''y", "\x00nul \x07bell", "&&& *** $$$ %%%", "word " * 100,
]
#: Columns with names that operators use inside.
EXTRA = ("cls", "copies", "word", "host", "shard", "token", "grp", "page", "payload", "key", "n", "held_out", "label", "of", "rate")
DOC = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None, *["x"] * len(EXTRA)) for i, t, s in rows], DOC).repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, a repeated row, a null id, a null source."""
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)]
    return documents(spark, [*rows, rows[9], (None, "of no one", None)]).cache()


def rows_of(df, *by):
    return sorted((tuple(r) for r in df.select(*by).collect()), key=repr)


def text_by_id(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def empty(df):
    return df.limit(0)


# --- shared helpers


def test_most_frequent_takes_whole_steps_from_the_top(spark):
    rng = random.Random(3)
    rows = [(i, int(rng.paretovariate(0.7))) for i in range(2000)]
    df = spark.createDataFrame(rows, "word int, n long")
    for n in (0, 1, 50, 500, 5000):
        got = {r.word for r in most_frequent(df, n).collect()}
        assert len(got) <= n
        assert not got or min(k for i, k in rows if i in got) > max([0, *(k for i, k in rows if i not in got)])
    assert most_frequent(df, 5000).count() == 2000 and most_frequent(df.limit(0), 5).count() == 0


def test_batches_keep_their_rows():
    import pyarrow as pa

    batches = [pa.record_batch({"text": ["x" * k for k in range(b, b + 7)]}) for b in (0, 20, 40)]
    for limit in (1, 50, 10**6):
        parts = list(by_bytes(iter(batches), "text", limit))
        assert [t for p in parts for t in p.column("text").to_pylist()] == [t for b in batches for t in b.column("text").to_pylist()]
        assert all(p.num_rows == 1 or sum(map(len, p.column("text").to_pylist())) <= limit for p in parts)
    assert [b.num_rows for b in gathered(iter(batches), 10)] == [14, 7] and list(gathered(iter([]), 5)) == []


# --- op1


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        p = training_order.Permutation(n, 9)
        slots = p.slots(np.arange(n))
        assert sorted(slots) == list(range(n))
        assert (p.numbers(slots) == np.arange(n)).all()
    assert (training_order.Permutation(1000, 1).slots(np.arange(1000)) != training_order.Permutation(1000, 2).slots(np.arange(1000))).any()


def test_training_order_round_trip(spark, odd, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    index = training_order.materialise(odd, f"file://{tmp_path}/o", path, public_tokenizers.PATTERN, length=64, shards=3)
    reader = training_order.SlotReader(f"file://{tmp_path}/o")
    seqs = list(reader.read())
    assert len(seqs) == reader.layout["sequences"] == index.count()
    assert sorted(r.slot for r in index.select("slot").collect()) == list(range(len(seqs)))
    assert [s.tobytes() for s in reader.read(5, 7)] == [s.tobytes() for s in seqs[5:12]]
    enc, end = training_order.encoding(path, public_tokenizers.PATTERN)
    got = defaultdict(list)
    for r in training_order.document_parts(index).collect():
        got[r.doc_id].append((r.doc_start, seqs[r.slot][r.start : r.start + r.n_tokens].tolist()))
    for i, text in text_by_id(odd).items():
        want = [*enc.encode_ordinary(text or ""), end]
        parts = sorted(got[i])
        if i == 9:  # the row is there twice
            assert sorted(t for _, p in parts for t in p) == sorted(want * 2)
        else:
            assert [t for _, p in parts for t in p] == want
    with pytest.raises(ValueError, match="already"):
        training_order.materialise(odd, f"file://{tmp_path}/o", path, public_tokenizers.PATTERN)
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "shard-000009.bin").write_bytes(b"of a run that failed")
    assert training_order.materialise(empty(odd), f"file://{tmp_path}/e", path, public_tokenizers.PATTERN).count() == 0
    assert list(training_order.SlotReader(f"file://{tmp_path}/e").read()) == [] and not list((tmp_path / "e").glob("shard-*"))
    # slots by a plain version of the permutation
    order = training_order.Permutation(len(seqs), 1)
    keys, half = [int(k) for k in order.keys], int(order.half)
    mix = lambda x: (y := ((x ^ x >> 33) * 0xFF51AFD7ED558CCD) % 2**64, z := ((y ^ y >> 33) * 0xC4CEB9FE1A85EC53) % 2**64, z ^ z >> 33)[-1]

    def slot(x):
        while True:
            left, right = x >> half, x % 2**half
            for k in keys:
                left, right = right, left ^ mix((right + k) % 2**64) % 2**half
            x = right << half | left
            if x < len(seqs):
                return x

    assert [slot(i) for i in range(len(seqs))] == order.slots(np.arange(len(seqs))).tolist()


# --- op2


def test_token_counts_are_the_librarys(odd):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for part in (5, 4096):
        got = {r.doc_id: r for r in token_counts.token_counts(odd, path, part_chars=part).collect()}
        for i, text in text_by_id(odd).items():
            n = len(model.encode(text or ""))
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 4096)
    assert token_counts.token_counts(odd, path).count() == odd.count()
    assert token_counts.token_counts(empty(odd), path).count() == 0


def test_safe_splits_change_no_count():
    path, rng = public_tokenizers.path("piece_bpe_32k.model"), random.Random(1)
    texts = ["".join(rng.choice(["a", "the", " ", "  ", "▁", "\n", "é", "9", "."]) for _ in range(80)) for _ in range(300)]
    assert token_counts.count_batch(texts, path, 4, 1000) == token_counts.count_batch(texts, path, 10**9, 1000)


# --- op3


def quality_rows(n):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "the", "or", "in", "st", "re"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        text = " ".join(word() for _ in range(rng.randint(30, 120)))
        bad = i % 4 == 0
        rows.append((i, "".join(c + "&&&" if c == " " else c for c in text.upper()) if bad else text, int(not bad)))
    return rows


def test_classifier_separates_held_out_rows(spark):
    rows = quality_rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = quality_model.quality_scores(docs, labels).collect()
    truth = {i: q for i, _, q in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = quality_model.keep_likely(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def test_classifier_on_odd_tables(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert {r.score for r in quality_model.quality_scores(odd, one).collect()} == {1.0}
    mixed = spark.createDataFrame([(i, i % 2) for i in range(20)] * 2, "doc_id long, quality int")
    got = quality_model.quality_scores(odd, mixed)
    assert got.count() == odd.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert quality_model.quality_scores(empty(odd), mixed).count() == 0


def test_a_repeated_id_is_one_row_of_the_sample(spark, monkeypatch):
    held = []
    monkeypatch.setattr(quality_model, "fit", lambda rows, *_: held.append(rows) or quality_model.Network())
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for hot in (0, 1, 2, 3):
        rows = [(i, f"text {i}") for i in range(40)] + [(i, f"copy {k}") for i in range(hot, 40, 4) for k in range(50)]
        quality_model.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels, sample=30)
    assert all(set(rows["of"]) == set(held[0]["of"]) and len(rows) == len(set(rows["of"])) > 20 for rows in held)


def test_symbols_of_any_number_have_few_vectors(spark):
    rng = random.Random(9)
    pairs = sorted({chr(rng.choice([rng.randint(0x2190, 0x2BFF), rng.randint(0x21, 0x2F)])) + chr(rng.randint(0x2190, 0x2BFF)) for _ in range(70_000)})
    assert len(pairs) > 50_000
    texts = [" ".join(pairs[k::20]) for k in range(20)] * 3
    ids, vectors, _ = quality_model.word_vectors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4096)
    assert len(ids) == len(vectors) <= 4096 and np.isfinite(vectors).all()
    assert {quality_model.shape(t) for p in pairs for t in quality_model.TOKEN.findall(p)} <= set(quality_model.SHAPES) and len(quality_model.SHAPES) < 60
    assert np.isfinite(quality_model.features(*quality_model.encode([*pairs[:50], LONG * 20, "", "\0"], quality_model.Rows(ids)), vectors)).all()


def test_word_vectors_are_of_all_texts(spark, monkeypatch):
    """Counts and sums against loops over all tokens, however the rows are dealt."""
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("", "x", "Y", "zzz", "zzzzzz")] + ["<!>", "..", "7", "__", "w" * 65, "é"]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60))) for _ in range(300)] + [None, "", "a b a b " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids, vectors, table = quality_model.word_vectors(df.repartition(1), 80)
    seen = Counter(t for text in texts for t in set(quality_model.TOKEN.findall(text or "")) if len(t) <= 64)
    own = [t for t in ids if t not in quality_model.SHAPES]
    assert 10 < len(own) <= 80 - len(quality_model.SHAPES) and "w" * 65 not in ids
    assert min(seen[t] for t in own) > max(k for t, k in seen.items() if t not in ids)
    index = {t: quality_model.index_vector(t) for t in ids}
    want = {t: np.zeros(64) for t in ids}
    for text in texts:
        names = [t if t in ids else quality_model.shape(t) for t in quality_model.TOKEN.findall(text or "")]
        for i, t in enumerate(names):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(names):
                    want[t] += index[names[j]]
    sums = quality_model.neighbour_sums(table, np.stack(list(index.values())))
    assert all((sums[i] == want[t]).all() for t, i in ids.items()) and any(want[t].any() for t in own)
    monkeypatch.setattr(quality_model, "HELD", 3)
    again, same, _ = quality_model.word_vectors(df.repartition(5), 80)
    assert again == ids and list(again) == list(ids) and (same == vectors).all()


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    held = []
    monkeypatch.setattr(quality_model, "fit", lambda rows, *_: held.append(rows) or quality_model.Network())
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame([(i, "x" * (100 if i % 3 else 5000)) for i in range(60)], "doc_id long, text string")
    quality_model.train(docs, labels, sample_bytes=1500)
    quality_model.train(docs, labels, sample_bytes=10**9)
    assert 10 <= len(held[0]) <= 15 and held[0]["text"].str.len().sum() <= 1500 and len(held[1]) > 30
    assert list(held[0]["of"]) == [i for i in held[1]["of"] if i in set(held[0]["of"])]


# --- op4

PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>y</p>"), (3, "http://a b/3", "<p>x</p>"), (4, None, None), (5, "u", ""), (5, "u", ""), (7, "u\nv", "é" * 5000), (None, "n", "<p>x</p>"), (None, "n", "only"), (0, "z", "<p>y</p>")]


@pytest.mark.parametrize("shards,roll", [(1, 1 << 30), (3, 200)])
def test_warc_round_trip(spark, tmp_path, shards, roll):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("shard", F.lit("x")).repartition(4)
    out = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, out, shards=shards, roll_bytes=roll)
    got = warc.read_warc(spark, out).collect()
    assert sum(r.records for r in manifest.collect()) == len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for p, h in {(i, h or "") for i, _, h in PAGES}:
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        own = [r for r in got if r.page_id == p and r.payload_digest == digest]
        assert own and all(r.payload_bytes == len(h.encode()) for r in own)
        responses = [r for r in own if r.record_type == "response"]
        assert len(responses) == (1 if first.get(h, p) == p else 0)
        assert all(bytes(r.payload).decode() == h and r.refers_to is None for r in responses)
        assert all(r.refers_to == first.get(h, p) for r in own if r.record_type == "revisit")
    assert not (tmp_path / "w" / ".tmp").exists()


def test_warc_files_are_the_same_each_time(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name, n in (("a", 1), ("b", 5)):
        warc.write_warc(df.repartition(n), f"file://{tmp_path}/{name}", shards=2, roll_bytes=300)
    files = lambda d: {p.name: p.read_bytes() for p in (tmp_path / d).glob("*.warc.gz")}
    assert files("a") == files("b") and len(files("a")) > 2
    import gzip

    assert gzip.decompress(next(iter(files("a").values()))).startswith(b"WARC/1.1\r\n")
    warc.write_warc(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_of_ids_far_apart(spark, tmp_path):
    ids = [-(2**63), -(2**63) + 1, -5, 0, 2**53, 2**53 + 1, 2**63 - 2, 2**63 - 1]
    df = spark.createDataFrame([(i, f"u{i}", f"text of {i}" * 50) for i in ids], "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    (tmp_path / "w" / ".tmp").mkdir(parents=True)
    (tmp_path / "w" / ".tmp" / "left by a lost attempt").write_bytes(b"x")
    assert {r.shard for r in warc.write_warc(df, out, shards=4).collect()} >= {0, 1}
    assert not (tmp_path / "w" / ".tmp").exists()
    assert sorted(r.page_id for r in warc.read_warc(spark, out).collect()) == ids


def test_warc_shards_are_even_and_one_a_task(spark, tmp_path):
    df = spark.range(1200).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("x"), F.repeat(F.col("id").cast("string"), 50)).alias("html"))
    made = warc.write_warc(df, f"file://{tmp_path}/w", shards=60).collect()
    assert len({r.shard for r in made}) >= 55 and max(r.records for r in made) <= 3 * 1200 / 60
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 1200


# --- op5

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="page">
<header>Site</header><nav><ul><li><a href="/a>b">Menu</a></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p>One <b>bold</b>
 text&nbsp;here.<p>Two<br>lines.<div class="comments"><p>Nice!</p></div><form>mail <input></form></article>
<aside>Side</aside><footer>&copy; me</footer>"""


def test_main_text_of_an_article():
    assert html_text.extract(ARTICLE, set()) == "Head & line\n\nOne bold text here.\n\nTwo lines."
    assert html_text.extract("", set()) == ""
    assert html_text.extract("<p>unclosed <b>bold", set()) == "unclosed bold"
    assert html_text.extract("a &lt; b < c", set()) == "a < b < c"
    assert html_text.extract("<div>x</div></p></div><p hidden>h</p><p>y", set()) == "x\n\ny"
    assert html_text.extract("<!-- never closed <p>x", set()) == ""


def test_deep_and_broken_markup_takes_linear_time():
    import time

    began = time.time()
    assert html_text.extract("<div>" * 30_000 + "x" + "</section>" * 30_000 + "</div>" * 30_000, set()) == "x"
    assert html_text.extract("<p>" * 30_000 + "y", set()) == "y"
    assert html_text.extract('<a href="x' * 20_000, set()) == ""
    assert time.time() - began < 10


def test_template_removes_what_a_hosts_pages_share(spark):
    """Without an article element, blocks of the template go and the varying slots stay."""
    page = "<body><div id=top>Welcome to the site</div><div class=body><p>{}</p><p>{}</p></div><div id=end>All rights reserved</div>"
    rows = [(i, f"http://h.org/{i}", page.format(f"first {i}", f"second {i}")) for i in range(6)] + [(9, "http://other.org/", page.format("lone", "page")), (10, None, None), (11, "http://h.org/x", ""), (3, "http://h.org/3", page.format("first 3", "second 3"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert html_text.main_text(df).count() == len(rows)
    assert got[2].text == "first 2\n\nsecond 2" and got[2].n_chars == 17
    assert got[9].text == "Welcome to the site\n\nlone\n\npage\n\nAll rights reserved"
    assert got[10].text == "" and got[11].text == "" and got[10].n_chars == 0
    assert html_text.main_text(df.limit(0)).count() == 0


def test_repeated_article_blocks_stay(spark):
    rows = [(i, "http://h.org/", f"<article><p>The same passage.</p><p>own {i}</p></article>") for i in range(4)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == f"The same passage.\n\nown {r.page_id}" for r in got)


def test_names_drop_no_element_with_the_story():
    story = "<h1>Head</h1><p>The whole of a story, long enough.</p>"
    want = "Head\n\nThe whole of a story, long enough."
    for page in ('<div class="content-sidebar-wrap">{}</div>', '<div class="layout has-sidebar">{}<div class="sidebar">Side</div></div>', '<article class="post has-comments">{}<div class="comments">Nice!</div></article>', '<div id="page-header-menu"><main>{}</main></div>'):
        assert html_text.extract(page.format(story), set()) == want
    assert html_text.extract('<div class="ad">A much longer advert than that.</div><article>Word</article>', set()) == "Word"
    assert html_text.extract('<div class="related"><article>Card</article></div><article>A story</article>', set()) == "A story"
    assert html_text.extract('<p>Both <span class="ad">Buy</span> stay</p>', set()) == "Both\n\nstay"
    assert html_text.extract('<div class="ad">' * 30_000 + "x", set()) == "x"


def texts_of_pages(spark, pages):
    rows = [(i, "http://h.org/", h) for i, h in enumerate(pages)]
    return {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


def test_classes_are_judged_whole(spark):
    """Shared blocks stay where they are no class of three tokens, or come in another order on each page."""
    lines = [f"<p>shared line {k}</p>" for k in range(4)]
    turned = lambda i: "".join(lines[i % 4 :] + lines[: i % 4])
    pages = [f"<div class=a>{turned(i)}</div><div class=b><p>own {i} a</p><p>own {i} b</p><p>own {i} c</p><p>own {i} d</p></div>" for i in range(8)]
    got = texts_of_pages(spark, pages)
    assert all(got[i].count("shared line") == 4 and f"own {i} d" in got[i] for i in range(8))
    fixed = texts_of_pages(spark, [p.replace(turned(i), turned(0)) for i, p in enumerate(pages)])
    assert all(t == "\n\n".join(f"own {i} {x}" for x in "abcd") for i, t in fixed.items())
    got = texts_of_pages(spark, [f"<p>alone</p><p>own {i}</p>" for i in range(6)])
    assert got[1] == "alone\n\nown 1"


def test_of_crossing_classes_the_smaller_goes():
    seen = [{"at": i, "token": i, "cls": c, "size": {1: 4, 2: 3, 3: 2}[c], "chars": 5} for i, c in enumerate((1, 3, 3, 2, 1, 2, 1, 2, 1))]
    assert {c: b for c, _, b in html_text.judged(seen)} == {1: [0, 4, 6, 8], 3: [1, 2]}


def test_copies_count_once_and_sections_have_templates(spark):
    """Copies are no template of each other, and the menu of a few pages is one."""
    got = texts_of_pages(spark, ["<div><p>The one story.</p><p>Its end.</p></div>"] * 5 + ["<div><p>Another story.</p></div>"])
    assert got[0] == got[4] == "The one story.\n\nIts end." and got[5] == "Another story."
    near = texts_of_pages(spark, ["<div>" + "".join(f"<p>line {k}</p>" for k in range(9)) + f"<p>copy {i}</p></div>" for i in range(5)])
    assert all(near[i].count("line") == 9 for i in near)
    menu = lambda s: "<div class=m><ul>" + "".join(f"<li>{s}{k}</li>" for k in range(3)) + "</ul></div>"
    got = texts_of_pages(spark, [menu("abcd"[i % 4]) + "".join(f"<p>page {i} has text {k}</p>" for k in range(3)) for i in range(16)])
    assert all(t == "\n\n".join(f"page {i} has text {k}" for k in range(3)) for i, t in got.items())


def test_the_template_decides_on_article_pages_too(spark):
    box = "<div class=by><p>By our staff</p><p>Write to us</p></div>"
    got = texts_of_pages(spark, [f"<body><article><h1>Head {i}</h1><p>Own text {i}</p><p>More of {i}</p>{box}</article></body>" for i in range(6)])
    assert all(t == f"Head {i}\n\nOwn text {i}\n\nMore of {i}" for i, t in got.items())
    assert html_text.extract("<div><p>The story is in a div beside a card.</p></div><article>Card</article>", set()) == "The story is in a div beside a card.\n\nCard"


def neutral_pages(n, seed=1, host="h.org"):
    """Pages without a telling name: a menu, an advert, the story and an end that all vary, in plain elements."""
    rng = random.Random(seed)
    words = lambda k: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(k))
    rows = []
    for i in range(n):
        story = [words(4), *(words(rng.randint(10, 40)) for _ in range(rng.randint(1, 4)))]
        menu = "".join(f"<li>{words(1)}" for _ in range(rng.randint(2, 5)))
        body = f"<h1>{story[0]}</h1><div class=x>{''.join(f'<p>{t}' for t in story[1:])}</div>"
        rows.append((i, f"http://{host}/{i}", f"<body><div><ul>{menu}</ul></div><div>{words(5)}</div><div>{body}</div><div>{words(4)}</div>", "\n\n".join(story)))
    return rows


def test_the_template_alone_finds_the_story(spark):
    """Without it, the text of the same pages is another."""
    rows = neutral_pages(12) + [(100 + i, u, h, t) for i, u, h, t in neutral_pages(2, 2, "few.org")]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for i, _, page, story in rows:
        assert html_text.extract(page, set()) != story
        assert (got[i] == story) == (i < 100)  # two pages show no template
    assert all(story in got[i] for i, _, _, story in rows)


def test_a_page_of_another_layout_keeps_its_story(spark):
    """Twenty pages have the story in the first div. One has a banner there and the story in the second, with and without an
    article element; one has a notice before the story; all keep it."""
    story = lambda k: " ".join(f"Sentence {j} of story {k} tells something of its own." for j in range(12))
    usual = {k: f"<body><div><p>{story(k)}</p></div><div><p>More of site {k}</p></div></body>" for k in range(20)}
    odd = {
        20: f"<body><div><p>A banner of the day</p></div><div><p>{story(20)}</p></div></body>",
        21: f"<body><div><p>A banner of the week</p></div><div><article><p>{story(21)}</p></article></div></body>",
        22: f"<body><div><p>Read this first</p></div><div><p>{story(22)}</p></div><div><p>More of site 22</p></div></body>",
    }
    rows = [(k, "http://two.example/x", h) for k, h in {**usual, **odd}.items()]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == story(k) for k in usual)
    assert all(story(k) in got[k] for k in odd) and got[21] == story(21)


def test_a_headline_of_the_site_opens_no_main_slot(spark):
    rows = [(i, u, f"<div class=wrap><h1>The Site</h1>{h}</div><div>{i} end</div>") for i, u, h, _ in neutral_pages(8)]
    rows = [(i, u, h.replace("<body>", "").replace("<h1>w", "<h2>w")) for i, u, h in rows]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("The Site" not in t and "end" not in t for t in got.values())
    assert html_text.within(html_text.parse("<div>" * 20_000 + "<h1>x</h1>" + "y</div>z" * 20_000), set(), set())


def test_slots_come_from_valid_classes(spark):
    """Names aside, a menu and an end that vary leave with the slots of the template; where the sections are in no
    class of three tokens there is no slot, and where a notice shifts them the page keeps its story."""
    df = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    text = lambda rows: {r.page_id: r.text for r in html_text.main_text(df(rows), hints=False).collect()}
    named = [(i, "http://h.org/", f"<body><nav><p>menu {i}</p></nav><article><h1>Head {i}</h1><p>{'story ' * 30}{i}</p></article><footer>{i} end</footer></body>") for i in range(6)]
    got = text(named)
    assert all(got[i] == f"Head {i}\n\n{'story ' * 30}{i}" for i in got)
    notice = (9, "http://h.org/", "<body><nav><p>Read this</p></nav>" + named[0][2].replace("<body>", "").replace("0", "9"))
    got = text([*named, notice])
    assert f"{'story ' * 30}9" in got[9] and all(got[i] == f"Head {i}\n\n{'story ' * 30}{i}" for i in range(6))
    few = [(i, "http://h.org/", f"<b>{i}</b><div>{'story ' * 30}{i}</div>") for i in range(6)]
    assert all(t == f"{i}\n\n{'story ' * 30}{i}" for i, t in text(few).items())


def test_fixed_furniture_is_a_class_without_any_section(spark):
    """Blocks in elements that names call boilerplate are tokens too: without names their class goes, main slots aside."""
    fixed = "<p>Home</p><p>About us</p><p>Write to us</p>"
    rows = [(i, "http://h.org/", f"{fixed}<p>story {i} begins here</p><p>and {i} ends there</p>") for i in range(6)]
    rows += [(10 + i, "http://n.org/", f"<nav>{fixed}</nav><p>story {i} begins here</p><p>and {i} ends there</p>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for hints in (True, False):
        got = {r.page_id: r.text for r in html_text.main_text(df, hints=hints).collect()}
        assert all(t == f"story {i % 10} begins here\n\nand {i % 10} ends there" for i, t in got.items())


def brute_templates(pages, support=0.5, hints=True):
    """Per content its template blocks and main slots, from whole occurrence vectors."""
    parsed = {h: html_text.parse(h, hints) for h in dict.fromkeys(pages)}
    vectors, n_of, chars, path, plain, slotted = defaultdict(dict), Counter(), {}, {}, Counter(), set()
    for h, p in parsed.items():
        for t, k in Counter(p.tokens).items():
            vectors[t][h] = k
            n_of[t] += k
        for b in p.blocks:
            chars[b.token], path[b.token] = len(b.text), b.slot
            plain[b.token] += not b.hint
        slotted |= {p.spots[i].token for i in p.slots()}
    repeats = defaultdict(lambda: [0, 0])
    for t in chars:
        repeats[path[t]][0] += n_of[t] * (len(vectors[t]) > 1)
        repeats[path[t]][1] += n_of[t]
    fixed = lambda t: len(vectors[t]) >= support * len(parsed) or 2 * repeats[path[t]][0] >= repeats[path[t]][1]
    classes = defaultdict(list)
    for t, v in vectors.items():
        if len(v) >= 3 and (t not in chars or fixed(t)):
            classes[tuple(sorted(v.items()))].append(t)
    good = {}
    for v, ts in classes.items():
        blocks, held = sum(plain[t] for t in ts), sum(chars.get(t, 0) * plain[t] for t in ts)
        own = [len(b.text) for h, _ in v for b in parsed[h].blocks if not b.hint]
        if len(ts) >= 3 and (blocks or slotted & set(ts)) and (2 * held <= sum(own) or 2 * blocks <= len(own)):
            good |= {t: (min(ts), len(ts), len(v)) for t in ts}
    orders, found = defaultdict(Counter), {}
    for h, p in parsed.items():
        ends = {p.spots[i].token: p.spots[i].end for i in p.slots()}
        events = [(i, 1, i, t) for t, i in {t: p.tokens.index(t) for t in p.tokens}.items() if t in good]
        events += [(ends[t], 0, -i, ~t) for _, _, i, t in list(events) if t in ends]
        seen = []
        for i, (_, opens, _, t) in enumerate(sorted(events)):
            own = good[t if opens else ~t]
            seen.append({"at": i, "token": t, "cls": own[0], "size": own[1], "chars": chars.get(t, 0)})
        found[h] = html_text.judged(seen)
        for c, o, _ in found[h]:
            orders[c][o] += 1
    pages_of = {c: n for c, _, n in good.values()}
    usual = {h: [(c, ts) for c, o, ts in found[h] if 2 * orders[c][o] > pages_of[c]] for h in parsed}
    below, text, count = Counter(), Counter(), Counter()
    slots = {h: {p.spots[i].token for i in p.slots() if good.get(p.spots[i].token, (None,))[0] in {c for c, _ in usual[h]}} for h, p in parsed.items()}
    for h, p in parsed.items():
        for s in p.spots:
            if s.token in slots[h]:
                below[s.token], text[s.token], count[s.token] = below[s.token] + s.chars, text[s.token] + p.spots[0].chars, count[s.token] + 1
    main = {s for s in count if count[s] >= 3 and 4 * below[s] >= 3 * text[s]}
    return {h: html_text.extract(h, {t for _, ts in usual[h] for t in ts}, main & slots[h], hints) for h in parsed}


def test_main_text_matches_brute_force(spark):
    rng = random.Random(11)
    pick = lambda: rng.choice(["<p>{}</p>", "<div>{}</div>", "<div class=a>{}</div>", "<h1>{}</h1>", "<section>{}</section>", "<li>{}"]).format(rng.choice(["one", "two words", "menu", "about us", "a longer line of text", f"own {rng.randint(0, 99)} text here"]))
    changed = 0
    pages = []
    for _ in range(6):
        frame = ["".join(pick() for _ in range(rng.randint(1, 4))) for _ in range(3)]
        pages.append([frame[0] + "<div class=m>" + "".join(pick() for _ in range(rng.randint(1, 8))) + "</div>" + rng.choice([frame[1], frame[2], ""]) + frame[rng.choice([1, 2])] for _ in range(rng.choice([2, 6, 15]))])
    rows = [(k * 100 + i, f"http://h{k}.org/", h) for k, ps in enumerate(pages) for i, h in enumerate(ps)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for hints in (True, False):
        got = {r.page_id: r.text for r in html_text.main_text(df, hints=hints).collect()}
        for k, ps in enumerate(pages):
            want = brute_templates(ps, hints=hints)
            for i, h in enumerate(ps):
                assert got[k * 100 + i] == want[h]
                changed += hints and want[h] != html_text.extract(h, set())
    assert changed > len(rows) / 4


# --- op6


def variants(seed, n):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows, i = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.randint(3, 90))]
        for _ in range(rng.randint(1, 6)):
            now = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                now[rng.randrange(len(now))] = word()
            rows.append((i, " ".join(now), "s"))
            i += 1
    return rows


def brute_classes(rows):
    sets, ids = [], [r[0] for r in rows]
    for _, t, _ in rows:
        w = decontamination.words_of(t or "")
        k = min(5, len(w))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for x, i in enumerate(ids):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, least[find(x)], links[x]) for x, i in enumerate(ids))


@pytest.mark.parametrize("block", [64, 2])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    """Blocks of two members deal even small groups over many tasks."""
    if block == 2:
        monkeypatch.setattr(near_duplicates, "GROUP_BLOCK", (2, 3))
        monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", (2, 2))
    rows = [(i, t, "s") for i, t in enumerate(TEXTS) if i != 0] + [(i + 100, t, s) for i, t, s in variants(3, 40)] + [(5, TEXTS[5], "s")]
    df = documents(spark, rows)
    got = near_duplicates.near_duplicates(df)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == brute_classes(rows)
    if block == 64:
        df = df.withColumn("a.b", F.lit("x")).withColumn("c`d", F.lit("y"))
        kept = near_duplicates.keep_firsts(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute_classes(rows)})
    assert near_duplicates.near_duplicates(empty(df)).count() == 0


def near_copies(n, words=60, seed=5):
    """Texts that differ in one word each from a common text."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for i in range(n):
        now = list(base)
        now[rng.randrange(words)] = f"own{i}"
        rows.append((i, " ".join(now), "s"))
    return rows


def test_a_group_is_shuffled_once_whatever_its_size(spark, monkeypatch):
    """Rows and bytes that blocks are dealt with grow with the group, not with its square, and nothing is missed."""
    monkeypatch.setattr(near_duplicates, "GROUP_BLOCK", (16, 16))
    monkeypatch.setattr(near_duplicates, "BUCKET_BLOCK", (16, 16))
    sizes = {}
    for n in (150, 300):
        folders = []
        monkeypatch.setattr(near_duplicates, "remove", lambda spark, f: folders.append(sum(p.stat().st_size for p in __import__("pathlib").Path(f.removeprefix("file://")).glob("*"))))
        rows = near_copies(n)
        got = near_duplicates.near_duplicates(documents(spark, rows)).collect()
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == brute_classes(rows)
        sizes[n] = sum(folders)
    assert 0 < sizes[300] < 2.5 * sizes[150]


def test_connecting_a_bucket_finds_the_components_of_all_pairs():
    rng = np.random.default_rng(4)
    least = near_duplicates.least_matches(0.8, 1e-5)
    for n, centres in ((120, 1), (120, 7), (90, 90)):
        base = rng.integers(0, 2**16, (centres, near_duplicates.HASHES), dtype=np.uint16)
        sigs = base[rng.integers(0, centres, n)]
        noise = rng.random(sigs.shape) < rng.choice([0.05, 0.2, 0.4], (n, 1))
        sigs = np.where(noise, rng.integers(0, 2**16, sigs.shape, dtype=np.uint16), sigs)
        every = np.arange(n)
        a, b = (x.ravel() for x in np.triu_indices(n, 1))
        want = near_duplicates.tied(n, *near_duplicates.surviving(sigs, a, b, least), every)
        assert (near_duplicates.tied(n, *near_duplicates.one_component(sigs, least), every) == want).all()


def test_exact_links_count_like_sets():
    rng = random.Random(12)
    universe = [rng.getrandbits(64) for _ in range(300)]
    sets = [np.array(sorted(rng.sample(universe, 260) if k % 3 else universe[:280]), np.uint64) for k in range(40)]
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(40) for j in range(i + 1, 40)], strict=True))
    want = [len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) - 1e-9 for i, j in zip(a, b, strict=True)]
    assert near_duplicates.exact_links(sets, a, b, 0.8).tolist() == want and 0 < sum(want) < len(want)
    assert near_duplicates.exact_links(sets, a[:5], b[:5], 0.8).tolist() == want[:5]


def test_posterior_table():
    least = near_duplicates.least_matches(0.8, 1e-5)
    for n, m in least.items():
        p = lambda k, n=n: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(k + 1))
        assert p(m) >= 1e-5 > p(m - 1)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(k, k + 1) for k in range(200, 240)] + [(500, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for e in edges for x in e if find(x) != x}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == want


# --- op7


def test_measures():
    m = dict(zip(quality_rules.METRICS, quality_rules.measure("a b c a b c x\n\na # é\na # é\n \n"), strict=True))
    assert m == {"n_words": 13, "word_chars": 13, "n_symbols": 2, "n_lines": 3, "n_dup_lines": 1, "n_repeat_words": 12}
    for text in TEXTS:
        text = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
        got = dict(zip(quality_rules.METRICS, quality_rules.measure(text), strict=True))
        assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), len(hit))


def test_rules_and_host_verdicts(spark, odd):
    good = " ".join(f"w{k}" for k in range(60))
    noisy = lambda share: good + " " + "*" * int(60 * share)
    rows = [(i, noisy(0.15), "bad.org") for i in range(40)] + [(100, good, "bad.org"), (101, good, "good.org"), (102, noisy(0.15), "good.org"), (103, noisy(0.15), None), (104, noisy(0.3), None), (105, noisy(0.3), "good.org"), (106, noisy(0.5), "good.org"), (107, noisy(0.15), "new.org")] + [(200 + i, good, "good.org") for i in range(60)]
    df = documents(spark, rows)
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert got[0].allowance == 1 and not got[0].kept  # over the limit where failures are frequent
    assert got[102].allowance == 4 and got[102].kept and got[105].kept and not got[106].kept  # where they are rare
    assert got[103].kept and not got[104].kept  # without a host, as on a usual one
    assert got[100].kept and got[101].kept
    assert got[107].host_rate < got[0].host_rate  # one failure of one is less evidence than forty of forty-one
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}
    assert quality_rules.keep_good(df).columns == df.columns
    out = quality_rules.quality_rules(odd)
    assert out.count() == odd.count() and all(r.kept <= (not r.base_failed) for r in out.collect())
    assert quality_rules.quality_rules(empty(odd)).count() == 0 and quality_rules.keep_good(empty(odd)).count() == 0


def test_verdicts_match_the_sql_where_hosts_differ(spark, tmp_path):
    """The query's SQL on a table of good, bad, small and unnamed hosts, where both kinds of verdict change rows."""
    import duckdb

    rng = random.Random(6)
    rows = []
    for i in range(900):
        host = rng.choice(["a", "b", "bad", "bad", f"small{i % 40}", None])
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([30, 80, 120]))]
        share = rng.choice([0.12, 0.25, 0.5]) if rng.random() < {"bad": 0.8, "a": 0.02}.get(host, 0.2) else 0
        rows.append((i, " ".join(words) + "#" * int(len(words) * share), host))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    from quire.llm import queries

    got = queries.op7_quality_rules(spark, str(tmp_path)).collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        want = db.execute(quality_rules.SQL).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want)
    host = {i: h for i, _, h in rows}
    gone = Counter(host[r.doc_id] for r in got if not r.base_failed and not r.kept)
    assert gone["bad"] > 50 and gone["b"] + gone[None] > 0


# --- op8


def brute_hits(text, items, width=10):
    words = decontamination.words_of(text or "")
    hit, found = set(), set()
    for item, t in items:
        w = decontamination.words_of(t or "")
        k = min(width, len(w))
        for a in range(len(w) - k + 1) if k else ():
            for i in range(len(words) - k + 1):
                if words[i : i + k] == w[a : a + k]:
                    hit |= set(range(i, i + k))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [8 << 20, 60])
def test_decontamination_matches_brute_force(spark, odd, part_bytes):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefg")
    items = [(i, " ".join(word() for _ in range(rng.choice([2, 3, 9, 10, 12])))) for i in range(8)] + [(20, None), (21, "..."), (22, "lorem IPSUM dolor"), (22, "lorem IPSUM dolor"), (None, "the end")]
    texts = [" ".join(word() for _ in range(60)) for _ in range(25)]
    df = odd.unionByName(documents(spark, [(1000 + i, t, "s") for i, t in enumerate(texts)]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontamination.find_benchmark(df, bench, part_bytes=part_bytes)
    got = {r.doc_id: r for r in decontamination.digest(found).collect()}
    want = {i: brute_hits(t, items) for i, t in text_by_id(df).items()}
    assert found.count() == df.count()
    for i, (n, hit, names) in want.items():
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(names), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    clean = decontamination.drop_contaminated(df, bench, part_bytes=part_bytes)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, (_, hit, _) in want.items() if not hit}
    assert not any(r.contaminated for r in decontamination.digest(decontamination.find_benchmark(df, bench.limit(0))).collect())
    assert decontamination.find_benchmark(empty(df), bench).count() == 0


def test_long_items_keep_each_window(monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    for n in (0, 1, 9, 10, 11, 16, 17, 18, 60):
        text = " ".join(f"w{k}" for k in range(n))
        windows = lambda w: [tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9)) if w]
        got = [w for p in decontamination.pieces_of(text, 10) for w in windows(decontamination.words_of(p))]
        assert got == windows(decontamination.words_of(text))


def test_one_part_is_held_at_a_time(monkeypatch):
    """However many parts there are, a worker's memory has one of them."""
    import weakref

    class Part(list):
        pass

    made = []

    def load(file):
        assert not [r for r in made if r() is not None]
        part = Part(decontamination.compile_items([(file, f"needle {file}")], 10))
        made.append(weakref.ref(part))
        return part

    from functools import lru_cache

    monkeypatch.setattr(decontamination, "matchers_of", lru_cache(1)(load))
    got = decontamination.searched(["a needle p3 and needle p7", "none"], [f"p{k}" for k in range(10)])
    assert [(n, s, sorted(i)) for n, s, i in got] == [(6, [(1, 3), (4, 6)], ["p3", "p7"]), (1, [], [])] and len(made) == 10


# --- op9


def test_bpe_is_the_librarys(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for frequent in (0, 30):
        got = bpe.bpe_encode(odd, path, frequent=frequent).collect()
        digests = {r.doc_id: r for r in bpe.bpe_digests(odd, path, frequent=frequent).collect()}
        assert len(got) == odd.count()
        texts = text_by_id(odd)
        for r in got:
            ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == tok.decode(ids, skip_special_tokens=False)
            d = digests[r.doc_id]
            assert (d.n_tokens, d.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
            assert d.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe.bpe_digests(empty(odd), path).count() == 0


def test_bpe_keeps_little_between_calls(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    enc = bpe.Encoder(path, None)
    monkeypatch.setattr(bpe, "KEPT_BYTES", 10_000)
    texts = ["".join(chr(97 + (i * k) % 26) for k in range(300)) + str(i) for i in range(60)]
    want = [a for a, _ in enc.encode(texts)]
    for k in range(0, 60, 5):
        assert [a for a, _ in enc.encode(texts[k : k + 5])] == want[k : k + 5]
        assert enc.size < 10_000 + 5 * 2_000 and sum(map(len, enc.known)) <= enc.size


def test_lexicon_holds_exactly_its_words():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))).encode() for _ in range(500)})
    lexicon = bpe.Lexicon(bpe.compile_words((w, (i, i + 1)) for i, w in enumerate(words)))
    known = {w: i for i, w in enumerate(words)}
    for length in range(1, 9):
        probes = [w for w in {*words, *(w + b"a" for w in words), *(w[:-1] for w in words)} if len(w) == length]
        if probes:
            ranks = lexicon.ranks(np.frombuffer(b"".join(probes), np.uint8).reshape(len(probes), length))
            assert ranks.tolist() == [known.get(w, -1) for w in probes]
    plain = sum(len(w) for w in words)
    assert len(lexicon.target) < plain / 2  # states are shared


# --- op10


def test_language_model(spark, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    extra = documents(spark, [(i + 50, "the cat sat on the mat", "s") for i in range(20)])
    df = odd.unionByName(extra)
    for hot in (50_000, 0):  # all words by broadcast, all words by join
        got = language_model.score_texts(df, path, hot=hot).collect()
        assert len(got) == df.count()
        texts = text_by_id(df)
        counts, n = Counter(), 0
        for r in df.select("doc_id", "text").collect():
            if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
                counts.update([*language_model.words_of(r.text or ""), None])
        n, v = sum(counts.values()), len(counts)
        for r in got:
            tokens = [*language_model.words_of(texts[r.doc_id] or ""), None]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        scores = {r.doc_id: r.score for r in got}
        if hot:
            before = scores
    assert scores == pytest.approx(before, rel=1e-9)
    assert language_model.score_texts(empty(df), path).count() == 0


def test_marginal_is_the_sum_over_segmentations():
    p = language_model.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    weights = language_model.log_weights(p, p.first)

    def total(word, i=0):
        if i == len(word):
            return 1.0
        s = sum(math.exp(weights[k]) * total(word, j) for j in range(i + 1, len(word) + 1) if (k := p.names.get(word[i:j])) is not None)
        return s + (math.exp(language_model.spelled(p, weights, ord(word[i]))) * total(word, i + 1) if word[i] not in p.names else 0)

    words = ["the", "thing", "é", "日本", "x&&&", "a🙂b", "q" * 45]
    gains = np.zeros(p.size)
    got = language_model.word_log_probabilities(p, words, weights, np.ones(len(words)), gains)
    for w, lp in zip(words[:-1], got, strict=False):
        assert lp == pytest.approx(math.log(total("▁" + w)))
    long = language_model.long_log_probability(p, "▁" + words[-1], weights)
    assert got[-1] == pytest.approx(long)
    assert np.isfinite(got).all() and (gains >= 0).all()
    # expected pieces spell each word's characters
    names = {i: n for n, i in p.names.items()}
    spelled = sum(g * len(names[i]) for i, g in enumerate(gains) if i in names)
    bytes_ = sum(g for i, g in enumerate(gains) if i in p.bytes)
    assert spelled + bytes_ == pytest.approx(sum(len(w) + 1 for w in words) + 3, abs=6)
