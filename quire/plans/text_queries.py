"""Queries of the quality gate, selection, naming, publishing and export, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import classify, fixed, prompts, quality, text
from quire.operators import export, naming, publish, selection, views
from quire.plans.roles import documents, numbered, table, with_roles
from quire.sources import files

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SPACE = text.SPACE
STRIP = lambda x: rf"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
PROBE = "substring(t, CAST(floor(length(t) / 2) AS BIGINT) + 1, 40)"
REASON = rf"""CASE WHEN length(t) < 20 THEN 'Classified as text but only ' || length(t) || ' characters were returned'
  WHEN length(t) >= 160 AND length({STRIP(PROBE)}) > 0 AND (length(t) - length(replace(t, {PROBE}, ''))) // 40 >= 4 THEN '{fixed.LOOP}'
  WHEN (length(t) - length(replace(t, '[illegible]', ''))) > 0.25 * length(t) THEN '{fixed.TOO_ILLEGIBLE}'
  WHEN regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN '{fixed.HAS_CONTROL}' ELSE '' END"""
GATED = rf"gated AS (SELECT *, {REASON} AS flag_reason FROM (SELECT *, {STRIP('transcription')} AS t FROM docs))"


def gated(spark, sf_dir):
    return quality.gate(documents(spark, sf_dir))


@query(with_roles(f"--{GATED} SELECT doc_id, CASE WHEN flag_reason = '' THEN 'done' ELSE 'flagged' END AS status, flag_reason FROM gated", "docs"))
def quality_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("doc_id", "status", "flag_reason")


@query(with_roles(f"--{GATED} SELECT book, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (flag_reason = '') AS BIGINT) AS done, CAST(count(*) FILTER (flag_reason <> '') AS BIGINT) AS flagged FROM gated GROUP BY book", "docs"))
def quality_by_source(spark, sf_dir):
    return gated(spark, sf_dir).groupBy("book").agg(F.count("*").alias("pages"), F.count_if(F.col("flag_reason") == "").alias("done"), F.count_if(F.col("flag_reason") != "").alias("flagged"))


@query(with_roles(f"--{GATED} SELECT doc_id, CASE WHEN quality IS NULL THEN 'pending' WHEN flag_reason = '' AND quality = 1 THEN 'done' ELSE 'flagged' END AS status FROM gated LEFT JOIN labels USING (doc_id)", "docs"))
def review_status(spark, sf_dir):
    joined = gated(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.select("doc_id", F.when(F.col("quality").isNull(), "pending").when((F.col("flag_reason") == "") & (F.col("quality") == 1), "done").otherwise("flagged").alias("status"))


@query(
    with_roles(
        """--r AS (SELECT book_id, page_no, n_chars BETWEEN 500 AND 2500 AS hit, CASE WHEN n_chars < 30 THEN 1 END AS bad, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS a FROM numbered),
        s AS (SELECT *, hit AND page_no > 15 AND a - 15 <= 20 AS body, hit AND a <= 20 AS any_ FROM r),
        b AS (SELECT book_id, bool_or(body) AS has FROM s GROUP BY book_id),
        h AS (SELECT s.book_id, page_no, has, row_number() OVER (PARTITION BY s.book_id ORDER BY page_no) AS n FROM s JOIN b ON s.book_id = b.book_id WHERE CASE WHEN has THEN body ELSE any_ END)
        SELECT b.book_id, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER (n <= 3), '') AS pages, CASE WHEN any_value(b.has) THEN 'after front matter' WHEN count(page_no) > 0 THEN 'whole book (fallback)' ELSE 'no text pages found' END AS strategy
        FROM b LEFT JOIN h ON b.book_id = h.book_id GROUP BY b.book_id""",
        "numbered",
    )
)
def select_text_pages(spark, sf_dir):
    """A document is text between 500 and 2,500 characters; 20 pages are inspected, 3 taken."""
    p = numbered(spark, sf_dir).select("book_id", "page_no", F.when(F.col("n_chars") >= 30, F.col("n_chars").between(500, 2500)).alias("is_text"))
    got = selection.select_text_pages(p, 3, 15, 20)
    return got.select("book_id", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"), "strategy")


@query(
    """WITH n AS (SELECT p_partkey AS id, left(p_name, 95) AS t, p_name, count(*) OVER (PARTITION BY left(p_name, 95)) AS k FROM part)
    SELECT id, CASE WHEN k = 1 THEN t ELSE left(p_name, 95 - length(' (' || id || ')')) || ' (' || id || ')' END AS tab FROM n"""
)
def tab_names(spark, sf_dir):
    return naming.tab_names(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))).select("id", "tab")


@query(
    rf"""WITH c AS (SELECT item_id AS id, regexp_replace(regexp_replace({STRIP("text")}, '[^\p{{L}}\p{{N}} ._-]', '_', 'g'), '{SPACE}+', ' ', 'g') AS s FROM benchmark),
    n AS (SELECT id, left(CASE WHEN s = '' THEN 'book' ELSE s END, 120) AS s FROM c), k AS (SELECT *, count(*) OVER (PARTITION BY s) AS k FROM n)
    SELECT id, CASE WHEN k = 1 THEN s ELSE s || '_' || id END AS stem FROM k"""
)
def safe_stems(spark, sf_dir):
    return naming.file_stems(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))).select("id", "stem")


@query(r"SELECT s_suppkey AS id, left(trim(regexp_replace(s_name || ': [x]*?/', '[:\\/?*\[\]]', '', 'g')), 95) AS title FROM supplier")
def sheet_titles(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.sheet_title(F.concat("s_name", F.lit(": [x]*?/"))).alias("title"))


def _cut(n: int) -> str:
    w = f"left(r{n}, 4500)"
    nl, sp = (f"(CASE WHEN instr(reverse({w}), {c}) = 0 THEN -1 ELSE length({w}) - instr(reverse({w}), {c}) END)" for c in ("chr(10)", "' '"))
    return f"(CASE WHEN {nl} >= 2250 THEN {nl} WHEN {sp} >= 2250 THEN {sp} ELSE 4500 END)"


def _step(n: int) -> str:
    return f"""s{n + 1} AS (SELECT *, CASE WHEN length(r{n}) <= 4500 THEN r{n} ELSE left(r{n}, {_cut(n)}) END AS c{n + 1},
      CASE WHEN length(r{n}) <= 4500 THEN '' ELSE regexp_replace(substring(r{n}, {_cut(n)} + 1), '^\\n+', '') END AS r{n + 1} FROM s{n})"""


CELLS = f"""s0 AS (SELECT *, transcription AS r0 FROM docs), {_step(0)}, {_step(1)}, {_step(2)}, {_step(3)},
  cells AS (SELECT *, length(r4) > 0 AS truncated, CASE WHEN length(r4) > 0 THEN left(c4, {4500 - len(fixed.TRUNCATED)}) || chr(10) || chr(10) || '{fixed.TRUNCATED.strip()}' ELSE c4 END AS last FROM s4)"""


@query(with_roles(f"--{CELLS} SELECT doc_id, c1, c2, c3, last AS c4, truncated FROM cells", "docs"))
def split_cells(spark, sf_dir):
    cells, left = text.split_cells(F.col("transcription"), 4, 4500)
    return documents(spark, sf_dir).withColumn("x", cells).select("doc_id", *[F.col("x")[i].alias(f"c{i + 1}") for i in range(4)], left.alias("truncated"))


def rows(spark, sf_dir):
    return publish.publish_rows(gated(spark, sf_dir).withColumn("note", F.lit("")), 4500)


@query(with_roles(f"--{GATED}, {CELLS} SELECT book_id, page_no, page_type, CAST(length(c1) + length(c2) + length(c3) + length(last) AS BIGINT) AS chars, md5(concat_ws('|', c1, c2, c3, last)) AS cells_md5, flag_reason AS note, CASE WHEN flag_reason = '' THEN 'done' ELSE 'flagged' END AS status, truncated FROM cells JOIN (SELECT doc_id, flag_reason FROM gated) USING (doc_id)", "docs"))
def publish_rows(spark, sf_dir):
    return rows(spark, sf_dir).select("book_id", "page_no", "page_type", F.aggregate("cells", F.lit(0).cast("long"), lambda n, c: n + F.length(c)).alias("chars"), F.md5(F.array_join("cells", "|")).alias("cells_md5"), "note", "status", "truncated")


@query(
    with_roles(
        """--n AS (SELECT book_id, page_no, n_chars, row_number() OVER (PARTITION BY book_id ORDER BY page_no) AS i FROM numbered),
        w AS (SELECT book_id, page_no, i, n_chars, 0 AS chunk, 1 AS k, n_chars AS held FROM n WHERE i = 1
          UNION ALL SELECT n.book_id, n.page_no, n.i, n.n_chars, CASE WHEN w.k >= 15 OR w.held + n.n_chars > 20000 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.k >= 15 OR w.held + n.n_chars > 20000 THEN 1 ELSE w.k + 1 END,
          CASE WHEN w.k >= 15 OR w.held + n.n_chars > 20000 THEN n.n_chars ELSE w.held + n.n_chars END FROM w JOIN n ON n.book_id = w.book_id AND n.i = w.i + 1)
        SELECT book_id, CAST(page_no AS INTEGER) AS page_no, chunk, chunk = max(chunk) OVER (PARTITION BY book_id) AS is_final FROM w""",
        "numbered",
    )
)
def publish_chunks(spark, sf_dir):
    got = publish.chunks(numbered(spark, sf_dir).select("book_id", "page_no", F.col("n_chars").alias("chars")), 15, 20_000)
    return got.select("book_id", "page_no", "chunk", "is_final")


@query(with_roles(f"--{CELLS} SELECT book_id AS id, CAST(count(*) AS BIGINT) AS written, CAST(count(*) FILTER (c2 <> '' OR c3 <> '' OR last <> '') AS BIGINT) AS split_pages, CAST(count(*) FILTER (truncated) AS BIGINT) AS truncated_pages FROM cells GROUP BY book_id", "docs"))
def publish_index(spark, sf_dir):
    books = documents(spark, sf_dir).groupBy(F.col("book_id").alias("id")).agg(F.min("book").alias("title"), F.count("*").alias("total_pages"))
    return publish.index_rows(books, rows(spark, sf_dir)).select("id", "written", "split_pages", "truncated_pages")


@query("SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS v FROM orders")
def sheet_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    new = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("new").alias("v"))
    return publish.upsert(o.select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v")), new, ["k"])


def doc_books(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.groupBy(F.col("book_id").alias("id")).agg(F.min("book").alias("title"), F.min("book").alias("file_name"), F.min("book").alias("rel_path"), F.count("*").alias("total_pages"))


@query(with_roles(f"--{GATED} SELECT doc_id, book_id, book AS title, page_no AS pdf_page_number, CAST(NULL AS VARCHAR) AS printed_page_number, page_type, md5(transcription) AS text_md5, CASE WHEN flag_reason = '' THEN 'done' ELSE 'flagged' END AS status, flag_reason FROM gated", "docs"))
def export_record(spark, sf_dir):
    """The JSON lines are parsed again, so what is compared has been through them."""
    lines = export.json_lines(export.records(gated(spark, sf_dir), doc_books(spark, sf_dir)))
    kind = "book struct<id: long, title: string>, pdf_page_number long, printed_page_number string, page_type string, transcription string, status string, flag_reason string"
    ids = documents(spark, sf_dir).select("doc_id", "book_id", "page_no")
    got = lines.withColumn("r", F.from_json("value", kind)).join(ids, ["book_id", "page_no"])
    return got.select("doc_id", "book_id", F.col("r.book.title").alias("title"), "r.pdf_page_number", "r.printed_page_number", "r.page_type", F.md5("r.transcription").alias("text_md5"), "r.status", "r.flag_reason")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, chr(10) || '--- PDF page ' || turn || ' ---' || chr(10) || CASE WHEN role = 'system' THEN '[not transcribed: pending]' WHEN {STRIP("text")} = '' THEN '[TEXT]' ELSE {STRIP("text")} END AS p FROM conversations)
    SELECT conv_id AS book_id, md5('Conversation ' || conv_id || chr(10) || repeat('=', length('Conversation ' || conv_id)) || chr(10) || 'Source: c/' || conv_id || chr(10) || count(*) || ' pages' || chr(10) || chr(10) || string_agg(p, chr(10) ORDER BY turn)) AS text_md5 FROM t GROUP BY conv_id"""
)
def export_text(spark, sf_dir):
    """Conversations as books: turns are pages, system turns are still pending."""
    c = table(spark, sf_dir, "conversations")
    p = c.select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page_no"), F.when(F.col("role") == "system", "pending").otherwise("done").alias("status"), F.lit("text").alias("page_type"), F.col("text").alias("transcription"))
    b = c.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("total_pages")).withColumns({"title": F.concat(F.lit("Conversation "), "id"), "rel_path": F.concat(F.lit("c/"), "id")})
    return export.plain_text(p, b).select("book_id", F.md5("text").alias("text_md5"))


@query(with_roles(f"--{GATED} SELECT book_id, CAST(count(*) FILTER (flag_reason = '') AS BIGINT) AS done, CAST(count(*) FILTER (flag_reason <> '') AS BIGINT) AS flagged, CAST(sum(n_chars) AS BIGINT) AS input_tokens, CAST(sum(page_no) AS BIGINT) AS output_tokens FROM gated GROUP BY book_id", "docs"))
def export_manifest(spark, sf_dir):
    """Characters and page numbers stand for tokens."""
    p = gated(spark, sf_dir).withColumns({"input_tokens": F.col("n_chars"), "output_tokens": F.col("page_no").cast("long")})
    m = export.manifests(p, doc_books(spark, sf_dir))
    n = lambda s: F.coalesce(F.try_element_at("page_status_counts", F.lit(s)), F.lit(0)).alias(s)
    return m.select("book_id", n("done"), n("flagged"), "input_tokens", "output_tokens")


@query(with_roles(f"--{GATED} SELECT CAST(count(DISTINCT book_id) AS BIGINT) AS book_count, CAST(count(*) FILTER (flag_reason = '') AS BIGINT) AS done, CAST(count(*) AS BIGINT) AS total FROM gated", "docs"))
def export_index(spark, sf_dir):
    from quire.operators.queue import queue_summary

    g = gated(spark, sf_dir)
    got = export.index(export.manifests(g, doc_books(spark, sf_dir)), queue_summary(g)).withColumn("r", F.from_json("value", "book_count long, queue map<string,bigint>"))
    return got.select("r.book_count", F.col("r.queue")["done"].alias("done"), F.col("r.queue")["total"].alias("total"))


@query(
    """WITH b AS (SELECT doc_id, encode(text) AS c, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, 'quick:' || sha256(encode(CAST(n AS VARCHAR)) || c[1:1024] || CASE WHEN n > 2048 THEN c[n - 1023:n] ELSE ''::BLOB END) AS quick, 'sha256:' || sha256(c) AS whole FROM b"""
)
def fingerprint(spark, sf_dir):
    """Head and tail of 1 KiB."""
    c = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", files.fingerprint(c, head=1024).alias("quick"), files.fingerprint(c, full=True).alias("whole"))


@query(r"SELECT page_id, url FROM pages WHERE regexp_matches(url, '/fr/') AND NOT list_contains(string_split(url, '/')[1:len(string_split(url, '/')) - 1], 'en')")
def scan_filter(spark, sf_dir):
    """Addresses as paths: below /fr/, not below a folder named en."""
    p = table(spark, sf_dir, "pages")
    return p.filter(files.wanted(F.col("url"), suffix="", skip_dirs=("en",)) & F.col("url").contains("/fr/")).select("page_id", "url")


@query("SELECT p_partkey AS id, regexp_replace(string_split(replace('a\\b/' || p_name || '.v1.PDF', '\\', '/'), '/')[-1], '\\.[^.]*$', '') AS title FROM part")
def path_stems(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.stem_of(F.concat(F.lit("a\\b/"), "p_name", F.lit(".v1.PDF"))).alias("title"))


@query(
    """SELECT doc_id, CASE WHEN source = 'src0' THEN 'A page of an old printed book follows; nothing is known beforehand about its language, writing or age.'
    ELSE 'A page of ' || CASE WHEN source = 'src1' THEN 'an old book' ELSE 'a 17th-century book' END || ' mainly in ' || lang || CASE WHEN source = 'src2' THEN ', written in Gujarati script' ELSE '' END || ' follows.' || CASE WHEN source = 'src3' THEN ' It also has passages in Latin, Greek.' ELSE '' END END AS prompt FROM documents"""
)
def profile_prompt(spark, sf_dir):
    src = F.col("source")
    profile = F.struct(F.col("lang").alias("primary_language"), F.when(src == "src3", F.array(F.lit("Latin"), F.lit("Greek"))).alias("other_languages"), F.when(src == "src2", "Gujarati").otherwise("latin").alias("script"), F.when(src == "src1", " Unknown ").otherwise("17th-century").alias("era"), F.lit("").alias("typeface"), F.lit(None).cast("string").alias("orthographic_notes"))
    known = F.when(src != "src0", classify.profile_fields(profile))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.describe(known).alias("prompt"))


@query(
    """WITH v AS (SELECT vec_id, unnest(embedding) AS x FROM embeddings), q AS (SELECT vec_id, CAST(least(255, greatest(0, floor(x * 256 + 128))) AS INTEGER) AS level FROM v),
    h AS (SELECT vec_id, level, count(*) AS n FROM q GROUP BY vec_id, level), t AS (SELECT vec_id, sum(n) AS total, sum(n * level) AS mass FROM h GROUP BY vec_id),
    c AS (SELECT h.vec_id, level, total, mass, sum(n) OVER w AS k, sum(n * level) OVER w AS s FROM h JOIN t ON h.vec_id = t.vec_id WINDOW w AS (PARTITION BY h.vec_id ORDER BY level)),
    b AS (SELECT vec_id, level, k * (total - k) * power(s / k - (mass - s) / (total - k), 2) AS score FROM c WHERE k < total)
    SELECT t.vec_id AS vec_id, CAST(coalesce((SELECT b.level FROM b WHERE b.vec_id = t.vec_id ORDER BY round(score, 6) DESC, b.level LIMIT 1), 128) AS INTEGER) AS level FROM t"""
)
def otsu_levels(spark, sf_dir):
    """Vectors as little grey images, with the histogram form: running sums per image over at most 256 levels."""
    from pyspark.sql import Window as W

    v = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    level = F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.col("x").cast("double") * 256 + 128))).cast("int")
    h = v.groupBy("vec_id", level.alias("level")).agg(F.count("*").alias("n"))
    w, whole = W.partitionBy("vec_id").orderBy("level"), W.partitionBy("vec_id")
    c = h.select("vec_id", "level", F.sum("n").over(w).alias("k"), F.sum(F.col("n") * F.col("level")).over(w).alias("s"), F.sum("n").over(whole).alias("total"), F.sum(F.col("n") * F.col("level")).over(whole).alias("mass"))
    light = F.col("total") - F.col("k")
    score = F.when(light > 0, F.round(F.col("k") * light * F.pow(F.col("s") / F.col("k") - (F.col("mass") - F.col("s")) / light, 2), 6))
    best = c.withColumn("score", score).groupBy("vec_id").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("level")).alias("minus")))).alias("b"))
    return best.select("vec_id", F.coalesce(-F.col("b.minus"), F.lit(128)).alias("level"))


@query(
    r"""SELECT event_id, CASE event_type WHEN 'error' THEN 'RateLimited' WHEN 'signup' THEN CASE WHEN value > 50 THEN 'KeyRejected' ELSE 'TransientError' END WHEN 'click' THEN CASE WHEN value > 50 THEN 'KeyRejected' ELSE 'BadResponse' END WHEN 'view' THEN 'TransientError' ELSE 'BadResponse' END AS kind,
    CASE WHEN event_type = 'error' AND value > 20 THEN value END AS retry_after FROM events"""
)
def error_classification(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    status = F.create_map(*[F.lit(x) for x in ("error", 429, "signup", 403, "click", 400, "view", 503, "purchase", 404)])[F.col("event_type")]
    body = F.when(F.col("value") > 50, "PERMISSION_DENIED: no").otherwise("Host not in allowlist")
    headers = F.create_map(F.lit("Retry-After"), F.when(F.col("value") > 20, F.col("value").cast("string")).otherwise("soon"))
    return e.withColumn("f", classify.failure(status, body, headers)).select("event_id", "f.kind", "f.retry_after")


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS input_tokens, CAST(CASE event_type WHEN 'click' THEN 7 ELSE 0 END AS BIGINT) AS output_tokens FROM events"""
)
def token_usage(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", F.concat(F.lit('{"usage":{"input_tokens":'), k, F.lit(',"output_tokens":7}}')))
        .when(kind == "view", '{"usage":3}')
        .when(kind == "error", F.concat(F.lit('{"usage_metadata":{"input_tokens":0,"prompt_token_count":'), k, F.lit("}}")))
        .otherwise(F.concat(F.lit('{"usage":null,"usageMetadata":{"promptTokenCount":'), k, F.lit("}}")))
    )
    return table(spark, sf_dir, "events").withColumn("u", classify.token_usage(raw)).select("event_id", F.col("u.input").alias("input_tokens"), F.col("u.output").alias("output_tokens"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'text' WHEN 'view' THEN 'blank' END AS page_type, CASE event_type WHEN 'error' THEN 'no output step' WHEN 'signup' THEN 'not valid JSON' WHEN 'purchase' THEN 'no page type' END AS error FROM events")
def page_payload(spark, sf_dir):
    kind = F.col("event_type")
    text_ = F.when(kind == "click", '{"page_type":"text","transcription":"x"}').when(kind == "view", '```json\n{"page_type":"blank"}\n```').when(kind == "signup", "{oops").otherwise('{"transcription":"x"}')
    steps = F.array(F.struct(F.lit("thought").alias("type"), F.array(F.struct(F.lit("text").alias("type"), F.lit("hm").alias("text"))).alias("content")), F.struct(F.when(kind == "error", "other").otherwise("model_output").alias("type"), F.array(F.struct(F.lit("text").alias("type"), text_.alias("text"))).alias("content")))
    e = classify.with_payload(table(spark, sf_dir, "events"), F.struct(steps.alias("steps")), "p")
    return e.select("event_id", F.col("p.result.page_type").alias("page_type"), F.col("p.error").alias("error"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'image/png' WHEN 'de' THEN 'image/jpeg' WHEN 'fr' THEN 'image/webp' ELSE 'image/png' END AS mime FROM documents")
def image_mime(spark, sf_dir):
    kind = F.when(F.col("lang") == "en", "PNG").when(F.col("lang") == "de", "jpg").when(F.col("lang") == "fr", "webp").otherwise("bmp")
    return table(spark, sf_dir, "documents").select("doc_id", classify.mime_type(kind).alias("mime"))


@query(rf"SELECT doc_id, left(regexp_replace({STRIP('text')}, '{SPACE}+', ' ', 'g'), 300) AS preview FROM documents")
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id AS page_no, length(text) > 0 AS has_text FROM documents")
def sheet_status(spark, sf_dir):
    return views.sheet_status(rows(spark, sf_dir)).select("page_no", "has_text")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'HTTP 500' WHEN 'error' THEN 'the answer isn''t JSON' WHEN 'signup' THEN 'no such tab' ELSE 'the receiver reported an error' END AS wrong FROM events")
def publish_answers(spark, sf_dir):
    kind = F.col("event_type")
    body = F.when(kind == "click", '{"ok":true}').when(kind == "error", "<html>").when(kind == "signup", '{"ok":false,"error":"no such tab"}').otherwise('{"ok":false}')
    return table(spark, sf_dir, "events").select("event_id", publish.accepted(F.when(kind == "view", 500).otherwise(200), body).alias("wrong"))
