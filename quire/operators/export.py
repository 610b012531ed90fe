"""Export of books: nested records, plain text, manifests and one index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.text import or_empty, strip, truthy

PROVENANCE = ("model", "prompt_version", "app_version", "media_resolution", "render_dpi", "image_format", "machine_id", "key_label", "input_tokens", "output_tokens", "latency_ms")


def have(df: DataFrame, name: str, default: Column | None = None) -> Column:
    """A column, or ``default`` where the table hasn't got it."""
    return F.col(name) if name in df.columns else (F.lit(None).cast("string") if default is None else default)


def records(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Per page: book_id, page_no and the nested record. Missing columns count as null."""
    book = books.select(F.col("id").alias("book_id"), F.struct("id", "title", *[have(books, c).alias(c) for c in ("file_name", "rel_path", "fingerprint")]).alias("__book"))
    p = pages.join(book, "book_id")
    text = lambda c: or_empty(have(p, c)).alias(c)
    flag = have(p, "has_uncertain_text", F.lit(False))
    record = F.struct(
        F.col("__book").alias("book"),
        F.col("page_no").cast("int").alias("pdf_page_number"),
        truthy(have(p, "printed_page_number")).alias("printed_page_number"),
        have(p, "page_type").alias("page_type"),
        have(p, "transcription").alias("transcription"),
        text("footnotes"),
        F.coalesce(have(p, "languages", F.array().cast("array<string>")), F.array().cast("array<string>")).alias("languages"),
        "status",
        flag.alias("has_uncertain_text"),
        text("note"),
        text("flag_reason"),
        have(p, "attempts", F.lit(0)).alias("attempts"),
        text("last_error"),
        F.struct(*[have(p, c).alias(c) for c in PROVENANCE], have(p, "updated_at", F.lit(None).cast("double")).alias("transcribed_at")).alias("provenance"),
    )
    return p.select("book_id", "page_no", record.alias("record"))


def json_lines(exported: DataFrame) -> DataFrame:
    """book_id, page_no, value: one JSON object a page, nulls written."""
    return exported.select("book_id", "page_no", F.to_json("record", {"ignoreNullFields": "false"}).alias("value"))


def page_text(pages: DataFrame) -> Column:
    text = strip(or_empty(F.col("transcription")))
    body = F.when(text != "", text).otherwise(F.concat(F.lit("["), F.upper(F.coalesce(truthy(F.col("page_type")), F.lit("no text"))), F.lit("]")))
    notes = truthy(have(pages, "footnotes"))
    done = F.concat(body, or_empty(F.concat(F.lit("\n\n[Footnotes]\n"), strip(notes))))
    shown = F.when(F.col("status").isin(*fixed.FINISHED), done).otherwise(F.concat(F.lit("[not transcribed: "), F.col("status"), F.lit("]")))
    return F.concat(F.lit("\n--- PDF page "), F.col("page_no").cast("string"), F.lit(" ---\n"), shown)


def text_head() -> Column:
    return F.concat_ws("\n", "title", F.expr("repeat('=', length(title))"), F.concat(F.lit("Source: "), "rel_path"), F.concat(F.col("total_pages").cast("string"), F.lit(" pages")), F.lit(""))


def plain_text_parts(pages: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, place, value: the head (place 0) and each page. Written in order of place by ``sources.store.write_named``
    they are the book's text, whatever its size: no book is ever held as a whole."""
    head = books.select(F.col("id").alias("book_id"), F.lit(0).cast("long").alias("place"), text_head().alias("value"))
    return head.union(pages.select("book_id", F.col("page_no").cast("long"), page_text(pages)))


def plain_text(pages: DataFrame, books: DataFrame) -> DataFrame:
    """book_id, text: a title, its underline, the source, the number of pages, then every page in order. For books
    that fit into a row; else see ``plain_text_parts``."""
    bodies = pages.select("book_id", F.struct("page_no", page_text(pages).alias("t")).alias("p")).groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n").alias("body"))
    joined = books.withColumnRenamed("id", "book_id").join(bodies, "book_id", "left")
    return joined.select("book_id", F.concat_ws("\n", text_head(), "body").alias("text"))


def manifests(pages: DataFrame, books: DataFrame) -> DataFrame:
    """Per book: counts of the statuses that occur (a map), token sums. Two sums in a row, a map of few statuses."""
    per = pages.groupBy("book_id", "status").agg(F.count("*").alias("n"), F.sum(have(pages, "input_tokens", F.lit(0))).alias("i"), F.sum(have(pages, "output_tokens", F.lit(0))).alias("o"))
    counts = per.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("page_status_counts"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"))
    none = F.from_json(F.lit("{}"), "map<string,bigint>")
    return books.withColumnRenamed("id", "book_id").join(counts, "book_id", "left").withColumns({"page_status_counts": F.coalesce("page_status_counts", none), "input_tokens": F.coalesce("input_tokens", F.lit(0)), "output_tokens": F.coalesce("output_tokens", F.lit(0))})


def manifest_json(manifest: DataFrame) -> Column:
    return F.to_json(F.struct("book_id", *[have(manifest, c).alias(c) for c in ("title", "file_name", "rel_path", "fingerprint", "file_size")], "total_pages", "page_status_counts", F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output")).alias("tokens")), {"ignoreNullFields": "false"})


def index_parts(manifest: DataFrame, summary: DataFrame, file: str = "index.json") -> DataFrame:
    """file, place, value of the index for ``sources.store.write_named``: a head, a line a book, an end. No task holds
    more than a line, however many books there are."""
    counts = manifest.agg(F.count("*").alias("n"), F.min("book_id").alias("least"))
    queue = summary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("queue"))  # a few statuses
    row = lambda place, value: (F.lit(file).alias("file"), place.cast("long").alias("place"), value.alias("value"))
    head = counts.crossJoin(queue).select(*row(F.lit(-(2**63)), F.concat(F.lit('{"book_count":'), F.col("n").cast("string"), F.lit(',"queue":'), "queue", F.lit(',"books":['))))
    line = F.to_json(F.struct("book_id", "title", "total_pages", "page_status_counts"))
    lines = manifest.crossJoin(F.broadcast(counts)).select(*row(F.col("book_id"), F.concat(F.when(F.col("book_id") == F.col("least"), "").otherwise(","), line)))
    end = counts.select(*row(F.lit(2**63 - 1), F.lit("]}")))
    return head.union(lines).union(end)


def index(manifest: DataFrame, summary: DataFrame) -> DataFrame:
    """One JSON text over all manifests and the queue's counts, for as many books as fit into a row; else see
    ``index_parts``."""
    line = F.struct("book_id", F.to_json(F.struct("book_id", "title", "total_pages", "page_status_counts")).alias("json"))
    books = manifest.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("books"))
    queue = summary.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n"))))).alias("queue"))
    listed = F.array_join(F.transform("books", lambda b: b["json"]), ",")
    return books.crossJoin(queue).select(F.concat(F.lit('{"book_count":'), F.col("n").cast("string"), F.lit(',"queue":'), "queue", F.lit(',"books":['), listed, F.lit("]}")).alias("value"))
