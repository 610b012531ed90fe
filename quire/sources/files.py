"""Sources: scanned folders, fingerprints, key lists, backups, .env files and pluggable page functions."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from http.client import HTTPException

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import fixed
from quire.functions.text import stem_of
from quire.sources.store import paths_under

HEAD = 1 << 20


def fingerprint(content: Column, full: bool = False, head: int = HEAD) -> Column:
    """``sha256:`` of everything, or ``quick:`` of the size, the head, and the tail of files over twice the head."""
    if full:
        return F.concat(F.lit("sha256:"), F.sha2(content, 256))
    n = F.octet_length(content)
    tail = F.when(n > 2 * head, F.substring(content, n - head + 1, F.lit(head))).otherwise(F.lit(b""))
    return F.concat(F.lit("quick:"), F.sha2(F.concat(F.encode(n.cast("string"), "UTF-8"), F.substring(content, 1, head), tail), 256))


def wanted(rel_path: Column, suffix: str = ".pdf", skip_dirs: tuple[str, ...] = fixed.SKIP_DIRS) -> Column:
    """Files with the suffix (in any case) with no folder below the root that is skipped."""
    folders = F.slice(F.split(rel_path, "/"), F.lit(1), F.greatest(F.size(F.split(rel_path, "/")) - 1, F.lit(0)))
    return F.lower(rel_path).endswith(suffix) & ~F.arrays_overlap(folders, F.array(*map(F.lit, skip_dirs)))


def scan(spark: SparkSession, root: str, count_pages: Callable[[bytes], int], full: bool = False, skip_dirs: tuple[str, ...] = fixed.SKIP_DIRS) -> DataFrame:
    """rel_path, file_name, title, file_size, fingerprint, total_pages, error of each PDF below ``root``, by path. A file
    that ``count_pages`` can't read has an error and no pages; the others go on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    files = files.withColumn("rel_path", paths_under(F.col("path"), root.removeprefix("file:"))).filter(wanted(F.col("rel_path"), skip_dirs=skip_dirs))

    @F.pandas_udf("total_pages int, error string")
    def pages(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for data in part:
                try:
                    out.append((count_pages(data), None))
                except Exception as e:  # a broken file is reported, not fatal
                    out.append((0, str(e)[: fixed.SNIPPET]))
            yield pd.DataFrame(out, columns=["total_pages", "error"])

    got = files.withColumn("p", pages("content"))
    name = F.element_at(F.split("rel_path", "/"), -1)
    return got.select("rel_path", name.alias("file_name"), stem_of(F.col("rel_path")).alias("title"), F.col("length").alias("file_size"), fingerprint(F.col("content"), full).alias("fingerprint"), "p.*").orderBy("rel_path")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {label, secret, rpm_limit, rpd_limit}."""
    return spark.read.schema("label string, secret string, rpm_limit int, rpd_limit int").option("multiLine", True).json(path)


BACKUP = "exportedAt string, books array<struct<name: string, fileName: string, relativePath: array<string>, pages: array<struct<n: int, status: string, pageType: string, text: string, note: string>>>>"


def read_backup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(books: name, file_name, rel_path; their pages: rel_path, n, status, page_type, text, note) of a backup."""
    data = spark.read.schema(BACKUP).option("multiLine", True).json(path)
    if data.filter(F.col("books").isNotNull()).limit(1).count() == 0:
        raise ValueError("not a backup: it has no list of books at the top")
    b = data.select(F.explode("books").alias("b"))
    rel = F.when(F.size(F.coalesce("b.relativePath", F.array())) > 0, F.array_join("b.relativePath", "/")).otherwise(F.coalesce("b.fileName", F.lit("")))
    books = b.select(F.col("b.name").alias("name"), F.coalesce("b.fileName", F.lit("")).alias("file_name"), rel.alias("rel_path"))
    pages = b.select(rel.alias("rel_path"), F.explode("b.pages").alias("p")).select("rel_path", "p.n", "p.status", F.col("p.pageType").alias("page_type"), "p.text", "p.note")
    return books, pages


def read_env(path: str, environ: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=value lines; comments and blank lines are left out, matching quotes go, the real environment wins."""
    found: dict[str, str] = {}
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        lines = []
    for line in map(str.strip, lines):
        key, eq, value = line.partition("=")
        if eq and not line.startswith("#"):
            value = value.strip()
            found[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    env = os.environ if environ is None else environ
    return {k: env.get(k, v) for k, v in found.items()}


def kind_of(error: Exception) -> str:
    """The failure class of an exception: an answer that can't be read is the page's fault, also where a client's error for
    it is one of the network too; time-outs, the network and broken protocols are the service's. What a client raises otherwise
    is taken for an answer that it couldn't read."""
    if isinstance(error, ValueError):
        return "BadResponse"
    return "TransientError" if isinstance(error, (OSError, HTTPException)) else "BadResponse"


def guarded(call: Callable[..., dict], row: dict, *more) -> dict:
    """``call(row)`` with latency_ms; where it raises, the row's own fields with kind and message. A call may be metered, so
    no error of it may fail the task and have it repeated."""
    began = time.monotonic()
    try:
        out = call(row, *more)
    except Exception as e:
        out = row | {"kind": kind_of(e), "message": (str(e) or type(e).__name__)[: fixed.SNIPPET]}
    return {"latency_ms": int((time.monotonic() - began) * 1000)} | out


def call_pages(pages: DataFrame, call: Callable[[dict], dict], schema: str, at_once: int) -> DataFrame:
    """``call`` on each row, from at most ``at_once`` tasks. A call that times out, finds no network or gets an answer that
    isn't JSON makes a row with kind and message instead of failing the task. Calls may be metered: write the
    result before it is used twice, and give each row its own (book, page, attempt) so that a repeated task can be
    recognised."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [guarded(call, r) for r in batch.to_dict("records")]
            if rows:
                yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype(object)

    return pages.repartition(at_once).mapInPandas(run, schema)


def render_pages(pages: DataFrame, render: Callable[[str, int, float], bytes], dpi: int, at_once: int, path_col: str = "path") -> DataFrame:
    """``pages``: book_id, page_no, path. Adds image and error, from ``render(path, page number, scale)``; the scale is that of
    a page measured in points. A page that can't be rendered has an error and the others go on."""
    scale = dpi / fixed.DPI
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in pages.schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):  # one image at a time is held
                one = batch.iloc[k : k + 1].copy()
                image, error = None, None
                try:
                    image = render(one[path_col].iloc[0], int(one["page_no"].iloc[0]), scale)
                except Exception as e:  # a page's fault, whatever the library raises
                    error = str(e)[: fixed.SNIPPET]
                yield one.assign(image=pd.Series([image], index=one.index, dtype=object), error=pd.Series([error], index=one.index, dtype=object))

    return pages.repartition(at_once).mapInPandas(run, ", ".join([*fields, "image binary", "error string"]))


def call_books(samples: DataFrame, call: Callable[[int, pd.DataFrame], dict], schema: str, key: str = "book_id") -> DataFrame:
    """One call on all sample pages of a book; samples are a few pages each. A call that fails makes a row with kind and
    message, where the schema has them, and the other books go on."""
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        book = int(group[key].iloc[0])
        got = guarded(lambda row, pages: call(row[key], pages), {key: book}, group)
        return pd.DataFrame([{n: got.get(n) for n in names}], columns=names).astype(object)

    return samples.groupBy(key).applyInPandas(run, schema)
