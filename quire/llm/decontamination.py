"""Benchmark decontamination by Wu-Manber search over words.

A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window.
Windows of one length share a table: a block is the last two words (one word for windows of one word), the
shift table says how far a block that isn't at the end of any window lets the search advance, blocks at the
end lead to a bucket of windows, and comparing all words confirms an occurrence.

Items are dealt by hash to parts of about ``part_bytes`` of text; a long item is cut where its windows overlap, so
no item exceeds a part. Each part is compiled by a task and written to the shared folder. A worker searches ``HELD``
bytes of documents with one part after the other and holds one part at a time, so a benchmark of any size takes
the memory of one part; neither the driver nor a broadcast holds any of it. Null texts have no words; items
without words never occur; a null item id counts as the empty text. Equal windows of several items count
for each of them. Repeated rows of either table change nothing but the number of rows returned.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_pairs, by_bytes, column, filesystem, filtered, fresh_dir, staged, texts_of

#: Bytes of document text that are searched with one part after the other.
HELD = 8 << 20
#: Windows of a long item that stay together.
PIECE = 20_000

#: ASCII letters in lower case, digits and all bytes from 0x80 stay; everything else parts words.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Matcher:
    """Tables for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], set[str]]] = {}

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        for end in range(self.block, self.length + 1):
            block = window[end - self.block : end]
            self.shift[block] = min(self.shift.get(block, self.most), self.length - end)
        self.buckets.setdefault(window[-self.block :], {}).setdefault(window, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Starts of windows and the items that have them."""
        shift, most, length, n = self.shift.get, self.most, self.length, len(words)
        i = length - 1
        two = self.block == 2
        while i < n:
            step = shift((words[i - 1], words[i]) if two else (words[i],), most)
            if step:
                i += step
                continue
            start = i - length + 1
            window = tuple(words[start : i + 1])
            items = self.buckets[window[-self.block :]].get(window)
            if items:
                yield start, items
            i += 1


def compile_items(items: list[tuple[str, str]], width: int) -> list[Matcher]:
    by_length: dict[int, Matcher] = {}
    for item, text in items:
        words = words_of(text)
        length = min(width, len(words))
        if length:
            matcher = by_length.setdefault(length, Matcher(length))
            for i in range(len(words) - length + 1):
                matcher.add(tuple(words[i : i + length]), item)
    return list(by_length.values())


def hits(matchers: list[Matcher], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word spans (start, end) of all occurrences, and the items."""
    spans: list[tuple[int, int]] = []
    found: set[str] = set()
    for m in matchers:
        for start, items in m.search(words):
            spans.append((start, start + m.length))
            found |= items
    return spans, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pieces_of(text: str, width: int) -> Iterator[str]:
    """An item's words, long ones in pieces that have each window of the item once."""
    words = words_of(text)
    for start in range(0, max(1, len(words) - width + 1), PIECE):
        yield b" ".join(words[start : start + PIECE + width - 1]).decode()


def benchmark_parts(benchmark: DataFrame, width: int, item_col: str, text_col: str, part_bytes: int) -> list[str]:
    """Files of compiled windows in the shared folder, each of about ``part_bytes`` of text."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.coalesce(column(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts = list(pieces_of(text, width))
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["item", "text"])

    pieces = staged(items.mapInArrow(cut, "item string, text string").filter("text <> ''").distinct(), "pieces")
    total = pieces.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    parts = -(-total // part_bytes)
    if not parts:
        return []
    out = fresh_dir(spark, "windows")
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["part"], r["item"], r["text"]) for batch in batches for r in batch.to_pylist()]
        store, path = filesystem(out)
        store.create_dir(path, recursive=True)
        for part in sorted({r[0] for r in rows}):
            tmp, name = f"{path}/.{uuid.uuid4().hex}.tmp", f"part-{part:06d}"
            with store.open_output_stream(tmp) as f:
                f.write(pickle.dumps(compile_items([(i, t) for p, i, t in rows if p == part], width), pickle.HIGHEST_PROTOCOL))
            store.move(tmp, f"{path}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name}], schema=pa.schema([("file", pa.string())]))

    made = staged(dealt.mapInArrow(build, "file string"), "parts")
    return [f"{out}/{name}" for name in sorted(r.file for r in made.collect())]  # a name a part


@lru_cache(1)
def matchers_of(file: str) -> list[Matcher]:
    """A compiled part; a worker keeps the last one only."""
    store, path = filesystem(file)
    with store.open_input_stream(path) as f:
        return pickle.loads(f.read())


def searched(texts: list[str], files: list[str]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text its number of words, merged spans and items, from one part after the other."""
    words = [words_of(t) for t in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for file in files:
        if len(files) > 1:
            matchers = None
            matchers_of.cache_clear()  # the part before goes before this one comes
        matchers = matchers_of(file)
        for k, w in enumerate(words):
            new, found = hits(matchers, w)
            if new:
                spans[k] = merged([*spans[k], *new])
                items[k] |= found
    return list(zip(map(len, words), spans, items, strict=True))


SPANS = "array<struct<start: int, end: int>>"


def find_benchmark(df: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = 2 << 20) -> DataFrame:
    """Per row: doc_id, n_words, spans (merged word spans that are hit), items (ids as sorted strings)."""
    files = benchmark_parts(benchmark, width, item_col, item_text_col, part_bytes)
    src = as_pairs(df, id_col, text_col)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in held(batches, "text", files):
            counts, spans, items = zip(*searched(texts_of(batch, "text"), files), strict=True)
            structs = [[{"start": a, "end": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(structs, span_type), pa.array([sorted(i) for i in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, spans {SPANS}, items array<string>")


def held(batches: Iterator[pa.RecordBatch], text: str, files: list[str]) -> Iterator[pa.RecordBatch]:
    """With several parts, rows are searched in larger batches, as each reads all parts."""
    if len(files) < 2:
        yield from by_bytes(batches, text)
        return
    rows: list[pa.RecordBatch] = []
    size = 0
    for batch in by_bytes(batches, text):
        rows.append(batch)
        size += batch.nbytes
        if size >= HELD:
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()
            rows, size = [], 0
    if rows:
        yield from pa.Table.from_batches(rows).combine_chunks().to_batches()


def drop_contaminated(df: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``df``, with all their columns, in which no window occurs."""
    files = benchmark_parts(benchmark, width, item_col, item_text_col, part_bytes)

    def run(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
        for batch in held(batches, text, files):
            yield batch.filter(pa.array([not spans for _, spans, _ in searched(texts_of(batch, text), files)]))

    return filtered(df, text_col, run)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH item_words AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item, w, least(len(w), 10) AS k FROM item_words WHERE len(w) > 0))),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
found AS (SELECT rid, i, grams.k AS k, item FROM grams JOIN windows ON grams.k = windows.k AND grams.g = windows.g),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(named.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(named.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""
