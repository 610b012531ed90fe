"""Rows, requests and index of the published sheets. Rows are keyed by page, so gaps shift nothing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions.once import once
from quire.functions.text import or_empty, split_cells, truthy
from quire.operators.numbering import RANGES, ranged


def placeholder(page_type: Column) -> Column:
    out = F.lit("")
    for kind, text in fixed.PLACEHOLDERS.items():
        out = F.when(page_type == kind, text).otherwise(out)
    return out


def publish_rows(pages: DataFrame, limit: int = fixed.CELL_CHARS, columns: int = fixed.CELLS) -> DataFrame:
    """Finished pages as rows: book_id, page_no, page_type, cells, footnotes, note, status, truncated."""
    kind = or_empty(F.col("page_type"))
    done = once(pages.filter(F.col("status").isin(*fixed.FINISHED)), __shown=F.coalesce(truthy(F.col("transcription")), placeholder(kind)))
    cells, truncated = split_cells(F.col("__shown"), columns, limit)
    done = once(done, __cells=F.struct(cells.alias("cells"), truncated.alias("truncated")))
    notes = or_empty(F.col("footnotes"))
    notes = F.when(F.length(notes) > limit, F.concat(F.left(notes, F.lit(limit - 40)), F.lit(fixed.NOTES_TRUNCATED))).otherwise(notes)
    return done.select("book_id", "page_no", kind.alias("page_type"), F.col("__cells.cells").alias("cells"), notes.alias("footnotes"), F.coalesce(truthy(F.col("note")), truthy(F.col("flag_reason")), F.lit("")).alias("note"), "status", F.col("__cells.truncated").alias("truncated"))


def row_chars(rows: DataFrame) -> Column:
    texts = F.length("page_type") + F.length("footnotes") + F.length("note") + F.length("status")
    return (F.aggregate("cells", F.lit(0), lambda n, c: n + F.length(c)) + texts).cast("long")


END = "range int, start long, before long, n long, first long, first_book long, last_book long, begun long, last_begun long, open_rows long, open_chars long"
CHUNK = "book_id long, page_no int, chars long, chunk int, is_final boolean"


class RangeRows:
    """The rows of a range in order. ``follow``: of a chunk that begins at a row, the row after its last, if nothing but this range were
    left of the book; so only the last one may be open. ``first``: how many rows are of the book that the range begins with."""

    def __init__(self, table: pa.Table, most_rows: int, most_chars: int):
        self.table = table = table.sort_by([("book_id", "ascending"), ("page_no", "ascending")])
        self.book = table.column("book_id").to_numpy()
        self.n = n = len(self.book)
        self.sums = np.concatenate([[0], np.cumsum(table.column("chars").to_numpy())])
        full = np.searchsorted(self.sums, self.sums[:-1] + most_chars, side="right") - 1
        rows, ends = np.arange(n), np.searchsorted(self.book, self.book, side="right")
        self.follow = np.minimum(np.minimum(np.maximum(full, rows + 1), rows + most_rows), ends).tolist()
        self.first = int(ends[0])

    def walks(self, starts: list[int], stop: int) -> list[tuple[int, int | None]]:
        """From each start: how many chunks begin before ``stop``, and where the last of them does. Walks that meet are walked once."""
        known: dict[int, tuple[int, int | None]] = {}
        for s in starts:
            path = []
            while s < stop and s not in known:
                path.append(s)
                s = self.follow[s]
            count, last = known.get(s, (0, None))
            for x in reversed(path):
                count, last = count + 1, x if last is None else last
                known[x] = (count, last)
        return [known.get(s, (0, None)) for s in starts]


def range_ends(most_rows: int, most_chars: int):
    """For each row at which a chunk that is open when the range begins may end: how many chunks of its book begin in the range from
    there on, and what is in the chunk that is open at the range's end."""

    def run(table: pa.Table) -> pa.Table:
        r = RangeRows(table, most_rows, most_chars)
        starts = list(range(min(most_rows, r.first) + 1))
        begun = r.walks(starts, r.first)
        last_book = int(np.searchsorted(r.book, r.book[-1]))
        other = r.walks([last_book], r.n)[0] if r.first < r.n else None
        rows = []
        for s, (count, last) in zip(starts, begun, strict=True):
            at = r.n if last is None else last
            at = other[1] if other else at
            rows.append((s, int(r.sums[s]), r.n, r.first, int(r.book[0]), int(r.book[-1]), count, other[0] if other else 0, r.n - at, int(r.sums[-1] - r.sums[at])))
        names = END.replace(" long", "").replace(" int", "").split(", ")
        return pa.table([pa.array([table.column("__range")[0].as_py()] * len(rows), pa.int32()), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=names)

    return run


def filled(entries: dict[int, tuple[int, int]], totals: dict[int, int], most_rows: int, most_chars: int):
    """The rows of a range with their chunks. ``entries``: of each range the row at which the open chunk ends and how many chunks its book
    has so far; ``totals``: the chunks of books that lie in several ranges."""

    def run(table: pa.Table) -> pa.Table:
        r = RangeRows(table, most_rows, most_chars)
        at, begun = entries[table.column("__range")[0].as_py()]
        sizes, numbers = [at] * (at > 0), [begun - 1] * (at > 0)
        while at < r.n:
            if at and r.book[at] != r.book[at - 1]:
                begun = 0
            numbers.append(begun)
            sizes.append(r.follow[at] - at)
            at, begun = r.follow[at], begun + 1
        chunk = np.repeat(np.array(numbers, np.int32), sizes)
        ends = np.flatnonzero(np.append(r.book[1:] != r.book[:-1], True))  # the last row of each book here
        last = {int(r.book[i]): totals.get(int(r.book[i]), int(chunk[i]) + 1) - 1 for i in ends.tolist()}
        final = np.repeat(np.array([last[int(r.book[i])] for i in ends.tolist()]), np.diff(ends, prepend=-1))
        return r.table.select(["book_id", "page_no", "chars"]).append_column("chunk", pa.array(chunk)).append_column("is_final", pa.array(chunk == final))

    return run


def chunks(rows: DataFrame, most_rows: int = fixed.CHUNK_ROWS, most_chars: int = fixed.CHUNK_CHARS, ranges: int = RANGES) -> DataFrame:
    """``rows``: book_id, page_no, chars. Each row's chunk, filled greedily in page order within both bounds (a row
    over the bound is a chunk of its own), and whether the chunk is the book's last.

    Where a chunk ends depends on all that came before in its book; yet one that is open where a range of rows begins ends
    within ``most_rows`` rows, so a range has only as many ways to begin. Each range follows all of them to its end by
    itself. From these, ``most_rows`` short rows for each of at most ``ranges``, the driver finds the one that holds, and the ranges are
    filled side by side. So a book of any size is split, and no texts are moved."""
    own = rows.select(F.col("book_id").cast("long").alias("book_id"), F.col("page_no").cast("int").alias("page_no"), F.col("chars").cast("long").alias("chars"))
    dealt = ranged(own, ["book_id", "page_no"], ranges)
    ends: dict[int, list] = {}
    for r in dealt.groupBy("__range").applyInArrow(range_ends(most_rows, most_chars), END).collect():
        ends.setdefault(r.range, []).append(r)
    entries: dict[int, tuple[int, int]] = {}
    totals: dict[int, int] = {}
    book, held_rows, held_chars, begun = None, 0, 0, 0
    for k in sorted(ends):
        ways = sorted(ends[k], key=lambda r: r.start)
        first, at = ways[0], 0
        if first.first_book != book:
            held_rows, held_chars, begun = 0, 0, 0
        while held_rows and at < first.first and held_rows + at < most_rows and held_chars + ways[at + 1].before <= most_chars:
            at += 1
        way = ways[at]
        entries[k] = (at, begun)
        totals[way.first_book] = begun = begun + way.begun
        if way.last_book != way.first_book:
            book, held_rows, held_chars, begun = way.last_book, way.open_rows, way.open_chars, way.last_begun
            totals[book] = begun
        elif at >= way.n:  # the open chunk takes the whole range
            held_rows, held_chars = held_rows + way.n, held_chars + way.before
        else:
            book, held_rows, held_chars = way.first_book, way.open_rows, way.open_chars
    return dealt.groupBy("__range").applyInArrow(filled(entries, totals, most_rows, most_chars), CHUNK)


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``new`` put in the place of those with equal keys."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def index_rows(books: DataFrame, rows: DataFrame, machine: str = "") -> DataFrame:
    """One row a book: book, written, split_pages, truncated_pages, total_pages, machine."""
    counts = rows.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("written"), F.count_if(F.exists(F.slice("cells", 2, fixed.CELLS), lambda c: c != "")).alias("split_pages"), F.count_if("truncated").alias("truncated_pages"))
    return books.join(counts, "id").select("id", F.col("title").alias("book"), "written", "split_pages", "truncated_pages", "total_pages", F.lit(machine).alias("machine"))


def accepted(status: Column, body: Column) -> Column:
    """What is wrong with the receiver's answer; null if it took the rows."""
    tree = F.try_parse_json(body)
    ok = F.get_json_object(body, "$.ok") == "true"
    said = truthy(F.get_json_object(body, "$.error"))
    return F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"))).when(tree.isNull(), "the answer isn't JSON").when(~F.coalesce(ok, F.lit(False)), F.coalesce(said, F.lit("the receiver reported an error")))


def send_chunks(rows: DataFrame, call: Callable[[int, int, bool, pd.DataFrame], dict], schema: str) -> DataFrame:
    """``rows``: published rows with chunk and is_final. One call a chunk (book_id, chunk, is_final, its rows in page order);
    the receiver puts each row where its page belongs, so a chunk that is sent twice changes nothing. A chunk's
    bounds keep it small. The result is what sends: write it once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return pd.DataFrame([call(int(first["book_id"]), int(first["chunk"]), bool(first["is_final"]), group.sort_values("page_no"))])

    return rows.groupBy("book_id", "chunk").applyInPandas(run, schema)


def save_new_table(spark: SparkSession, df: DataFrame, name: str) -> None:
    """Makes the table with ``df``'s columns if there is none, then appends."""
    df.write.mode("append" if spark.catalog.tableExists(name) else "errorifexists").format("parquet").saveAsTable(name)
