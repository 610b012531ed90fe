"""String functions as Column expressions, with the semantics of Python's string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import fixed

#: What ``str.strip()`` removes, as characters and as a pattern that reads the same in Java and RE2.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def truthy(c: Column) -> Column:
    """``x or None`` for strings."""
    return F.nullif(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def squeeze(c: Column) -> Column:
    """``" ".join(x.split())``"""
    return F.regexp_replace(strip(c), rf"{SPACE}+", " ")


def occurrences(c: Column, part: Column) -> Column:
    """Non-overlapping occurrences, left to right."""
    return F.floor((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part))


def last_index(c: Column, char: str) -> Column:
    """0-based position of the last ``char``, -1 without one."""
    back = F.nullif(F.instr(F.reverse(c), char), F.lit(0))
    return F.coalesce(F.length(c) - back, F.lit(-1))


def has_loop(c: Column, window: int = fixed.REPEAT_WINDOW, times: int = fixed.REPEAT_TIMES) -> Column:
    """Whether the ``window`` characters from the middle on occur ``times`` times."""
    probe = F.substring(c, F.floor(F.length(c) / 2).cast("int") + 1, F.lit(window))
    return (F.length(c) >= window * times) & (F.length(strip(probe)) > 0) & (occurrences(c, probe) >= times)


def has_any(c: Column, markers: tuple[str, ...]) -> Column:
    lowered = F.lower(or_empty(c))
    found = F.lit(False)
    for m in markers:
        found = found | lowered.contains(m)
    return found


def safe_stem(c: Column, most: int = fixed.STEM_CHARS) -> Column:
    cleaned = squeeze(F.regexp_replace(c, r"[^\p{L}\p{N} ._-]", "_"))
    return F.left(F.coalesce(truthy(cleaned), F.lit("book")), F.lit(most))


def sheet_title(c: Column, most: int = fixed.NAME_CHARS) -> Column:
    cleaned = strip(F.regexp_replace(or_empty(c), r"[:\\/?*\[\]]", ""))
    return F.left(F.coalesce(truthy(cleaned), F.lit("Book")), F.lit(most))


def _if(position: Column, least: int) -> Column:
    """The position if it is at least that, else null; it is evaluated once."""
    return F.get(F.filter(F.array(position), lambda p: p >= least), F.lit(0))


def split_cells(c: Column, columns: int = fixed.CELLS, limit: int = fixed.CELL_CHARS) -> tuple[Column, Column]:
    """(array of ``columns`` cells, whether text was left over). A cut is at the last newline of the window if
    that is in its second half, else at the last space likewise, else at the limit; newlines at a cut go.

    One pass of a fold over the columns; the state is (cells, rest)."""
    half = limit // 2

    def step(acc: Column, _: Column) -> Column:
        rest = acc["rest"]
        window = F.left(rest, F.lit(limit))
        cut = F.coalesce(_if(last_index(window, "\n"), half), _if(last_index(window, " "), half), F.lit(limit))
        fits = F.length(rest) <= limit

        def at(k: Column) -> Column:
            return F.struct(
                F.concat(acc["cells"], F.array(F.when(fits, rest).otherwise(F.left(rest, k)))).alias("cells"),
                F.when(fits, "").otherwise(F.regexp_replace(F.substring(rest, k + 1, F.length(rest)), r"^\n+", "")).alias("rest"),
            )

        return F.get(F.transform(F.array(cut), at), F.lit(0))  # the cut is found once

    start = F.struct(F.array().cast("array<string>").alias("cells"), or_empty(c).alias("rest"))
    def finish(acc: Column) -> Column:
        left = F.length(acc["rest"]) > 0
        room = F.lit(limit - len(fixed.TRUNCATED))
        marked = F.transform(acc["cells"], lambda x, i: F.when(left & (i == columns - 1), F.concat(F.left(x, room), F.lit(fixed.TRUNCATED))).otherwise(x))
        return F.struct(F.when(left, marked).otherwise(acc["cells"]).alias("cells"), left.alias("truncated"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(columns)), start, step, finish)
    short = F.length(or_empty(c)) <= limit
    plain = F.concat(F.array(or_empty(c)), F.array_repeat(F.lit(""), columns - 1))
    return F.when(short, plain).otherwise(done["cells"]), ~short & done["truncated"]


def stem_of(path: Column) -> Column:
    name = F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def masked(secret: Column) -> Column:
    """The last four characters only."""
    return F.concat(F.lit("…"), F.right(or_empty(secret), F.lit(4)))


def preview(c: Column, most: int = 300) -> Column:
    return F.left(squeeze(or_empty(c)), F.lit(most))
