"""Numeric band join: every query value with all points near it, as totals and as its first k points by gap.

A query of value p pairs with the points of value u for which gap = |u - p| is at most ``near``, or 1000 * gap at most
``per_mille`` * p, except those of the query's own item. Values are whole numbers.

Points are summed up per value before anything else: each distinct u is a leaf with its number of points, the sum of
their marks and its first points (``k`` of an item at most, 2 * ``k`` in all; whichever item a query leaves out, its first ``k`` are
among them). Leaves form a digit trie over u that is cut at a high-digit prefix: the first three digits, or all but the last two
of shorter numbers. Prefixes are dealt to tasks, and each task builds the subtrees of its prefixes with the sums
below every node. Each distinct p goes to the prefixes that its band touches, six at most where ``per_mille`` is 2. There a
descent to each boundary of the band adds up the subtrees of smaller digits, and a best-first traversal in order of
gap emits points until no query of that value can need more. What the parts of a band have found is put
together per p, and the item's own points are taken off by a join on item and prefix.

So nothing depends on how many points share a value, an item or a sale: what is shuffled by value are sums and first
points of each task, a task holds the leaves of a prefix (a thousandth to a hundredth of u of them) and nothing is collected or
broadcast. Items that share a price meet in a join that Spark can split.

Rows of points with a null value, item or sale and queries with a null value never pair; a null place (``line_no``) sorts
first and repeated points each count. A query with a null item leaves out no point. Repeated queries each have their
rows. Without pairs a query has one row of rank 0 with nulls and zeros. Sums have to fit into 64 bits.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import column, discard, staged

#: Digits of the prefix, and low digits that it never has.
HIGH, LOW = 3, 2
LINE = "struct<gap: long, u: long, sale_id: long, line_no: long, item_id: long>"
FOUND = f"p long, n long, gaps long, marks long, lines array<{LINE}>"
#: Beyond this many cents a price isn't exact in doubles.
MOST_CENTS = 9e15


def low_digits(u: int) -> int:
    """How many digits of u are below its prefix."""
    return max(LOW, len(str(u if u >= 0 else ~u)) - HIGH)


def floor_div(a: Column, b: Column) -> Column:
    """Of whole numbers, b > 0, without a fraction that could be lost."""
    return F.call_function("div", a - F.pmod(a, b), b)


def prefix_of(u: Column) -> Column:
    """The number of u's prefix, consecutive in order of u."""
    up = F.when(u < 0, F.bitwise_not(u)).otherwise(u)
    low = F.greatest(F.lit(LOW), F.length(up.cast("string")) - HIGH)
    width = F.rpad(F.lit("1"), low + 1, F.lit("0")).cast("long")
    # numbers of one more digit have nine tenths of 10 ** HIGH prefixes of their own
    n = (low - LOW).cast("long") * (9 * 10 ** (HIGH - 1)) + floor_div(up, width)
    return F.when(u < 0, -1 - n).otherwise(n).cast("long")


def cents(amount: Column) -> Column:
    """floor(100 * amount + 0.5) in doubles; null if that is no number."""
    x = amount.cast("double") * 100 + 0.5
    return F.when(~F.isnan(x) & (F.abs(x) < MOST_CENTS), F.floor(x)).cast("long")


def unit_price(total: Column, quantity: Column) -> Column:
    """floor((2 * total + quantity) / (2 * quantity)) in whole numbers: the price of one, halves up; null for quantity 0."""
    sign = F.when(quantity < 0, -1).when(quantity > 0, 1)
    return floor_div((2 * total + quantity) * sign, 2 * quantity * sign)


class Trie:
    """The leaves of one prefix. ``keys[level]``: the numbers without their last ``level`` digits that occur, sorted, so the
    children of a node are neighbours; ``sums[level]`` of the leaves below, ``before[level]`` of its smaller siblings."""

    def __init__(self, offsets: np.ndarray, n: np.ndarray, marks: np.ndarray, depth: int):
        self.depth = depth
        self.keys, self.sums = [offsets], [np.stack([n, n * offsets, marks])]
        self.child: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.before: list[np.ndarray] = []
        for level in range(1, depth + 1):
            keys = np.unique(offsets // 10**level)
            first = np.searchsorted(self.keys[-1] // 10, keys)
            below = self.sums[-1]
            self.keys.append(keys)
            self.sums.append(np.add.reduceat(below, first, axis=1))
            self.child.append(np.append(first, below.shape[1]))
            running = np.cumsum(below, axis=1) - below
            self.before.append(running - np.repeat(running[:, first], np.diff(self.child[-1]), axis=1))
        self.plain = [k.tolist() for k in self.keys]
        self.ranges = [c.tolist() for c in self.child]

    def up_to(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves of at most x, for many x: a descent along the digits of x takes all subtrees of smaller
        digits at each level."""
        x = np.minimum(x, 10**self.depth - 1)
        total = np.zeros((3, len(x)), np.int64)
        on = np.flatnonzero(x >= 0)
        node = np.zeros(len(on), np.int64)
        for level in range(self.depth - 1, -1, -1):
            want = x[on] // 10**level
            last = self.child[level + 1][node + 1]
            at = np.searchsorted(self.keys[level], want)
            past = at >= last  # all siblings have smaller digits
            total[:, on[past]] += self.sums[level + 1][:, node[past]]
            on, at, want = on[~past], at[~past], want[~past]
            total[:, on] += self.before[level][:, at]
            met = self.keys[level][at] == want
            on, node = on[met], at[met]
        total[:, on] += self.sums[0][:, node]
        return total

    def nearest(self, p: int, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        """(gap, leaf) of the leaves from lo to hi, by gap, then value. A node waits with the least gap that a leaf below it
        can have, before leaves of that gap."""
        heap = [(0, -self.depth, 0, 0)]
        while heap:
            gap, level, _, i = heapq.heappop(heap)
            if level == 0:
                yield gap, i
                continue
            level = -level - 1
            width = 10**level
            keys = self.plain[level]
            for j in range(self.ranges[level + 1][i], self.ranges[level + 1][i + 1]):
                a = keys[j] * width
                b = a + width - 1
                if b >= lo and a <= hi:
                    heapq.heappush(heap, (a - p if a > p else p - b if b < p else 0, -level, a, j))


def within_prefix(k: int, near: int, per_mille: int):
    """What one prefix knows about the bands that touch it."""

    def found(leaves: pa.Table, queries: pa.Table) -> pa.Table:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        line = pa.struct([(c, pa.int64()) for c in ("gap", "u", "sale_id", "line_no", "item_id")])
        names = ["p", "n", "gaps", "marks", "lines"]
        if not leaves.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in (*types, pa.list_(line))], names=names)
        leaves = leaves.sort_by("u").combine_chunks()
        u, n, marks = (leaves.column(c).to_numpy() for c in ("u", "n", "marks"))
        own = leaves.column("firsts").combine_chunks()
        starts, flat = own.offsets.to_pylist(), own.flatten()
        points = list(zip(*(flat.field(c).to_pylist() for c in ("sale_id", "line_no", "item_id")), strict=True))
        depth = low_digits(int(u[0]))
        base = int(u[0]) // 10**depth * 10**depth
        trie = Trie(u - base, n, marks, depth)
        p = queries.column("p").to_numpy()
        radius = np.maximum(near, per_mille * p // 1000)
        lo, hi = p - radius - base, p + radius - base
        below, middle, above = (trie.up_to(x) for x in (lo - 1, p - base, hi))
        left, right = middle - below, above - middle
        # p - u to the left, u - p to the right
        gaps = (left[0] * (p - base) - left[1]) + (right[1] - right[0] * (p - base))
        total = above - below
        lines: list[list[tuple]] = []
        for at, a, b in zip((p - base).tolist(), lo.tolist(), hi.tolist(), strict=True):
            taken: list[tuple] = []
            of: Counter[int] = Counter()
            for gap, leaf in trie.nearest(at, a, b):
                for sale, place, item in points[starts[leaf] : starts[leaf + 1]]:
                    if of[item] < k:
                        of[item] += 1
                        taken.append((gap, int(u[leaf]), sale, place, item))
                if len(taken) >= 2 * k:
                    break
            lines.append([dict(zip(("gap", "u", "sale_id", "line_no", "item_id"), x, strict=True)) for x in taken[: 2 * k]])
        return pa.table([pa.array(p), pa.array(total[0]), pa.array(gaps), pa.array(total[2]), pa.array(lines, pa.list_(line))], names=names).filter(pa.array(total[0] > 0))

    return found


def leaves_of(points: DataFrame, owned: DataFrame, k: int) -> DataFrame:
    """Per value u: n, marks and its first points. A task sends ``k`` points of an item and value at most, then 2 ``k`` of a value."""
    place = [F.col("sale_id"), F.col("line_no"), F.col("item_id")]
    first = points.withColumn("__n", F.row_number().over(W.partitionBy("u", "item_id").orderBy(*place))).filter(F.col("__n") <= k).drop("__n")
    first = first.withColumn("__n", F.row_number().over(W.partitionBy("u").orderBy(*place))).filter(F.col("__n") <= 2 * k)
    first = first.groupBy("u").agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", *place))), lambda x: F.struct(x["sale_id"].alias("sale_id"), x["line_no"].alias("line_no"), x["item_id"].alias("item_id"))).alias("firsts"))
    return owned.groupBy("u").agg(F.sum("n").alias("n"), F.sum("marks").alias("marks")).join(first, "u").withColumn("prefix", prefix_of(F.col("u")))


def band_join(queries: DataFrame, points: DataFrame, k: int = 5, near: int = 10, per_mille: int = 2) -> DataFrame:
    """``queries``: item_id, p; ``points``: item_id, u, sale_id, line_no, mark (all long). Per row of ``queries``: item_id, p, n_pairs, gap_sum,
    marks (of all its pairs) and lines, its first ``k`` as structs of gap, u, sale_id, line_no, item_id."""
    own, p = F.col("item_id"), F.col("p")
    points = points.filter("u IS NOT NULL AND item_id IS NOT NULL AND sale_id IS NOT NULL")
    radius = F.greatest(F.lit(near).cast("long"), floor_div(p * per_mille, F.lit(1000).cast("long")))
    touched = lambda df: df.withColumns({"lo": p - radius, "hi": p + radius}).withColumn("prefix", F.explode(F.sequence(prefix_of(F.col("lo")), prefix_of(F.col("hi")))))
    owned = staged(points.groupBy("item_id", "u").agg(F.count("*").alias("n"), F.sum("mark").alias("marks")), "owned")
    leaves = leaves_of(points, owned, k)
    values = touched(queries.filter(p.isNotNull()).select("p").distinct())
    parts = leaves.groupBy("prefix").cogroup(values.select("prefix", "p").groupBy("prefix")).applyInArrow(within_prefix(k, near, per_mille), FOUND)
    merged = F.array_sort(F.flatten(F.collect_list("lines")))
    per_value = staged(parts.groupBy("p").agg(F.sum("n").alias("n"), F.sum("gaps").alias("gaps"), F.sum("marks").alias("marks"), merged.alias("lines")), "values")
    # an item's own points in its band, met by prefix so that an item with many values stays cheap
    mine = touched(queries.filter(p.isNotNull() & own.isNotNull()).select("item_id", "p").distinct())
    mine = owned.withColumn("prefix", prefix_of(F.col("u"))).join(mine, ["item_id", "prefix"]).filter(F.col("u").between(F.col("lo"), F.col("hi")))
    mine = staged(mine.groupBy(own.alias("of"), p.alias("at")).agg(F.sum("n").alias("own_n"), F.sum(F.col("n") * F.abs(F.col("u") - p)).alias("own_gaps"), F.sum("marks").alias("own_marks")), "own")
    discard(owned)
    out = queries.join(per_value, "p", "left").join(mine, (own == F.col("of")) & (p == F.col("at")), "left")
    rest = lambda all_, part: (F.coalesce(all_, F.lit(0)) - F.coalesce(part, F.lit(0))).cast("long")
    others = F.filter(F.coalesce("lines", F.array().cast(f"array<{LINE}>")), lambda x: ~x["item_id"].eqNullSafe(own))
    return out.select("item_id", "p", rest("n", "own_n").alias("n_pairs"), rest("gaps", "own_gaps").alias("gap_sum"), rest("marks", "own_marks").alias("marks"), F.slice(others, 1, k).alias("lines"))


def ranked(joined: DataFrame) -> DataFrame:
    """A row for each of the first points of a query, rank 0 and nulls for a query without any."""
    x = joined.select("item_id", "n_pairs", "gap_sum", "marks", F.posexplode_outer("lines").alias("at", "x"))
    rank = F.coalesce(F.col("at") + 1, F.lit(0)).cast("int")
    return x.select("item_id", rank.alias("rank"), *[F.col(f"x.{c}").alias(c) for c in ("gap", "u", "sale_id", "line_no")], F.col("x.item_id").alias("line_item_id"), "n_pairs", "gap_sum", F.col("marks").alias("lines_crc"))


def near_prices(items: DataFrame, lines: DataFrame, k: int = 5, near: int = 10, per_mille: int = 2) -> DataFrame:
    """Items with the lines sold near their price, in cents: ``items`` (item_id, price) and ``lines`` (sale_id, line_no, item_id, quantity,
    amount), with any other columns. Marks are the crc32 of ``sale_id,line_no,item_id`` in decimals, a null place written as nothing. Amounts
    and prices that are no finite numbers count as null, and lines of quantity 0 have no price."""
    queries = items.select(column("item_id").cast("long").alias("item_id"), cents(column("price")).alias("p"))
    of, sale, place = column("item_id").cast("long"), column("sale_id").cast("long"), column("line_no").cast("long")
    text = F.concat_ws(",", sale, F.coalesce(place.cast("string"), F.lit("")), of)
    points = lines.select(of.alias("item_id"), unit_price(cents(column("amount")), column("quantity").cast("long")).alias("u"), sale.alias("sale_id"), place.alias("line_no"), F.crc32(F.encode(text, "UTF-8")).alias("mark"))
    return ranked(band_join(queries, points, k, near, per_mille))


#: The crc32 by its table of remainders; pairs by a join on the band.
SQL = """WITH RECURSIVE steps AS (SELECT CAST(range AS BIGINT) AS k, CAST(range AS BIGINT) AS c, 0 AS s FROM range(256)
  UNION ALL SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, s + 1 FROM steps WHERE s < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM steps WHERE s = 8),
l AS (SELECT sale_id, CAST(line_no AS BIGINT) AS line_no, item_id, CAST(floor(100 * amount + 0.5) AS BIGINT) AS a, CAST(quantity AS BIGINT) AS q FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL AND quantity <> 0),
p AS (SELECT sale_id, line_no, item_id, CAST((2 * a + q - (((2 * a + q) % (2 * q)) + 2 * q) % (2 * q)) // (2 * q) AS BIGINT) AS u,
  xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(sale_id || ',' || coalesce(CAST(line_no AS VARCHAR), '') || ',' || item_id, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) AS mark FROM l, tab),
i AS (SELECT rowid AS r, item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM (SELECT row_number() OVER () AS rowid, item_id, price FROM items)),
b AS (SELECT *, p - greatest(10, p * 2 // 1000) AS lo, p + greatest(10, p * 2 // 1000) AS hi FROM i),
j AS (SELECT b.r, b.item_id, abs(p.u - b.p) AS gap, p.u, p.sale_id, p.line_no, p.item_id AS line_item_id, p.mark FROM b JOIN p ON p.u >= b.lo AND p.u <= b.hi WHERE p.item_id IS DISTINCT FROM b.item_id),
s AS (SELECT r, CAST(count(*) AS BIGINT) AS n_pairs, CAST(sum(gap) AS BIGINT) AS gap_sum, CAST(sum(mark) AS BIGINT) AS lines_crc FROM j GROUP BY r),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no NULLS FIRST, line_item_id) AS n FROM j) WHERE n <= 5)
SELECT i.item_id, CAST(coalesce(f.n, 0) AS INTEGER) AS rank, CAST(f.gap AS BIGINT) AS gap, f.u, f.sale_id, f.line_no, f.line_item_id, coalesce(s.n_pairs, 0) AS n_pairs, coalesce(s.gap_sum, 0) AS gap_sum, coalesce(s.lines_crc, 0) AS lines_crc
FROM i LEFT JOIN s ON s.r = i.r LEFT JOIN f ON f.r = i.r"""
