"""Ranges of ordered rows: consecutive numbers, without sorting everything on one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.sources.shared import written

#: Ranges that are worked on side by side.
RANGES = 64


def ranged(df: DataFrame, by: list[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with ``__range``, in order of ``by``: cut at the rows with the smallest hashes of ``by``, so the cuts follow from the
    rows alone, however they are dealt. Rows that are equal in ``by`` stay together. A row's range is found by halving: a comparison
    for each bit of its number, not for each cut."""
    order = F.struct(*by)
    known = reduce(lambda a, c: a & c, [F.col(c).isNotNull() for c in by])
    cuts = sorted(tuple(r) for r in df.select(*by).filter(known).orderBy(F.xxhash64(*by), *by).limit(ranges - 1).collect())
    if not cuts:
        return df.withColumn("__range", F.lit(0))
    types = [df.schema[c].dataType for c in by]
    sorted_cuts = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(cut, types, by, strict=True)]) for cut in cuts])
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(len(cuts).bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(order >= F.get(sorted_cuts, at + step - 1), at + step).otherwise(at))
    return df.withColumn("__range", place)


def numbered(df: DataFrame, by: str, name: str = "n", after: int = 0) -> DataFrame:
    """``df`` with ``after`` + 1, ``after`` + 2, ... in order of ``by``, whose values differ. The rows are made once, into a table of the
    shared folder; each range is numbered by itself, and a running sum over the ranges' counts makes the numbers
    consecutive."""
    dealt = ranged(written(df, "numbered"), [by])
    counts = {r[0]: r[1] for r in dealt.groupBy("__range").count().collect()}  # at most RANGES rows
    starts, at = [], after
    for k in range(RANGES):
        starts.append(at)
        at += counts.get(k, 0)
    own = F.row_number().over(W.partitionBy("__range").orderBy(by))
    return dealt.withColumn(name, (F.get(F.array(*map(F.lit, starts)), F.col("__range")) + own).cast("long")).drop("__range")


def dealt(df: DataFrame, by: list[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with ``__range``, in order of ``by``, which tells rows apart. Made and dealt once, into a table of the shared folder whose
    files are in that order, so a few groups are read without the rest."""
    own = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    return written(own.withColumn("__range", F.spark_partition_id()), "dealt")


def split_by(rows: DataFrame, name: str) -> Column | None:
    """Whether a row's value of ``name``, by which ``rows`` are dealt first, is in several ranges; None if none is. A range ends with one
    value, so these are fewer than ranges."""
    value = F.struct(name)
    ends = sorted(rows.groupBy("__range").agg(F.min(value).alias("first"), F.max(value).alias("last")).collect())
    values = {b.first[0] for a, b in zip(ends, ends[1:], strict=False) if a.last == b.first}
    if not values:
        return None
    return reduce(lambda a, b: a | b, [F.col(name).eqNullSafe(F.lit(v).cast(rows.schema[name].dataType)) for v in values])


def along(rows: DataFrame, group: list[str], order: list[str], split: Column | None, sums: dict[str, str] | None = None, tops: dict[str, str] | None = None, own: bool = True) -> DataFrame:
    """``running`` over rows that are dealt by ``group`` and ``order``, with ``__range``. Only groups in several ranges (``split``) begin with
    what the ranges before have of them, so only these are read for it; what makes the columns summed may itself be running."""
    sums, tops = sums or {}, tops or {}
    names = [*sums, *tops]
    inside = W.partitionBy("__range", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    out = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()} | {n: F.max(c).over(inside) for n, c in tops.items()})
    carried = {} if split is None else carries(rows.filter(split), group, sums, tops)
    if carried:
        types = [out.schema[n].dataType for n in names]
        fields = ["__of int", *[f"__g{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(group)], *[f"__c{i} {t.simpleString()}" for i, t in enumerate(types)]]
        add = rows.sparkSession.createDataFrame([(k, *name, *values) for k, (name, values) in carried.items()], ", ".join(fields))  # a row for each range
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)], F.col("__range") == F.col("__of"))
        out = out.join(F.broadcast(add), same, "left")
        joined = {n: (F.coalesce(n, F.lit(0).cast(types[i])) + F.col(f"__c{i}") if n in sums else F.greatest(n, f"__c{i}")) for i, n in enumerate(names)}
        out = out.withColumns({n: F.when(F.col(f"__c{i}").isNull(), F.col(n)).otherwise(joined[n]) for i, n in enumerate(names)})
    return out.select(*rows.columns, *names)


def carries(rows: DataFrame, group: list[str], sums: dict[str, str], tops: dict[str, str]) -> dict[int, tuple]:
    """By range: the group that goes on from the ranges before, and its sums and maxima there."""
    names = [*sums, *tops]
    found = rows.groupBy("__range", *group).agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.max(c).alias(n) for n, c in tops.items()])
    end = F.struct(F.struct(*group).alias("group"), *names)  # a range's groups differ, so the group alone decides
    ends = found.groupBy("__range").agg(F.min(end).alias("first"), F.max(end).alias("last")).collect()  # a row for each range
    plus = lambda a, b: [x if y is None else y if x is None else x + y if i < len(sums) else max(x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    carried: dict[int, tuple] = {}
    held, of = None, None
    for k, first, last in sorted(ends, key=lambda r: r[0]):
        values = list(last[1:])
        if first[0] == of:
            carried[k] = (tuple(of), held)
            values = plus(held, values) if last[0] == of else values
        of, held = last[0], values
    return carried


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str] | None = None, tops: dict[str, str] | None = None, ranges: int = RANGES, own: bool = True) -> DataFrame:
    """``df`` with running sums (new name: column) and running maxima (new name: column) in each ``group``, in order of ``order``, with or
    without each row's ``own`` value; null before the first value. A group of any size is dealt to ranges: each sums its rows by itself, and what the ranges before have of the
    group that one begins with, a number for each range, is added. No group is on one task as a whole. Together ``group``
    and ``order`` tell rows apart, and ``order`` holds no nulls."""
    rows = dealt(df, [*group, *order], ranges)
    return along(rows, group, order, split_by(rows, group[0]), sums, tops, own).drop("__range")
