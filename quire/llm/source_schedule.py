"""Mixing sources to target weights by a low-discrepancy schedule.

A text's size is its number of words. Sources in order of their names (by code point, null last) have the weights in turn,
which share out ``share`` times all words; no source gets more than ``most`` times its own, what it can't use goes to the
others by weight until none is above.

A source's documents, in an order of keyed hashes, are one stream of words that is cut into blocks of ``block`` words.
A pass over a source takes its blocks in the order of a keyed Feistel permutation, another one for each pass; the last block of
the mix ends where the target is met. So the blocks that each source needs are known, and each needs as many slots.

Slot i of the schedule is the van der Corput point i (its bits mirrored behind the point), mapped through the sources'
cumulative numbers of slots. Any stretch of the schedule so has each source near its share. Which slot of its source it is
follows from the digits of i alone: the points of a binary block of numbers form a grid, whose part below a bound is
counted by division. A source that the points give more slots than it needs leaves the last ones empty, one
that they give fewer has the rest at the end; both are few, as a prefix of n points is off by about log2(n) at most.

Slots meet sources through cells of the unit interval, several for each source, so a large source is in many; blocks meet
documents by source and block. Sums over documents in order are made range by range. So no task has more of a source than of any
other, and only single numbers reach the driver.

Null and empty texts have size 0 and are never taken. The null source is a source. Repeated rows are documents each. The
result depends on the rows and the seed, not on how they are dealt; rows equal in id and text may stand for each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quire.llm.common import column, discard, staged
from quire.llm.training_order import Permutation

WORD = r"[^\x20\x09-\x0D]+"
#: Binary digits of a point.
BITS = 53
SLOT = "slot long, number long, pass int, block long, words long"


class Mix(NamedTuple):
    """``sources``: source, number, source_size, target, ...; ``documents``: row, doc_id, source, size and at, its place in the stream of its
    source; ``schedule``: which words of which block each slot takes."""

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame
    block: int


def running(table: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """A written table with ``before_<value>``, the sum of a value over the rows before in order of ``by``. Ranges of rows are
    summed side by side; the sums of the ranges, as many as there are partitions, are broadcast."""
    ranges = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), np.zeros(len(values), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(v).to_numpy(zero_copy_only=False) for v in values]).astype(np.int64)
                sums = np.cumsum(x, axis=1) + held[:, None]
                held = sums[:, -1].copy()
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, sums - x), pa.array(np.full(batch.num_rows, part, np.int32))], names=[*batch.schema.names, *(f"before_{v}" for v in values), "part"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in table.schema), *(f"before_{v} long" for v in values), "part int"])
    local = staged(table.repartitionByRange(ranges, *by).sortWithinPartitions(*by).mapInArrow(add, fields), "running")
    sums = local.groupBy(F.col("part").alias("of")).agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    order = W.orderBy("of").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("of", *[F.coalesce(F.sum(f"sum_{v}").over(order), F.lit(0)).alias(f"start_{v}") for v in values])
    out = local.join(F.broadcast(starts), F.col("part") == F.col("of"))  # a row for each range
    out = out.withColumns({f"before_{v}": F.col(f"before_{v}") + F.col(f"start_{v}") for v in values}).select(*table.columns, *[f"before_{v}" for v in values])
    out._quire_path = local._quire_path
    return out


def shared_out(sources: DataFrame, share: float, most: float) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``. The level is what a weight of 1 gets; each look at all sources raises it by what those at
    their bound leave over, until no other is above its own."""
    cap = F.col("source_size") * F.lit(most)
    all_words, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (all_words or 0)
    level = total / weights if weights else 0.0
    while True:
        above = F.col("weight") * F.lit(level) > cap
        held, left = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        higher = (total - (held or 0)) / left if left else level
        if higher == level:
            break
        level = higher
    return sources.withColumn("target", F.when(above, cap).otherwise(F.col("weight") * F.lit(level)).cast("double"))


def mirrored(i: np.ndarray) -> np.ndarray:
    """The van der Corput points of whole numbers, times 2 ** BITS."""
    out, rest = np.zeros_like(i), i.copy()
    for _ in range(BITS):
        out = out << 1 | rest & 1
        rest >>= 1
    return out


def points_below(i: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of the points 0..i-1 are below a bound. For each binary digit of i that is 1 the numbers that agree with i above
    it and have a 0 there are a block; its points are a grid that starts at the mirror of what they have in common."""
    total, common = np.zeros_like(i), np.zeros_like(i)
    for k in range(BITS - 1, -1, -1):
        on = i >> k & 1 == 1
        step = np.int64(1) << np.int64(BITS - k)
        total += np.where(on, np.clip(-((common - bound) // step), 0, np.int64(1) << np.int64(k)), 0)
        common += np.where(on, step >> 1, 0)
    return total


@lru_cache(256)
def order_of(blocks: int, seed: int, number: int, turn: int) -> Permutation:
    return Permutation(blocks, [seed, number, turn])


def last_pass(size: int, words: int, block: int, seed: int, number: int) -> tuple[int, int, int, int]:
    """Of a source: whole passes, words beyond them, where the last pass has the short block, and slots in all."""
    if not words:
        return 0, 0, 0, 0
    blocks = -(-size // block)
    whole, rest = divmod(words, size)
    short = blocks * block - size
    place = int(order_of(blocks, seed, number, whole).slots(np.array([blocks - 1]))[0])
    last = -(-rest // block)
    if place < last:
        last = -(-(rest + short) // block)
    return whole, rest, place, whole * blocks + last


def planned(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """``sources`` with words, the whole number of words to take, and slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [last_pass(s, w, block, seed, n)[3] for s, w, n in zip(*(batch.column(c).to_pylist() for c in ("source_size", "words", "number")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slots, pa.int64())], names=[*batch.schema.names, "slots"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sources.schema), "slots long"])
    return sources.mapInArrow(run, fields)


def bounded(sources: DataFrame, slots: int) -> DataFrame:
    """``sources`` with low and high, their part of the points, and given, how many of the first ``slots`` points are there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before, own = (np.array(batch.column(c).to_pylist(), object) for c in ("before_slots", "slots"))
            edge = lambda n: np.array([-((-int(x) << BITS) // slots) for x in n], np.int64)
            low, high = edge(before), edge(before + own)
            every = np.full(len(low), slots, np.int64)
            given = points_below(every, high) - points_below(every, low)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high), pa.array(given), pa.array(np.maximum(own.astype(np.int64) - given, 0))], names=[*batch.schema.names, "low", "high", "given", "missing"])

    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in sources.schema), "low long, high long, given long, missing long"])
    return sources.mapInArrow(run, fields)


def schedule_of(sources: DataFrame, slots: int, cells: int, block: int, seed: int) -> DataFrame:
    """A row for each slot that takes words. ``sources``: number, source_size, words, slots, low, high, given, missing, before_missing."""
    spark = sources.sparkSession
    shift = BITS - cells

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = mirrored(batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x), pa.array(x >> shift)], names=["slot", "point", "cell"])

    own = ["number", "source_size", "words", "low", "high", "slots"]
    every = spark.range(0, slots, 1, max(1, min(slots >> 12, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(points, "slot long, point long, cell long")
    parts = sources.filter("slots > 0").select(*own, F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    met = every.join(parts, "cell").filter("point >= low AND point < high").select("slot", F.lit(None).cast("long").alias("nth"), *own)
    late = sources.filter("missing > 0").select(*own, "before_missing", "given", F.explode(F.sequence(F.col("given"), F.col("slots") - 1)).alias("nth"))
    late = late.select((F.lit(slots) + F.col("before_missing") + F.col("nth") - F.col("given")).alias("slot"), "nth", *own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, number, size, words, low, high, needed = (batch.column(c).to_numpy() for c in ("slot", "number", "source_size", "words", "low", "high", "slots"))
            nth = batch.column("nth").to_numpy(zero_copy_only=False)
            counted = np.isnan(nth) if nth.dtype.kind == "f" else np.zeros(len(slot), bool)
            if counted.any():
                at = np.where(counted, slot, 0)
                nth = np.where(counted, points_below(at, high) - points_below(at, low), np.nan_to_num(nth))
            nth = nth.astype(np.int64)
            turn, chosen, take = (np.zeros(len(slot), np.int64) for _ in range(3))
            for n in np.unique(number).tolist():
                rows = np.flatnonzero((number == n) & (nth < needed))
                if not len(rows):
                    continue
                s, w = int(size[rows[0]]), int(words[rows[0]])
                blocks = -(-s // block)
                short = blocks * block - s
                whole, rest, place, _ = last_pass(s, w, block, seed, n)
                turn[rows], k = np.divmod(nth[rows], blocks)
                for e in np.unique(turn[rows]).tolist():
                    of = turn[rows] == e
                    chosen[rows[of]] = order_of(blocks, seed, n, e).numbers(k[of])
                length = np.where(chosen[rows] == blocks - 1, block - short, block)
                before = k * block - short * (place < k)
                take[rows] = np.where(turn[rows] == whole, np.minimum(length, rest - before), length)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(number), pa.array(turn.astype(np.int32)), pa.array(chosen), pa.array(take)], names=["slot", "number", "pass", "block", "words"]).filter(pa.array(take > 0))

    return met.unionByName(late).mapInArrow(run, SLOT)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 1) -> Mix:
    """``share`` must not exceed ``most``, or no target fits."""
    if share > most:
        raise ValueError("more is asked for than the sources may give")
    text = column(text_col).cast("string")
    name = column(id_col).cast("string")
    # a row number tells repeated rows apart and spreads them over ranges
    sized = staged(df.select(F.monotonically_increasing_id().alias("row"), column(id_col).alias("doc_id"), name.alias("name"), column(source_col).cast("string").alias("source"), column(source_col).isNull().alias("no_source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), name, text).alias("place")), "sized")
    named = staged(sized.groupBy("no_source", "source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one")), "sources")
    ordered = running(named, ["no_source", "source"], ["one", "source_size"])
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("before_one") % len(weights)).cast("int"))
    ordered = ordered.select("no_source", "source", "source_size", F.col("before_one").alias("number"), F.col("before_source_size").alias("stream"), weight.alias("weight"))
    shares = shared_out(ordered, share, most)
    shares = shares.withColumn("words", F.least(F.floor(F.col("source_size") * F.lit(most)), F.floor(F.col("target") + 0.5)).cast("long"))
    plan = staged(planned(shares, block, seed), "planned")
    slots, many = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    counted = staged(bounded(running(plan, ["number"], ["slots"]), max(slots, 1)), "bounded")
    sources = running(counted, ["number"], ["missing"])
    cells = min(30, max(10, (4 * many).bit_length()))
    schedule = staged(schedule_of(sources, slots, cells, block, seed), "schedule")
    own = sources.select(F.col("no_source").alias("none_of"), F.col("source").alias("of"), "number", "stream", "source_size", "target")
    met = F.col("source").eqNullSafe(F.col("of")) & (F.col("no_source") == F.col("none_of"))
    documents = running(sized, ["no_source", "source", "place", "name", "row"], ["size"]).join(own, met)
    documents = staged(documents.select("row", "doc_id", "source", "size", "number", (F.col("before_size") - F.col("stream")).alias("at"), "source_size", "target"), "placed")
    for table in (sized, named, ordered, plan, counted):
        discard(table)
    return Mix(sources, documents, schedule, block)


def slices(mixed: Mix) -> DataFrame:
    """The mix in parts of documents: slot, row, doc_id, start (a word of the document), n_words."""
    at, end, block = F.col("at"), F.col("at") + F.col("size"), F.lit(mixed.block).cast("long")
    div = lambda a: F.call_function("div", a, block)
    parts = mixed.documents.filter("size > 0").select("row", "doc_id", "number", "at", "size", F.explode(F.sequence(div(at), div(end - 1))).alias("block"))
    first = F.greatest(at, F.col("block") * block)
    parts = parts.select("row", "doc_id", "number", "block", (first - at).alias("start"), (first - F.col("block") * block).alias("inside"), (F.least(end, (F.col("block") + 1) * block) - first).alias("n"))
    n = F.least(F.col("words") - F.col("inside"), F.col("n"))
    return parts.join(mixed.schedule, ["number", "block"]).select("slot", "row", "doc_id", "start", n.alias("n_words")).filter("n_words > 0")


def taken_words(mixed: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source) and taken, repeats counted."""
    taken = slices(mixed).groupBy(F.col("row").alias("of")).agg(F.sum("n_words").alias("n"))
    out = mixed.documents.join(taken, F.col("row") == F.col("of"), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).cast("long").alias("taken"))
