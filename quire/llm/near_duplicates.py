"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of shingles of ``width`` words (letters and digits, A-Z in lower case); a text of fewer words, but not
none, is one shingle. Rows with equal sets (by 128 bits) form a text class, which gets a number of its own. Each class
has a MinHash signature; classes that agree in a band of it meet in a bucket. Buckets with the same members count
once. Within a bucket, signatures are compared a few values at a time, and a pair is dropped as soon as the posterior
probability (uniform prior) that its similarity reaches the threshold is below ``tolerance``. What stays connects
classes to candidate groups. In each group all pairs are pruned the same way and the rest is verified exactly on the
shingle sets, so links between classes that share no bucket but a third class are found too.

Buckets and groups of any size are dealt in blocks of their members, by hash: each row is shuffled once. The only block
of a small group is compared where it arrives; blocks of larger groups are written to the shared folder, and the
tasks for pairs of blocks read the two they need. Only the number of links of each class and one edge to the smallest
class it is tied to leave a pair of blocks, never the pairs. Within a bucket, members tied to the same others aren't
compared again, as only what is connected matters there. Equal texts are counted, not compared.

Bands and rows miss a pair of similarity 0.8 with a probability below 2e-5, less above.

Null and empty texts, and texts without letters or digits, resemble nothing: each is a class of its own with
no links. Repeated rows are copies of each other. A null id is the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import as_pairs, by_bytes, column, discard, filesystem, fresh_dir, remove, staged, texts_of
from quire.llm.components import components
from quire.llm.decontamination import words_of

BANDS, ROWS = 28, 5
HASHES = BANDS * ROWS
#: Values compared before each look at the posterior.
STEP = 20
#: Rows of a block: at least and at most, for buckets (signatures) and for groups (shingle sets, and their bytes).
BUCKET_BLOCK, GROUP_BLOCK, BLOCK_BYTES = (256, 4096), (64, 1024), 4 << 20
#: A group has so many blocks before they grow.
BLOCKS = 32


def odd_numbers(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words = [words_of(t) for t in texts]
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*words)}
    factors = odd_numbers(1, width)
    out = []
    for ws in words:
        n = len(ws)
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.array([known[w] for w in ws], np.uint64)
        k = min(n, width)
        x = h[: n - k + 1] * factors[0]
        for i in range(1, k):
            x = x + h[i : n - k + 1 + i] * factors[i]
        out.append(np.unique(mixed(x + np.uint64(k))))
    return out


@lru_cache(1)
def multipliers() -> np.ndarray:
    return odd_numbers(2, HASHES)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value under each hash."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 4096):
        part = shingles[k : k + 4096]
        low = np.minimum(low, np.multiply.outer(multipliers(), part).min(axis=1))
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values the fewest matches at which the pair stays. With a uniform prior
    P(J >= t | m of n) is P(Bin(n + 1, t) <= m)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                out[n] = m
                break
    return out


def surviving(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows a, b) that no look at the posterior drops."""
    matches = np.zeros(len(a), np.int32)
    for n, fewest in least.items():
        if not len(a):
            break
        matches = matches + (sigs[a, n - STEP : n] == sigs[b, n - STEP : n]).sum(axis=1, dtype=np.int32)
        stay = matches >= fewest
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def pairs_within(starts: np.ndarray, sizes: np.ndarray, sides: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same group, a part at a time. ``two``: per group, only rows of different sides pair."""
    group = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(starts + sizes, sizes)
    rows = np.arange(starts[0] if len(starts) else 0, (starts[-1] + sizes[-1]) if len(starts) else 0)
    cross = two[group]
    held_a, held_b, held = [], [], 0
    d = 1
    while len(rows):
        ok = rows + d < left
        rows, left, cross = rows[ok], left[ok], cross[ok]
        go = ~cross | (sides[rows] != sides[rows + d])
        held_a.append(rows[go])
        held_b.append(rows[go] + d)
        held += len(held_a[-1])
        if held > 100_000:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, held = [], [], 0
        d += 1
    if held:
        yield np.concatenate(held_a), np.concatenate(held_b)


def tied(n: int, a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each of n rows the row of smallest ``order`` that it is connected with."""
    label = np.argsort(np.argsort(order, kind="stable"), kind="stable")
    back = np.argsort(label, kind="stable")
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[back[new]])
        if np.array_equal(new, label):
            return back[label]
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_bytes: int) -> Iterator[pa.Table]:
    """Sorted rows regathered so that no group is cut: several groups of at most ``most_bytes``, or one."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most_bytes:
            continue
        table = pa.Table.from_batches(held)
        cols = [table.column(k).to_numpy() for k in keys]
        changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1
        if len(changes):
            cut = int(changes[-1])
            yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held = rest.to_batches()
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    cols = [table.column(k).to_numpy() for k in keys]
    starts = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) + 1]).astype(np.int64)
    return starts, np.diff(np.append(starts, table.num_rows))


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: doc_id, t1, t2 (the text's hashes), h1, h2 (the shingle set's; null without shingles), n (its size), sig."""
    src = as_pairs(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64("text", F.lit(1)).alias("t2"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            h1, h2, n, sigs = [], [], [], []
            for s in shingle_sets(texts_of(batch, "text"), width):
                n.append(len(s))
                if not len(s):
                    h1.append(None), h2.append(None), sigs.append(None)
                    continue
                whole = xxhash.xxh3_128_digest(s.tobytes())
                h1.append(int.from_bytes(whole[:8], "big", signed=True))
                h2.append(int.from_bytes(whole[8:], "big", signed=True))
                sigs.append(signature(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(n, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "t1", "t2", "h1", "h2", "n", "sig"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, t1 long, t2 long, h1 long, h2 long, n long, sig binary")


def buckets(classes: DataFrame) -> DataFrame:
    """key, cls for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, band = odd_numbers(3, ROWS), odd_numbers(4, BANDS)
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = mixed((sigs * factors).sum(axis=2, dtype=np.uint64) * np.uint64(3) + band)
            for k in range(0, len(keys), 2000):
                part = keys[k : k + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().view(np.int64)), pa.array(np.repeat(batch.column("cls").to_numpy()[k : k + 2000], BANDS))], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def block_count(size: str, rows: tuple[int, int], blocks: Column | None = None) -> Column:
    """How many blocks a group of that many rows has: blocks of the fewest rows, larger ones where that would be
    more than ``BLOCKS``, up to the most rows; or as many as its bytes ask for (``blocks``)."""
    block = F.least(F.lit(rows[1]), F.greatest(F.lit(rows[0]), F.ceil(F.col(size) / BLOCKS)))
    n = F.greatest(F.ceil(F.col(size) / block), F.lit(1))
    return (n if blocks is None else F.greatest(n, blocks)).cast("int")


#: What leaves a compared block: a class, the smallest it is tied to, documents and texts it is linked with.
FOUND = "cls long, root long, docs long, texts long"
PLACE = "grp long, side int, file string, at long, bytes long"
Compare = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def in_blocks(rows: DataFrame, compare: Compare, name: str) -> tuple[DataFrame, list[DataFrame], list[str]]:
    """``rows``: grp, blocks, cls and what ``compare`` needs. Compares all pairs of each group: what was found, and the
    tables and folders that may go once it is written."""
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = fresh_dir(spark, f"{name}-blocks")
    dealt = rows.withColumn("side", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int"))
    dealt = dealt.repartition(tasks, "grp", "side").sortWithinPartitions("grp", "side", "cls")
    none = {"grp": pa.int64(), "side": pa.int32(), "file": pa.string(), "at": pa.int64(), "bytes": pa.int64()}
    found = {"cls": pa.int64(), "root": pa.int64(), "docs": pa.int64(), "texts": pa.int64()}

    def arrive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, places = None, 0, []
        store, folder = filesystem(out)
        uri = f"{folder}/{uuid4().hex}"  # an attempt's own; only the rows of the one that counts lead to it
        for table in whole_groups(batches, ["grp", "side"], 8 << 20):
            starts, sizes = group_bounds(table, ["grp", "side"])
            many = table.column("blocks").to_numpy()[starts] > 1
            for s, n in zip(starts[many].tolist(), sizes[many].tolist(), strict=True):
                if file is None:
                    store.create_dir(folder, recursive=True)
                    file = store.open_output_stream(uri)
                data = packed(table.slice(s, n).drop_columns(["grp", "blocks", "side"]).combine_chunks())
                file.write(data)
                places.append((table.column("grp")[s].as_py(), table.column("side")[s].as_py(), uri, at, len(data)))
                at += len(data)
            if many.any():
                table = table.filter(pa.array(np.repeat(~many, sizes)))
            if table.num_rows:
                starts, sizes = group_bounds(table, ["grp", "side"])
                got = compare(table, starts, sizes, np.zeros(len(starts), bool))
                if got is not None:
                    yield pa.RecordBatch.from_arrays([*got.columns, *(pa.nulls(got.num_rows, t) for t in none.values())], names=[*found, *none])
        if file is not None:
            file.close()
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(places), t) for t in found.values()), *(pa.array(c, t) for c, t in zip(zip(*places, strict=True), none.values(), strict=True))], names=[*found, *none])

    first = staged(dealt.mapInArrow(arrive, f"{FOUND}, {PLACE}"), f"{name}-first")
    places = first.filter("file IS NOT NULL").select("grp", "side", "file", "at", "bytes")
    other = places.select(F.col("grp").alias("of"), *[F.col(c).alias(f"{c}2") for c in ("side", "file", "at", "bytes")])
    pairs = places.join(other, (F.col("grp") == F.col("of")) & (F.col("side") <= F.col("side2"))).drop("of")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(out)

        def read(path: str, at: int, n: int) -> pa.Table:
            with store.open_input_file(path) as f:
                return pa.ipc.open_stream(f.read_at(n, at)).read_all()

        for batch in batches:
            for r in batch.to_pylist():
                one = read(r["file"], r["at"], r["bytes"])
                two = r["side"] != r["side2"]
                table = pa.concat_tables([one, read(r["file2"], r["at2"], r["bytes2"])]) if two else one
                n = np.array([table.num_rows])
                table = table.append_column("side", pa.array(np.repeat(np.array([0, 1], np.int32), [one.num_rows, table.num_rows - one.num_rows])))
                got = compare(table, np.zeros(1, np.int64), n, np.array([two]))
                if got is not None:
                    yield got

    rest = pairs.repartition(tasks).mapInArrow(meet, FOUND)
    return first.filter("cls IS NOT NULL").select("cls", "root", "docs", "texts").union(rest), [first], [out]


def one_component(sigs: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what all surviving pairs of these rows connect. A row that isn't tied yet is compared with
    all, then rows of different components with each other; in a bucket of near copies that is one comparison a row."""
    n = len(sigs)
    every = np.arange(n)
    edges_a, edges_b = [], []
    covered = np.zeros(n, bool)
    for lead in range(n):
        if not covered[lead]:
            a, b = surviving(sigs, np.full(n, lead), every, least)
            covered[b] = True
            edges_a.append(a)
            edges_b.append(b)
    part = tied(n, np.concatenate(edges_a), np.concatenate(edges_b), every)
    if (part != part[0]).any():
        for a, b in pairs_within(np.zeros(1, np.int64), np.array([n]), np.zeros(n, np.int32), np.zeros(1, bool)):
            other = part[a] != part[b]
            a, b = surviving(sigs, a[other], b[other], least)
            edges_a.append(a)
            edges_b.append(b)
    return np.concatenate(edges_a), np.concatenate(edges_b)


def candidate_edges(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """a, b: classes that a bucket ties together after pruning."""
    keys = buckets(classes)
    h = lambda seed: F.bit_xor(F.xxhash64("cls", F.lit(seed)))
    full = keys.groupBy("key").agg(F.count("*").alias("m"), h(3).alias("s1"), h(4).alias("s2")).filter("m > 1")
    # buckets with equal members say the same; one of them is enough
    once = staged(full.groupBy("m", "s1", "s2").agg(F.min("key").alias("kept")).select("kept", "m"), "buckets")
    members = staged(keys.join(once, F.col("key") == F.col("kept")).select("key", "m", "cls"), "members")
    rows = members.join(classes.select(F.col("cls").alias("of"), "sig"), F.col("cls") == F.col("of")).select(F.col("key").alias("grp"), block_count("m", BUCKET_BLOCK).alias("blocks"), "cls", "sig")

    def compare(table: pa.Table, starts: np.ndarray, sizes: np.ndarray, two: np.ndarray) -> pa.RecordBatch | None:
        least = least_matches(threshold, tolerance)
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        cls = table.column("cls").to_numpy()
        large = sizes > GROUP_BLOCK[0]
        got = []
        for s, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            a, b = one_component(sigs[s : s + n], least)
            got.append((a + s, b + s))
        rows = np.flatnonzero(np.repeat(~large, sizes))
        if len(rows):
            ends = np.cumsum(sizes[~large])
            got += [(rows[a], rows[b]) for x in pairs_within(ends - sizes[~large], sizes[~large], np.zeros(len(rows), np.int32), np.zeros(len(ends), bool)) for a, b in [surviving(sigs[rows], *x, least)]]
        if not got:
            return None
        names, at = np.unique(cls, return_inverse=True)
        a, b = (at[np.concatenate(x)] for x in zip(*got, strict=True))
        root = names[tied(len(names), a, b, names)]
        moved = root != names
        none = pa.array(np.zeros(int(moved.sum()), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(root[moved]), none, none], names=["cls", "root", "docs", "texts"])

    found, tables, folders = in_blocks(rows, compare, "buckets")
    edges = staged(found.select(F.col("cls").alias("a"), F.col("root").alias("b")), "edges")
    for t in (once, members, *tables):
        discard(t)
    for f in folders:
        remove(classes.sparkSession, f)
    return edges


def exact_links(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of sets is at least ``threshold``, from exact counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows_a, rows_b = np.unique(a), np.unique(b)
    if len(a) > 2 * (len(rows_a) + len(rows_b)):
        # counts of common shingles of all rows at once, a slice of the shingles at a time; what all rows have is
        # counted without a product, and what one row has is in no other
        rows = np.union1d(rows_a, rows_b)
        flat = np.concatenate([sets[r] for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        _, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
        always = int((times == len(rows)).sum())
        new = np.full(len(times), -1)
        some = (times > 1) & (times < len(rows))
        new[some] = np.arange(int(some.sum()))
        ids = new[ids]
        owner, ids = owner[ids >= 0], ids[ids >= 0]
        order = np.argsort(ids, kind="stable")
        ids, owner = ids[order], owner[order]
        at_a, at_b = np.searchsorted(rows, rows_a), np.searchsorted(rows, rows_b)
        common = np.full((len(rows_a), len(rows_b)), always, np.float32)
        step = max(1, (4 << 20) // len(rows))
        for lo in range(0, int(some.sum()), step):
            x, y = np.searchsorted(ids, [lo, lo + step])
            part = np.zeros((len(rows), min(step, int(some.sum()) - lo)), np.float32)
            part[owner[x:y], ids[x:y] - lo] = 1
            common += part[at_a] @ part[at_b].T
        both = common[np.searchsorted(rows_a, a), np.searchsorted(rows_b, b)].round().astype(np.int64)
    else:
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    return both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9


def verified(df: DataFrame, classes: DataFrame, groups: DataFrame, id_col: str, text_col: str, width: int, threshold: float, tolerance: float) -> DataFrame:
    """cls, root, docs, texts: for each class and pair of blocks with links the smallest class it is tied to there,
    and the number of documents and of other texts it is linked with."""
    members = groups.join(classes.select("cls", "copies", "n", "sig", "rep"), F.col("member") == F.col("cls"))
    sizes = staged(members.groupBy(F.col("grp").alias("of")).agg(F.count("*").alias("m"), F.sum("n").alias("held")), "sizes")
    blocks = block_count("m", GROUP_BLOCK, F.ceil(8 * F.col("held") / BLOCK_BYTES))
    chosen = staged(
        members.join(sizes, F.col("grp") == F.col("of")).select("grp", blocks.alias("blocks"), "cls", "copies", "sig", F.col("rep.doc_id").alias("rep_id"), F.col("rep.t1").alias("rep1"), F.col("rep.t2").alias("rep2")),
        "chosen",
    )
    text = as_pairs(df, id_col, text_col).withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64("text", F.lit(1)))
    joined = text.join(chosen, (F.col("t1") == F.col("rep1")) & (F.col("t2") == F.col("rep2")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("grp", "blocks", "cls", "copies", "sig", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(texts_of(batch, "text"), width)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("grp", "blocks", "cls", "copies", "sig")), pa.array(sets, pa.binary())], names=["grp", "blocks", "cls", "copies", "sig", "shingles"])

    def compare(table: pa.Table, starts: np.ndarray, sizes: np.ndarray, two: np.ndarray) -> pa.RecordBatch | None:
        least = least_matches(threshold, tolerance)
        cls, copies, side = (table.column(c).to_numpy() for c in ("cls", "copies", "side"))
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        # a repeated row can bring the same representative twice
        again = np.concatenate([[False], (cls[1:] == cls[:-1])])
        links = [[], []]
        for a, b in pairs_within(starts, sizes, side, two):
            new = ~(again[a] | again[b])
            a, b = surviving(sigs, a[new], b[new], least)
            if not len(a):
                continue
            group = np.searchsorted(starts, a, side="right")
            order = np.argsort(group, kind="stable")
            a, b, group = a[order], b[order], group[order]
            for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(a)]])), strict=True):
                ok = exact_links(sets, a[lo:hi], b[lo:hi], threshold)
                links[0].append(a[lo:hi][ok])
                links[1].append(b[lo:hi][ok])
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in links)
        if not len(a):
            return None
        n = len(cls)
        docs = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        texts = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        root = cls[tied(n, a, b, cls)]
        has = texts > 0
        return pa.RecordBatch.from_arrays([pa.array(cls[has]), pa.array(root[has]), pa.array(docs[has].astype(np.int64)), pa.array(texts[has].astype(np.int64))], names=["cls", "root", "docs", "texts"])

    rows = joined.mapInArrow(to_sets, "grp long, blocks int, cls long, copies long, sig binary, shingles binary")
    found, tables, folders = in_blocks(rows, compare, "groups")
    links = staged(found, "links")
    for t in (sizes, chosen, *tables):
        discard(t)
    for f in folders:
        remove(df.sparkSession, f)
    return links


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-5) -> DataFrame:
    """Per row: doc_id, t1, t2, class_id (the smallest id of its class), n_links (other rows of at least that
    similarity, copies included), n_texts (of them, different shingle sets), first (the one row, up to equal
    rows, that stands for the class)."""
    docs = staged(signatures(df, id_col, text_col, width), "signatures")
    classes = docs.filter(F.col("h1").isNotNull()).groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "t1", "t2")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    # once written, numbers don't change; no two classes have the same one
    classes = staged(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    edges = candidate_edges(classes, threshold, tolerance)
    found = components(edges, "candidates")
    # the root is a member too
    groups = staged(found.select(F.col("node").alias("member"), F.col("root").alias("grp")).union(found.select("root", "root").distinct()), "groups")
    links = verified(df, classes, groups, id_col, text_col, width, threshold, tolerance)
    roots = components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), "classes")
    counts = links.groupBy(F.col("cls").alias("linked")).agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    named = staged(
        classes.select("cls", "h1", "h2", "copies", "rep").join(roots, F.col("cls") == F.col("node"), "left").join(counts, F.col("cls") == F.col("linked"), "left")
        .select("h1", "h2", "copies", "rep", F.coalesce("root", "cls").alias("root"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("texts")),
        "named",
    )
    firsts = staged(named.groupBy(F.col("root").alias("top")).agg(F.min("rep").alias("head")), "firsts")
    info = staged(named.join(firsts, F.col("root") == F.col("top")).select(F.col("h1").alias("of1"), F.col("h2").alias("of2"), "copies", "docs", "texts", "head"), "info")
    for t in (classes, edges, found, groups, links, roots, named, firsts):
        discard(t)
    return docs.select("doc_id", "t1", "t2", "h1", "h2").join(info, (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")), "left").select(
        "doc_id",
        "t1",
        "t2",
        F.when(F.col("of1").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce(F.col("docs") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("texts"), F.lit(0)).alias("n_texts"),
        (F.col("of1").isNull() | F.struct("doc_id", "t1", "t2").eqNullSafe(F.col("head"))).alias("first"),
    )


def keep_firsts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of each class, the one with the smallest id, with its columns."""
    marked = near_duplicates(df, id_col, text_col, width, threshold)
    heads = staged(marked.filter("first").groupBy(*[F.col(c).alias(f"__head_{c}") for c in ("doc_id", "t1", "t2")]).agg(F.count("*").alias("__head_k")), "heads")
    text = column(text_col).cast("string")
    kept = df.join(heads, column(id_col).eqNullSafe(F.col("__head_doc_id")) & (F.xxhash64(text) == F.col("__head_t1")) & (F.xxhash64(text, F.lit(1)) == F.col("__head_t2")))
    if heads.filter("__head_k > 1").limit(1).collect():  # equal rows: one of them
        kept = kept.dropDuplicates(["__head_doc_id", "__head_t1", "__head_t2"])
    return kept.select(*map(column, df.columns))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT rid, w, least(len(w), 5) AS k FROM docs WHERE len(w) > 0))),
sizes AS (SELECT rid, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS whole FROM shingles GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
link AS (
  SELECT x, y, p.whole <> q.whole AS other, p.whole AS xw, q.whole AS yw FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE c >= 0.8 * (p.n + q.n - c) - 1e-9),
both_ AS (SELECT x, y, other, yw FROM link UNION ALL SELECT y, x, other, xw FROM link),
reach AS (SELECT rid AS s, rid AS t FROM docs UNION SELECT reach.s, both_.y FROM reach JOIN both_ ON reach.t = both_.x),
class AS (SELECT s, min(doc_id) AS class_id FROM reach JOIN docs ON docs.rid = t GROUP BY s),
counts AS (SELECT x, count(*) AS n_links, count(DISTINCT CASE WHEN other THEN yw END) AS n_texts FROM both_ GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(coalesce(n_texts, 0) AS BIGINT) AS n_texts
FROM docs JOIN class ON class.s = docs.rid LEFT JOIN counts ON counts.x = docs.rid
"""
