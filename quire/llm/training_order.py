"""Training-order materialisation: token sequences in a keyed random order, in fixed-stride binary shards.

Texts are encoded, each followed by an end token, and packed into sequences of ``length`` tokens, task by task;
only a task's last sequence is padded. The packed table is written to the shared folder and fixes a dense
number for each sequence (its task's offset plus its place). A keyed Feistel network over the next power of
four permutes the numbers; values outside the range are encrypted again until they fall inside (cycle
walking), so slots are a bijection that anyone with the key can compute. Shard s holds the slots from
s * stride on; each is written by one task, sequentially, under a temporary name that is then moved. An index in
Parquet says which part of which document is where; the layout, moved to its name last, makes the folder readable.
What a run that failed left there is replaced, a finished folder is refused. Any run of slots is read
sequentially from any slot on, so a training run resumes at a number.

The order depends on the rows, the key and how the input is dealt to tasks; the packed table keeps it through
lost executors. Null and empty texts are an end token. Repeated rows are encoded each. An empty table gives no
shards.
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from quire.llm.common import as_pairs, by_bytes, discard, filesystem, staged, texts_of

ROUNDS = 6
#: Of the packed table: its pages hold many sequences, which compress better together.
ZSTD = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}


class Permutation:
    """Keyed bijection of 0..n-1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = np.random.default_rng(key).integers(0, 2**63, ROUNDS, dtype=np.uint64)

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))

    def _rounds(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (self._mix(right + k) & self.mask)
        return right << self.half | left  # halves swapped, so reversed keys undo it

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        out = self._rounds(np.asarray(x, np.uint64), keys)
        far = np.flatnonzero(out >= self.n)
        while len(far):
            out[far] = self._rounds(out[far], keys)
            far = far[out[far] >= self.n]
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def dictionary(table: DataFrame, sequences: int = 400):
    """What helps to compress single sequences, from a few of them; None if they are too few or too alike. It has
    no influence on what is written."""
    import zstandard

    try:
        return zstandard.train_dictionary(112 << 10, [r.tokens for r in table.select("tokens").limit(sequences).collect()]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


PARTS = "array<struct<doc_id: {0}, start: int, n_tokens: int, doc_start: long>>"


def packed(df: DataFrame, ranks_path: str, pattern: str, length: int, id_col: str, text_col: str) -> DataFrame:
    """task, place, n_tokens, tokens (little-endian, 2 bytes while ids fit), parts."""
    src = as_pairs(df, id_col, text_col)
    id_field = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoding(ranks_path, pattern)
        kind = np.dtype("<u2" if end < 1 << 16 else "<u4")
        task, place = TaskContext.get().partitionId(), 0
        tokens, filled, parts = np.zeros(length, kind), 0, []
        rows: list[tuple[int, int, bytes, list[dict]]] = []
        schema = None

        def out(id_type: pa.DataType) -> pa.RecordBatch:
            nonlocal rows
            n, used, data, where = zip(*rows, strict=True)
            rows = []
            part_type = pa.list_(pa.struct([("doc_id", id_type), ("start", pa.int32()), ("n_tokens", pa.int32()), ("doc_start", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([task] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(used, pa.int32()), pa.array(data, pa.binary()), pa.array(where, part_type)], names=["task", "place", "n_tokens", "tokens", "parts"])

        for batch in by_bytes(batches, "text"):
            schema = batch.schema.field("doc_id").type
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                ids = np.append(enc.encode_to_numpy(text, disallowed_special=()), end).astype(kind)
                done = 0
                while done < len(ids):
                    k = min(length - filled, len(ids) - done)
                    tokens[filled : filled + k] = ids[done : done + k]
                    parts.append({"doc_id": doc, "start": filled, "n_tokens": k, "doc_start": done})
                    filled, done = filled + k, done + k
                    if filled == length:
                        rows.append((place, filled, tokens.tobytes(), parts))
                        place, filled, parts = place + 1, 0, []
                        if len(rows) >= 500:
                            yield out(schema)
        if filled:
            rows.append((place, filled, tokens[:filled].tobytes(), parts))
        if rows:
            yield out(schema)

    return src.mapInArrow(run, f"task int, place long, n_tokens int, tokens binary, parts {PARTS.format(id_field)}")


def materialise(df: DataFrame, out_uri: str, ranks_path: str, pattern: str, key: int = 1, length: int = 2048, shard_bytes: int = 1 << 30, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards and their index to ``out_uri``; returns the index: slot, shard, byte_offset, n_tokens,
    parts. There are at least ``shards`` shards (the session's shuffle partitions), more where one would
    exceed ``shard_bytes``."""
    spark = df.sparkSession
    table = staged(packed(df, ranks_path, pattern, length, id_col, text_col), "packed", **ZSTD)
    counts = {r.task: r.n for r in table.groupBy("task").agg(F.count("*").alias("n")).collect()}  # a number a task
    offsets, n = {}, 0
    for task in sorted(counts):
        offsets[task], n = n, n + counts[task]
    _, end = encoding(ranks_path, pattern)
    width = length * (2 if end < 1 << 16 else 4)
    least = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stride = max(1, min(-(-n // least), shard_bytes // width)) if n else 1
    total = -(-n // stride)
    at = spark.sparkContext.broadcast(offsets)
    hints = spark.sparkContext.broadcast(dictionary(table))
    store, path = filesystem(out_uri)
    store.create_dir(path, recursive=True)
    own_files = [f for f in store.get_file_info(fs.FileSelector(path)) if re.fullmatch(r"shard-\d+\.bin|_layout\.json|\..*\.tmp", f.base_name)]
    if any(f.base_name == "_layout.json" for f in own_files):
        raise ValueError(f"{out_uri} already holds an order")
    for f in own_files:
        store.delete_file(f.path)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        order = Permutation(n, key)
        shrink = zstandard.ZstdCompressor(level=6, dict_data=hints.value and zstandard.ZstdCompressionDict(hints.value)).compress
        for batch in batches:
            if batch.num_rows:
                base = np.array([at.value[t] for t in batch.column("task").to_pylist()], np.int64)
                slot = order.slots(base + batch.column("place").to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array((slot // stride).astype(np.int32)), batch.column("n_tokens"), pa.array([shrink(t) for t in batch.column("tokens").to_pylist()], pa.binary()), batch.column("parts")], names=["slot", "shard", "n_tokens", "tokens", "parts"])

    parts = table.schema["parts"].dataType.simpleString()
    dealt = table.mapInArrow(place, f"slot long, shard int, n_tokens int, tokens binary, parts {parts}")
    dealt = dealt.repartitionById(total, F.col("shard")) if total > 1 else dealt.coalesce(1)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, folder = filesystem(out_uri)
        grow = zstandard.ZstdDecompressor(dict_data=hints.value and zstandard.ZstdCompressionDict(hints.value)).decompress
        file, shard, tmp, expect = None, None, "", 0

        def close() -> None:
            if file is not None:
                file.close()
                own.move(tmp, f"{folder}/shard-{shard:06d}.bin")

        for batch in batches:
            for slot, s, data in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "tokens")), strict=True):
                if s != shard:
                    close()
                    tmp = f"{folder}/.{uuid.uuid4().hex}.tmp"
                    file, shard, expect = own.open_output_stream(tmp), s, s * stride
                if slot != expect:
                    raise ValueError(f"slot {slot} found where {expect} belongs")
                expect += 1
                file.write(grow(data).ljust(width, b"\0"))
            if batch.num_rows:
                offset = (batch.column("slot").to_numpy() % stride) * width
                yield pa.RecordBatch.from_arrays([batch.column("slot"), batch.column("shard"), pa.array(offset), batch.column("n_tokens"), batch.column("parts")], names=["slot", "shard", "byte_offset", "n_tokens", "parts"])
        close()

    index = f"slot long, shard int, byte_offset long, n_tokens int, parts {parts}"
    dealt.sortWithinPartitions("slot").mapInArrow(write, index).write.mode("overwrite").parquet(f"{out_uri}/_index")
    discard(table)
    with store.open_output_stream(f"{path}/.layout.tmp") as f:
        f.write(json.dumps({"sequences": n, "length": length, "bytes_per_token": width // length, "stride": stride, "key": key, "end": end}).encode())
    store.move(f"{path}/.layout.tmp", f"{path}/_layout.json")
    return spark.read.schema(index).parquet(f"{out_uri}/_index")


class SlotReader:
    """Sequential reads from any slot on."""

    def __init__(self, out_uri: str):
        self.store, self.path = filesystem(out_uri)
        with self.store.open_input_stream(f"{self.path}/_layout.json") as f:
            self.layout = json.loads(f.read())

    def read(self, start: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
        """The sequences of slots from ``start`` on, padding included."""
        x = self.layout
        stop = x["sequences"] if count is None else min(start + count, x["sequences"])
        width, kind = x["length"] * x["bytes_per_token"], f"<u{x['bytes_per_token']}"
        while start < stop:
            shard, first = divmod(start, x["stride"])
            with self.store.open_input_file(f"{self.path}/shard-{shard:06d}.bin") as f:
                f.seek(first * width)
                for _ in range(min(stop, (shard + 1) * x["stride"]) - start):
                    yield np.frombuffer(f.read(width), kind)
                    start += 1


def document_parts(index: DataFrame) -> DataFrame:
    """A row for each part of a document: where its sequence is, where the part starts in it (in tokens), and
    which token of the document that is."""
    rows = index.select("slot", "shard", "byte_offset", F.explode("parts").alias("p"))
    return rows.select("p.doc_id", "slot", "shard", F.col("byte_offset").alias("sequence_offset"), F.col("p.start").alias("start"), F.col("p.n_tokens").alias("n_tokens"), F.col("p.doc_start").alias("doc_start"))
