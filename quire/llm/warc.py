"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by page id: the id range is cut into cells of equal powers of two, the cells' payload bytes are
summed and consecutive cells form about ``shards`` shards of like size, so the cuts follow from the rows and
``shards`` alone (no sampling). A cell larger than a shard is split by payload digest. Within a shard records
are ordered by id and digest; each record is a gzip member of its own, and a file is rolled when its
compressed size reaches ``roll_bytes``. Headers and digests are made anew. A file is written under a
temporary name and then moved; a manifest in Parquet, committed last, names the files, so a lost executor or
a second attempt changes nothing (both attempts write equal bytes); what a failed attempt left under a temporary name
is removed after the manifest. A task writes one shard. Any 64-bit ids will do.

Of equal payloads the record with the smallest page id is a response and the others are revisits of it;
empty payloads too. A null payload is empty. Null ids sort last into a shard of their own and are a response
only if all ids of that payload are null. Of repeated rows with equal id and payload the first is the
response. Payloads of revisits don't travel through the shuffle, so one payload may have any number of copies.
An empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import by_bytes, column, discard, filesystem, staged

MANIFEST = "file string, shard int, part int, records long, bytes long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page, digest: str, n: int) -> str:
    return f"urn:x-page:{'' if page is None else page}:{digest}:{n}"


def record(page, url: str | None, payload: bytes | None, digest: str, size: int, n: int, first, date: str) -> bytes:
    """One record as a gzip member; a revisit where ``payload`` is None."""
    own = record_id(page, digest, n)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <{own}>", f"WARC-Date: {date}"]
    lines.append("WARC-Target-URI: " + (UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else own))
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(first, digest, 0)}>"]
    else:
        block += payload
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Roller:
    """Writes the files of a task, one after the other."""

    def __init__(self, out_uri: str, roll_bytes: int):
        self.store, self.path = filesystem(out_uri)
        self.roll_bytes, self.file, self.shard, self.part = roll_bytes, None, None, 0
        self.done: list[tuple] = []

    def put(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.file is None:
            self.store.create_dir(f"{self.path}/.tmp", recursive=True)
            self.tmp = f"{self.path}/.tmp/{uuid.uuid4().hex}"
            self.file, self.records, self.bytes = self.store.open_output_stream(self.tmp), 0, 0
        self.file.write(data)
        self.records += 1
        self.bytes += len(data)
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.file is None:
            return
        self.file.close()
        self.file = None
        name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
        self.store.move(self.tmp, f"{self.path}/{name}")
        self.done.append((name, self.shard, self.part, self.records, self.bytes))
        self.part += 1


def cell_of(page: Column, shift: int, first: int) -> Column:
    """A page's cell of 2 ** shift ids, counted from the first; -1 without an id. Shifts of whole numbers are exact
    and can't overflow, however far apart ids are."""
    return F.coalesce(F.shiftright(page, shift) - F.lit(first), F.lit(-1))


def shard_cells(rows: DataFrame, shards: int) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(shift, first cell's number, [(cell, first shard, splits)]); cell -1 is for null ids. At most
    64 cells for each shard come to the driver."""
    lo, hi = rows.agg(F.min("page"), F.max("page")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    shift = next(s for s in range(65) if (hi >> s) - (lo >> s) < 64 * shards)
    # a record costs about a kilobyte besides its payload
    sizes = sorted((r.cell, r.bytes) for r in rows.groupBy(cell_of(F.col("page"), shift, lo >> shift).alias("cell")).agg(F.sum(F.col("n_bytes") + 1000).alias("bytes")).collect())
    target = max(1, -(-sum(b for _, b in sizes) // shards))
    out, shard, held = [], 0, 0
    for c, b in sizes[1:] + sizes[:1] if sizes and sizes[0][0] == -1 else sizes:
        if held and (held + b > target or c == -1):
            shard, held = shard + 1, 0
        splits = max(1, -(-b // (2 * target)))
        out.append((c, shard, splits))
        held += b
        if splits > 1:
            shard, held = shard + splits, 0
    return shift, lo >> shift, out


def write_warc(df: DataFrame, out_uri: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", shards: int | None = None, roll_bytes: int = 256 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row to ``out_uri`` and returns the manifest. Ids are whole numbers.
    ``shards``: by default the session's number of shuffle partitions, or one for each 64 MB if that is more."""
    spark = df.sparkSession
    body = F.encode(F.coalesce(column(payload_col).cast("string"), F.lit("")), "UTF-8")
    pages = df.select(column(id_col).cast("long").alias("page"), column(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("sha", F.sha1("payload"))
    narrow = staged(pages.select("page", "sha", F.octet_length("payload").cast("long").alias("n_bytes")), "digests")
    size = narrow.agg(F.sum("n_bytes")).first()[0] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    copies = staged(narrow.groupBy(F.col("sha").alias("copied")).agg(F.count("*").alias("k"), F.min("page").alias("first")).filter("k > 1").select("copied", "first"), "copies")
    shift, least, cells = shard_cells(narrow, shards)
    where = spark.createDataFrame(cells, "cell long, base int, splits int")
    has = F.col("copied").isNull() | F.col("first").isNull() | (F.col("first") == F.col("page"))
    rows = (
        pages.join(copies, F.col("sha") == F.col("copied"), "left")
        .withColumn("cell", cell_of(F.col("page"), shift, least))
        .join(F.broadcast(where), "cell")  # at most 64 rows for each shard
        .select((F.col("base") + F.pmod(F.crc32("sha"), F.col("splits"))).cast("int").alias("shard"), "page", "url", "sha", F.octet_length("payload").cast("long").alias("n_bytes"), F.when(has, F.col("payload")).alias("payload"), "first")
    )
    total = max([b + s for _, b, s in cells], default=1)
    ordered = rows.repartitionById(max(total, 1), F.col("shard")).sortWithinPartitions("shard", F.col("page").asc_nulls_last(), "sha", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, n = Roller(out_uri, roll_bytes), None, 0
        for batch in by_bytes(batches, "payload"):
            for r in batch.to_pylist():
                key = (r["shard"], r["page"], r["sha"])
                n = n + 1 if key == last else 0
                last = key
                digest = base32(r["sha"])
                roller.put(r["shard"], record(r["page"], r["url"], r["payload"] if n == 0 else None, digest, r["n_bytes"], n, r["first"] if r["first"] is not None else r["page"], date))
        roller.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "shard", "part", "records", "bytes"), x, strict=True)) for x in roller.done], schema=pa.schema([("file", pa.string()), ("shard", pa.int32()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64())]))

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{out_uri}/_manifest")
    discard(narrow)
    discard(copies)
    store, path = filesystem(out_uri)
    if store.get_file_info(f"{path}/.tmp").type.name == "Directory":  # with what failed attempts left
        store.delete_dir(f"{path}/.tmp")
    return spark.read.schema(MANIFEST).parquet(f"{out_uri}/_manifest")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked whole."""
    unpacker, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(unpacker.decompress(data))
            data = unpacker.unused_data
            if unpacker.eof:
                yield b"".join(out)
                unpacker, out = zlib.decompressobj(31), []
    if any(out):
        raise ValueError("an archive ends inside a record")


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (size != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't match its digest")
    number = lambda uri: int(x) if (x := uri.strip("<>").split(":")[2]) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, out_uri: str, payloads: bool = True) -> DataFrame:
    """The records of all files in the manifest: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and payload unless ``payloads`` is false. Payload digests are verified."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(out_uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for data in members(f):
                        rows.append(parse(data))
                        held += len(data) if payloads else 500
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.schema(MANIFEST).parquet(f"{out_uri}/_manifest").select("file", "shard")
    shards = (files.agg(F.max("shard")).first()[0] or 0) + 1
    fields = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.repartitionById(shards, F.col("shard")).mapInArrow(read, fields)


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first,
         row_number() OVER (PARTITION BY page_id, coalesce(html, '')) AS n FROM pages),
x AS (SELECT *, sha1(h) AS hex, page_id IS NOT DISTINCT FROM first AND n = 1 AS own FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST((i // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT own THEN first END AS refers_to
FROM x
"""
