"""Data sources of their own: page rasters of large files, named files with commit and abort, and the event log by cursor.

    register(spark, page_count, render)
    spark.read.format("page_rasters").option("dpi", "150").option("lastPage", "3").load(root)
    write_files(df, out_uri)          # file, place, value
    spark.readStream.format("event_log").option("path", log).option("afterId", "42").load()

Paths are of any store that pyarrow or Spark's driver can list; they are read by tasks, never through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from quire.functions import fixed
from quire.sources.store import filesystem

#: Bytes of a file for which one task decodes pages; messages of errors are cut there.
TASK_BYTES = 64 << 20


# --- pages of files


class PageRange(InputPartition):
    """A part of a file's pages: part ``k`` of ``of`` equal ones."""

    def __init__(self, path: str, k: int, of: int):
        self.path, self.k, self.of = path, k, of


class PageReader(DataSourceReader):
    """Large files are dealt to several tasks by parts of their pages. Which pages to decode are options (``files`` and ``pages``, separated by
    new lines and commas, ``firstPage``, ``lastPage``): a DataFrame keeps what a first query has pushed into a Python source for all
    later ones, so filters that are pushed would be wrong for these. With ``images`` false no page is decoded."""

    def __init__(self, options: dict, page_count: Callable[[bytes], int], render: Callable[[bytes, int, float], bytes]):
        self.root, self.suffix = options["path"], options.get("suffix", ".pdf").lower()
        self.scale = float(options.get("dpi", fixed.DPI)) / fixed.DPI
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.images = options.get("images", "true").lower() == "true"
        self.page_count, self.render = page_count, render
        self.paths = set(options["files"].split("\n")) if "files" in options else None
        self.only = set(map(int, options["pages"].split(","))) if "pages" in options else None
        self.first, self.last = int(options.get("firstPage", 1)), int(options.get("lastPage", 2**31 - 1))

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, root = filesystem(self.root)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            if f.is_file and f.path.lower().endswith(self.suffix) and (self.paths is None or f.path in self.paths):
                of = max(1, -(-f.size // self.task_bytes))
                out += [PageRange(f.path, k, of) for k in range(of)]
        return out or [PageRange("", 0, 1)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if not partition.path:
            return
        store, _ = filesystem(self.root)
        with store.open_input_file(partition.path) as f:
            data = f.read()
        try:
            n = self.page_count(data)
        except Exception as e:  # a broken file is reported, not fatal, and once
            if partition.k == 0:
                yield partition.path, 0, None, str(e)[: fixed.SNIPPET]
            return
        a, b = n * partition.k // partition.of + 1, n * (partition.k + 1) // partition.of
        for page in range(max(a, self.first), min(b, self.last) + 1):
            if self.only is not None and page not in self.only:
                continue
            image, error = None, None
            try:
                image = self.render(data, page, self.scale) if self.images else None
            except Exception as e:
                error = str(e)[: fixed.SNIPPET]
            yield partition.path, page, image, error


def page_rasters(page_count: Callable[[bytes], int], render: Callable[[bytes, int, float], bytes]) -> type[DataSource]:
    class PageRasters(DataSource):
        @classmethod
        def name(cls) -> str:
            return "page_rasters"

        def schema(self) -> str:
            return "path string, page_no int, image binary, error string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return PageReader(self.options, page_count, render)

    return PageRasters


# --- named files


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary name, name


class FileWriter(DataSourceWriter):
    """Tasks write under temporary names in a folder that only this job knows; the driver moves the files to their names once all
    are whole, and removes the folder if the job fails. A job that dies shows none of them."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.job = f"_job-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, path = filesystem(self.path)
        tmp = f"{path}/{self.job}"
        store.create_dir(tmp, recursive=True)
        files: list[tuple[str, str]] = []
        out, name = None, None
        for row in iterator:
            if out is None or row.file != name:
                if out is not None:
                    out.close()
                name = row.file
                files.append((f"{tmp}/{uuid.uuid4().hex}", f"{path}/{name}"))
                out = store.open_output_stream(files[-1][0])
            out.write(row.value.encode() + b"\n")
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        store, path = filesystem(self.path)
        names = [name for m in messages if m for _, name in m.files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("the rows of a file came from several tasks")
        for m in messages:
            for tmp, name in m.files if m else ():
                store.create_dir(name.rpartition("/")[0], recursive=True)
                store.move(tmp, name)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, path = filesystem(self.path)
        if store.get_file_info(f"{path}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/{self.job}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, place long, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options)


def write_files(df: DataFrame, out_uri: str, partitions: int | None = None) -> None:
    """``df``: file, place, value. Each file's values as lines in order of place; all files appear at the end, or none."""
    df.sparkSession.dataSource.register(NamedFiles)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.selectExpr("CAST(file AS STRING) AS file", "CAST(place AS LONG) AS place", "CAST(value AS STRING) AS value")
    rows.repartition(n, "file").sortWithinPartitions("file", "place").write.format("named_files").mode("append").save(out_uri)


# --- the event log by cursor


class IdRange(InputPartition):
    def __init__(self, after: int, to: int):
        self.after, self.to = after, to


class LogReader(DataSourceStreamReader):
    """Rows by their ids, which are given out in order: the offset is the last id that was read, so a file that is appended twice, or
    compacted, is read once. The driver reads footers only. ``afterId`` is where a first run begins, ``maxRows`` what it takes at
    once, ``rowsATask`` what a task does."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()
        self.key = options.get("id", "id")
        self.start, self.most, self.each = int(options.get("afterId", 0)), int(options.get("maxRows", 1_000_000)), int(options.get("rowsATask", 100_000))
        self.planned = self.start
        self.seen: dict[str, int] = {}

    def newest(self) -> int:
        from pyarrow import fs

        store, path = filesystem(self.path)
        for f in store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
            if f.is_file and f.path.endswith(".parquet") and f.path not in self.seen:
                meta = pq.read_metadata(f.path, filesystem=store)
                at = meta.schema.names.index(self.key)
                stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
                self.seen[f.path] = max((s.max for s in stats if s is not None and s.has_min_max), default=0)
        return max(self.seen.values(), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"id": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        self.planned = max(self.planned, min(self.newest(), self.planned + self.most))
        return {"id": self.planned}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.planned = max(self.planned, end["id"])
        return [IdRange(a, min(a + self.each, end["id"])) for a in range(start["id"], end["id"], self.each)]

    def read(self, partition: IdRange) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(self.path)
        files = ds.dataset(path, format="parquet", filesystem=store)
        key = ds.field(self.key)
        got = files.to_table(columns=self.names, filter=(key > partition.after) & (key <= partition.to)).sort_by(self.key).combine_chunks()
        if got.num_rows:
            ids = got.column(self.key).combine_chunks()
            first = pa.concat_arrays([pa.array([True]), pc.not_equal(ids[1:], ids[:-1])]) if len(ids) > 1 else pa.array([True])
            yield from got.filter(first).to_batches()

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return "id long, ts double, level string, message string, book_id long, page_no int"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogReader(self.options, schema)


def register(spark: SparkSession, page_count: Callable[[bytes], int] | None = None, render: Callable[[bytes, int, float], bytes] | None = None) -> None:
    """Makes the formats known to a session; ``page_rasters`` only with a decoder."""
    spark.dataSource.register(NamedFiles)
    spark.dataSource.register(EventLog)
    if page_count and render:
        spark.dataSource.register(page_rasters(page_count, render))
