"""Helpers shared by the training-data operators: staged tables, shared files, batches by bytes.

Everything that outlives a task goes to the folder named by ``spark.checkpoint.dir``, which the driver
and all executors share. Python reads and writes there through ``pyarrow.fs``, so any store works.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text held in Python at once, so that a batch of very long texts stays small.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one is made only where none is set and all tasks run on this
    machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_quire_dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark._quire_dir = found
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost
    executors, and gives later joins true sizes. ``options`` go to the writer."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by ``staged`` that no later plan reads."""
    path = getattr(df, "_quire_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def same_place(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, a view of a staged table, which ``discard`` then removes."""
    df._quire_path = table._quire_path
    return df


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI such as file:/a, file:///a, hdfs://h/a or s3://b/a."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def column(name: str) -> Column:
    """A column by its whole name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_hash(col: Column) -> Column:
    """crc32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(col.cast("string"), F.lit("")), "UTF-8"))


def most_frequent(counted: DataFrame, n: int, count: str = "n") -> DataFrame:
    """The rows of the highest counts, as many whole steps of a ninth of the count as fit into ``n`` rows. A
    sort with a limit would send ``n`` rows from each task to the driver; this sends one histogram. ``counted`` is
    read twice, so it should be a written table."""
    step = F.floor(F.log2(F.col(count)) * 6)
    sizes = sorted(((r.step, r.k) for r in counted.groupBy(step.alias("step")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = None, 0
    for s, k in sizes:
        held += k
        if held > n:
            break
        least = s
    return counted.filter(F.lit(False) if least is None else step >= least)


def by_bytes(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = [x or 0 for x in pa.compute.binary_length(batch.column(text)).to_pylist()]
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start, n - start)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows``, for narrow tables whose work is cheaper in bulk."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def filtered(df: DataFrame, text_col: str, batches: Callable[[Iterator[pa.RecordBatch], str], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``batches`` (a generator over record batches and the text's name there) leaves of the rows of ``df``, whose
    columns may have any names: while in Python they go by number."""
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    text = f"c{df.columns.index(text_col)}"
    return numbered.mapInArrow(lambda rows: batches(rows, text), numbered.schema).toDF(*df.columns)


def texts_of(batch: pa.RecordBatch, text: str) -> list[str]:
    """Null counts as empty."""
    return [x or "" for x in batch.column(text).to_pylist()]


def as_pairs(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only what an operator needs, under fixed names, so other columns can't clash."""
    return df.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"), *more)


import pyarrow.compute  # noqa: E402,F401  (pa.compute is a lazy submodule)
