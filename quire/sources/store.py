"""Named files in any store, written by tasks under temporary names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def write_named(df: DataFrame, out_uri: str, partitions: int | None = None) -> DataFrame:
    """``df``: file, place, value. Writes each file's values as lines in order of place; returns file, lines, bytes.
    A file is one task's stream and is moved to its name when whole. The result is what writes: evaluate it once."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = filesystem(out_uri)
        store.create_dir(path, recursive=True)
        done: list[tuple] = []
        out, name, tmp, lines, size = None, None, "", 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(tmp, f"{path}/{name}")
                done.append((name, lines, size))

        for batch in batches:
            for file, value in zip(batch["file"], batch["value"], strict=True):
                if file != name:
                    close()
                    name, tmp, lines, size = file, f"{path}/.{uuid.uuid4().hex}.tmp", 0, 0
                    out = store.open_output_stream(tmp)
                data = value.encode() + b"\n"
                out.write(data)
                lines, size = lines + 1, size + len(data)
        close()
        yield pd.DataFrame(done, columns=["file", "lines", "bytes"])

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select("file", "place", "value").repartition(n, "file").sortWithinPartitions("file", "place").mapInPandas(write, "file string, lines long, bytes long")


def paths_under(col, root: str):
    """The part of a path below ``root``."""
    return F.regexp_replace(col, "^(file:)?/*" + root.rstrip("/").lstrip("/") + "/", "")
