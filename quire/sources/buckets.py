"""A keyed table in buckets that are replaced whole: an upsert reads and writes only those of the keys that change.

A row's bucket is the hash of its keys, or of the first of them where a lookup has only that one. Each upsert reads the
buckets that its rows fall into, puts the new rows in the place of those with equal keys and writes these buckets under
names of its own; a numbered commit then says which files are the table. A write that fails, or loses against
another, leaves the table as it was, and a reader keeps the version that it began with. Versions that are older than the ones
to keep are retired.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.sources.commits import Commits, Hadoop

KEPT = 10


class BucketTable:
    """``keys`` identify a row. The number of buckets is fixed by the first write; as a rule one bucket for 100 MB."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.files, self.commits = Hadoop(spark, self.path), Commits(spark, f"{self.path}/_commits")

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table, or the buckets of it that are asked for, as of a version that is still kept."""
        head = self.commits.head()[1] if version is None else self.commits.read(version)
        if not head:
            raise ValueError(f"{self.path} has no version yet")
        paths = [f"{self.path}/{d}" for b, d in head["files"].items() if only is None or int(b) in only]
        schema = StructType.fromJson(head["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, **key) -> DataFrame:
        """The row of a key: one bucket is read, with the key pushed down."""
        number, head = self.commits.head()
        schema = StructType.fromJson(head["schema"])
        row = self.spark.createDataFrame([tuple(key[k] for k in self.keys)], StructType([schema[k] for k in self.keys]))
        out = self.read(number, [row.select(self.bucket(head["buckets"])).first()[0]])
        for k in self.keys:
            out = out.filter(F.col(k) == F.lit(key[k]))
        return out

    def _write(self, rows: DataFrame, n: int, name: str) -> dict[str, str]:
        """The buckets of ``rows``, a task each, and where they are."""
        rows.withColumn("__bucket", self.bucket(n)).repartition(n, "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{name}")
        return {x.split("=")[1]: f"{name}/{x}" for x in self.files.names(name) if x.startswith("__bucket=")}

    def upsert(self, new: DataFrame) -> int:
        """``new``: the table's columns, one row a key. Returns the version."""
        staged, tried = f"_new-{uuid.uuid4().hex}", []

        def step(number: int, head: dict) -> dict:
            n = head.get("buckets", self.buckets)
            touched = sorted(r[0] for r in rows.select(self.bucket(n)).distinct().collect())  # bucket numbers
            old = {int(b) for b in head.get("files", {})}.intersection(touched)
            after = self.read(number, sorted(old)).join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows) if old else rows
            tried.append(f"v{number + 1}-{uuid.uuid4().hex[:8]}")
            return {"buckets": n, "schema": head.get("schema") or json.loads(new.schema.json()), "files": head.get("files", {}) | self._write(after, n, tried[-1])}

        try:
            new.write.parquet(f"{self.path}/{staged}")  # made once, read for each attempt
            rows = self.spark.read.schema(new.schema).parquet(f"{self.path}/{staged}")
            number, _ = self.commits.change(step)
        except BaseException:
            self._drop([*tried, staged])
            raise
        self._drop([*tried[:-1], staged])
        self.retire()
        return number

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.files.remove(name)

    def retire(self, kept: int = KEPT) -> None:
        """Removes versions before the last ``kept`` ones, and the files that only they name."""
        numbers = self.commits.numbers()
        stay = {d for v in numbers[-kept:] for d in self.commits.read(v)["files"].values()}
        for v in numbers[:-kept]:
            for d in self.commits.read(v)["files"].values():
                if d not in stay:
                    self.files.remove(d)
            self.commits.files.remove(f"{v:08d}.json")
