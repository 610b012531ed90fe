"""Numbered commits in a shared folder: whoever writes the next number first wins, the others look again.

A commit is a small JSON file, ``00000042.json``. It appears whole or not at all, and never over another: on local disks by
a link that fails where the name is taken, elsewhere by a move that doesn't overwrite. What a commit names (tables, counts)
is written before it, under names of its own, so a writer that loses or dies leaves nothing that counts.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def local(path: str) -> str | None:
    """The path on this machine, if it is one."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None if "://" in path else path


class Hadoop:
    """The few file operations that a driver needs, in any store that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path = path.rstrip("/")
        self.fs = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.at(name), True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()

    def put_if_absent(self, name: str, text: str) -> bool:
        """False if the name is taken."""
        tmp = f"_{uuid.uuid4().hex}.tmp"
        self.write(tmp, text)
        here = local(self.path)
        try:
            if here is not None:
                os.link(f"{here}/{tmp}", f"{here}/{name}")
            else:
                options = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.at(tmp), self.at(name), options)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self.exists(name):
                return False
            raise
        finally:
            self.remove(tmp)


class Commits:
    """The log of a folder; ``head`` is the last commit's number and content, -1 and nothing before the first."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Hadoop(spark, path)

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names() if n.endswith(".json") and n[:-5].isdigit()]

    def read(self, number: int) -> dict:
        return json.loads(self.files.read(f"{number:08d}.json"))

    def head(self) -> tuple[int, dict]:
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (-1, {})

    def put(self, number: int, content: dict) -> bool:
        return self.files.put_if_absent(f"{number:08d}.json", json.dumps(content))

    def change(self, step: Callable[[int, dict], dict | None]) -> tuple[int, dict] | None:
        """``step(head's number, its content)`` makes the next commit, again after each race that is lost; None ends it without one. A
        step that fails because others have meanwhile retired what its head names is taken again from the new head."""
        while True:
            number, content = self.head()
            try:
                new = step(number, content)
            except Exception:
                if self.numbers()[-1:] == ([number] if number >= 0 else []):
                    raise
                continue
            if new is None:
                return None
            if self.put(number + 1, new):
                return number + 1, new
