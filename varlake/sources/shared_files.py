"""Files in the shared store that tasks write themselves, and a log of versions with exclusive commits."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a URI and the path within it; a bare path is a local one."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, by the session's Hadoop file systems; none where it doesn't exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class VersionLog:
    """Numbered JSON records in a folder. Each number is committed once, by one writer.

    A record is written aside and renamed into place, which fails where the number is taken: a
    reader sees whole records only. Numbers order the records, so no clock is asked. Runs on the
    driver, through the session's Hadoop file systems; on an object store without such a rename,
    let only one writer commit at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        """Committed numbers in order."""
        names = folder_names(self.spark, self.folder)
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, record: dict) -> int:
        """Commit ``record`` as ``number``; raises :class:`Conflict` where that is taken."""
        aside = self._path(f"_{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        try:
            out.write(json.dumps(record).encode())
        finally:
            out.close()
        target = self._path(f"{number:012d}.json")
        context = self._hadoop.FileContext.getFileContext(target.toUri(), self._conf)
        rename = getattr(self._hadoop, "Options$Rename")
        none = self.spark.sparkContext._gateway.new_array(rename, 1)
        none[0] = rename.NONE
        try:
            context.rename(aside, target, none)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise Conflict(f"version {number} of {self.folder} is taken") from e
            raise
        return number

    def append(self, record: dict) -> int:
        """Commit ``record`` under the next free number."""
        while True:
            try:
                return self.commit((self.numbers() or [0])[-1] + 1, record)
            except Conflict:
                continue
