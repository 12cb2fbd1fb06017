"""A log of numbered commits in a folder, and the few file operations that stores need.

A commit is one small JSON file that holds the whole state after it, so a reader
lists names and reads one file. Files are created and never written over: of two
writers that make the same commit one fails, and begins again from the other's."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

DIGITS = 12


class Files:
    """Hadoop's file operations on one path's file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def bytes(self, folder: str) -> int:
        at = self._path(folder)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a new file; False where there is one already."""
        at = self._path(path)
        if self._fs.exists(at):
            return False
        try:
            stream = self._fs.create(at, False)
        except Exception as why:  # noqa: BLE001  the JVM's exception type is told by its name only
            if "AlreadyExists" in str(why):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self.files = root.rstrip("/"), Files(spark, root)

    def newest(self) -> tuple[int, dict | None]:
        """Number and state of the newest commit; 0 and none where there is none."""
        numbers = [int(n[:-5]) for n in self.files.names(self.root) if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, None
        return max(numbers), json.loads(self.files.read(self._name(max(numbers))))

    def commit(self, number: int, state: dict) -> bool:
        """Makes commit ``number``; False where another writer has made it."""
        text = json.dumps(state | {"commit": uuid.uuid4().hex}, sort_keys=True)
        return self.files.create(self._name(number), text) and self.files.read(self._name(number)) == text

    def _name(self, number: int) -> str:
        return f"{self.root}/{number:0{DIGITS}d}.json"
