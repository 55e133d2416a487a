"""Names, removal and atomic replacement in whatever file system a path belongs to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """The few things that a table of files needs beyond reading and writing DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._system = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._system.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        """Names directly below a folder; none if there is no such folder."""
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._path(path)))

    def remove(self, path: str) -> None:
        """Remove a file or a folder; it is no error if it is gone already."""
        self._system.delete(self._path(path), True)

    def put(self, text: str, path: str) -> bool:
        """Make a file of ``text`` appear at once, whole; False if there is one already."""
        if self.exists(path):
            return False
        folder, _, name = path.rpartition("/")
        draft = f"{folder}/_{name}-{uuid.uuid4().hex}"
        out = self._system.create(self._path(draft), False)
        out.write(bytearray(text, "utf-8"))
        out.close()
        return self._system.rename(self._path(draft), self._path(path))
