"""The few file-system calls a store needs, through Hadoop's API, so any storage Spark reads will do."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Fs:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def age(self, path: str) -> float:
        """Seconds since the path was last changed, by this machine's clock; 0 if it is gone."""
        try:
            return time.time() - self.fs.getFileStatus(self._path(path)).getModificationTime() / 1000
        except Exception as e:
            if "FileNotFound" in str(e):
                return 0.0
            raise

    def rename(self, source: str, target: str) -> bool:
        return self.fs.rename(self._path(source), self._path(target))

    def mkdirs(self, path: str) -> None:
        self.fs.mkdirs(self._path(path))

    def create_new(self, path: str) -> bool:
        """Creates an empty file; false if it is there already."""
        try:
            return self.fs.createNewFile(self._path(path))
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)
