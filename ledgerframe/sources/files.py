"""Small files and folders in any store that Hadoop's file system interface reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Paths below one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a new file that shows up whole or not at all; an existing one is an error."""
        if self._fs.exists(self._path(name)):
            raise FileExistsError(name)
        draft = self._path(f"{name}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(name)):
            raise FileExistsError(name)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
