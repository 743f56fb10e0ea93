"""Small text files in any file system that Spark reads (for manifests), through Hadoop's own interface."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        return self._fs().exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs().listStatus(self._path(folder)))

    def read(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one of that name already."""
        try:
            stream = self._fs().create(self._path(name), False)
        except Exception as e:
            if self.exists(name):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def delete(self, name: str = "") -> None:
        self._fs().delete(self._path(name), True)
