"""Small files through Spark's own file systems, so that any store Spark reaches will do."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def read(self, path: str) -> str:
        at, fs = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside the path and renames, so a reader never sees half a file."""
        at, fs = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(path + ".new")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if fs.exists(at):
            fs.delete(at, False)
        fs.rename(beside, at)

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder."""
        at, fs = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []

    def delete(self, path: str) -> None:
        at, fs = self._at(path)
        fs.delete(at, True)
