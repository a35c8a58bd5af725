"""Small files and folders of any store that Spark reaches: list, read, write once, delete."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """What a commit log needs of a store, through the file system that Spark has for it."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_once(self, path: str, text: str) -> bool:
        """Writes beside the path and moves it there, so that a reader sees the whole file or none. False if it was there."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        beside = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.tmp")
        stream = fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        return bool(fs.rename(beside, p))

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.delete(p, True))
