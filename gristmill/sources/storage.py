"""Small metadata files on whatever file system the path names (HDFS, S3, local)."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    def __init__(self, spark: SparkSession) -> None:
        self._jvm = spark.sparkContext._jvm
        self._new_array = spark.sparkContext._gateway.new_array
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def names(self, folder: str) -> list[str]:
        fs, target = self._open(folder)
        if not fs.exists(target):
            return []
        return sorted(status.getPath().getName() for status in fs.listStatus(target))

    def exists(self, path: str) -> bool:
        fs, target = self._open(path)
        return fs.exists(target)

    def read_text(self, path: str) -> str:
        fs, target = self._open(path)
        stream = fs.open(target)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Publish a file in one step; False when another writer got there first.

        A local file gets its name as a second link, which fails where the name exists;
        elsewhere it is renamed without overwriting.
        """
        fs, target = self._open(path)
        if fs.exists(target):
            return False
        staged = self._jvm.org.apache.hadoop.fs.Path(
            target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}"
        )
        stream = fs.create(staged, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() != "file" or not self._linked(staged, target):
                self._renamed(fs, staged, target)
            return True
        except (FileExistsError, Py4JJavaError):
            if fs.exists(target):
                return False
            raise
        finally:
            fs.delete(staged, False)

    @staticmethod
    def _linked(staged, target) -> bool:
        """False where the folder takes no links."""
        try:
            os.link(staged.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            raise
        except OSError:
            return False
        return True

    def _renamed(self, fs, staged, target) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        context.rename(staged, target, self._new_array(kind, 0))  # without options: no overwriting

    def changed_at(self, path: str) -> float:
        """Seconds since 1970 at which a file, or the newest file right in a folder, was written."""
        fs, target = self._open(path)
        return max((status.getModificationTime() for status in fs.listStatus(target)), default=0) / 1000

    def delete(self, path: str) -> bool:
        fs, target = self._open(path)
        return fs.exists(target) and fs.delete(target, True)
