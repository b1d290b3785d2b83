"""Small files and listings through Hadoop's file systems, so a root can be any store Spark reaches."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """The names in a folder, sorted; none if there is no folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def is_dir(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isDirectory()

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def head(self, path: str, n: int) -> bytes:
        """The first ``n`` bytes of a file."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
        finally:
            stream.close()

    def sha256(self, path: str) -> str:
        """The digest of a file, however large, read as a stream."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def write_new(self, path: str, data: bytes) -> bool:
        """Create a file with its content; False if there is one already, also when two do it at once.

        Local files are written aside and linked, other file systems create without overwriting; both are
        one step that only one of two can win.
        """
        fs, p = self._at(path)
        if fs.getScheme() == "file":
            target = p.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{os.path.dirname(target)}/.{os.path.basename(target)}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            try:
                os.link(part, target)
            except FileExistsError:
                return False
            finally:
                os.remove(part)
            return True
        try:
            stream = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        stream.write(bytearray(data))
        stream.close()
        return True

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.delete(p, True))
