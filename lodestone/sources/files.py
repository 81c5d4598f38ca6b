"""Small files on whatever file system a path names, through Spark's own Hadoop client."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The files under a folder; paths are relative to it, and a folder without a scheme is on Spark's default file system."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._jvm, self._gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.folder = str(folder).rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str = "") -> list[str]:
        """The names in a folder, sorted; a folder that isn't there has none."""
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, name: str) -> bytes | None:
        """A file's bytes, null if it isn't there or its checksum shows that it is damaged."""
        at = self._path(name)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes())
        except Py4JJavaError as error:
            if "ChecksumException" in str(error.java_exception):
                return None
            raise
        finally:
            stream.close()

    def size(self, name: str) -> int:
        """The bytes of a file, or of all files in a folder."""
        return self._fs.getContentSummary(self._path(name)).getLength()

    def _draft(self, name: str, data: bytes) -> str:
        folder, _, last = name.rpartition("/")
        draft = f"{folder + '/' if folder else ''}.{last}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(draft), False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        return draft

    def _rename(self, draft: str, name: str, overwrite: bool) -> None:
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if overwrite else kind.NONE
        source, target = (self._fs.makeQualified(self._path(x)) for x in (draft, name))
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self._conf).rename(source, target, options)

    def replace(self, name: str, data: bytes) -> None:
        """Writes a file; readers see the old one or the new one."""
        draft = self._draft(name, data)
        try:
            self._rename(draft, name, True)
        except BaseException:
            self.delete(draft)
            raise

    def create(self, name: str, data: bytes) -> bool:
        """Writes a file that mustn't be there yet, whole or not at all; False if another writer was first."""
        draft = self._draft(name, data)
        try:
            self._rename(draft, name, False)
            return True
        except Py4JJavaError as error:
            self.delete(draft)
            if "FileAlreadyExistsException" in str(error.java_exception):
                return False
            raise

    def delete(self, name: str) -> None:
        """Deletes a file or folder, if it is there."""
        self._fs.delete(self._path(name), True)
