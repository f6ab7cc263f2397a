"""Small files and folders on whatever file system a path names: local, HDFS or an object store, through Hadoop's client."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession


class Files:
    """Paths without a scheme are taken as absolute local or default-system paths, as Spark's readers take them."""

    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext
        self.hadoop = self.sc._jvm.org.apache.hadoop.fs
        self.conf = self.sc._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self.hadoop.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def is_folder(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where) and system.getFileStatus(where).isDirectory()

    def mkdirs(self, path: str) -> None:
        system, where = self._at(path)
        system.mkdirs(where)

    def read(self, path: str) -> str:
        system, where = self._at(path)
        stream = system.open(where)
        try:
            return self.sc._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = True) -> bool:
        """Whether the file was written; without overwrite, one that is there stays and wins."""
        system, where = self._at(path)
        try:
            stream = system.create(where, overwrite)
        except Exception as e:
            if not overwrite and system.exists(where):
                return False
            raise e
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Write beside the file, then rename over it, so that a reader sees the old text or the new."""
        self.write(f"{path}.new", text)
        rename = getattr(self.hadoop, "Options$Rename")
        options = self.sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        where = self.hadoop.Path(path)
        self.hadoop.FileContext.getFileContext(where.getFileSystem(self.conf).getUri(), self.conf).rename(self.hadoop.Path(f"{path}.new"), where, options)

    def names(self, folder: str) -> list[str]:
        system, where = self._at(folder)
        return sorted(s.getPath().getName() for s in system.listStatus(where)) if system.exists(where) else []

    def walk(self, folder: str) -> Iterator[tuple[str, str, int]]:
        """(path below the folder, kind: file, folder or other, bytes) of everything in it; links are not followed."""
        pending = [""]
        system, root = self._at(folder)
        while pending:
            prefix = pending.pop()
            for status in system.listStatus(self.hadoop.Path(root, prefix) if prefix else root):
                name = f"{prefix}/{status.getPath().getName()}" if prefix else status.getPath().getName()
                kind = "other" if status.isSymlink() else "folder" if status.isDirectory() else "file"
                yield name, kind, status.getLen()
                if kind == "folder":
                    pending.append(name)

    def bytes(self, folder: str) -> int:
        system, where = self._at(folder)
        return system.getContentSummary(where).getLength()

    def delete(self, path: str) -> None:
        system, where = self._at(path)
        system.delete(where, True)


def absolute(path: str) -> str:
    """A path with a scheme as it is, any other from the working folder."""
    return path.rstrip("/") if "://" in path else os.path.abspath(path)
