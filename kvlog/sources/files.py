"""Small files on any store that Spark reaches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder name that all executors share: below spark.checkpoint.dir; a single-JVM session without one gets a
    folder of this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kvlog-")
    return f"{named.rstrip('/')}/kvlog-{uuid.uuid4().hex}"


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def mkdirs(self) -> None:
        self._fs.mkdirs(self._path(""))

    def names(self, sub: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(sub))) if self.exists(sub) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def _claim(self, name: str) -> bool:
        """Create an empty file; false if there is one already."""
        try:
            self._fs.create(self._path(name), False).close()
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        return True

    def create(self, name: str, data: bytes) -> bool:
        """A new file with all of ``data``, or none; false if there is one already.  This is the atomic step of a
        commit: the bytes go to a temporary file, and the winner of an exclusive claim renames it, so that no reader
        ever sees a part of them."""
        temporary, claim = f"temporary-{uuid.uuid4().hex}", f"claim-{name}"
        stream = self._fs.create(self._path(temporary), False)
        try:
            stream.write(bytearray(data))
            stream.hsync()
        finally:
            stream.close()
        claimed = False
        try:
            claimed = self._claim(claim)
            if not claimed or self.exists(name):
                return False
            if not self._fs.rename(self._path(temporary), self._path(name)):
                raise OSError(f"{name} could not be renamed")
            return True
        finally:
            self.delete(temporary)
            if claimed:
                self.delete(claim)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
