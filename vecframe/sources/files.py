"""Small files beside Spark's tables, on whatever file system the session reaches."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """Named texts in one folder, through Hadoop's file systems, as Spark itself reads and writes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm, self._gateway, self._conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        fs = self._at("").getFileSystem(self._conf)
        # local files without the sum that Hadoop keeps beside each, for the two can't be replaced at once
        return fs.getRawFileSystem() if fs.getUri().getScheme() == "file" and hasattr(fs, "getRawFileSystem") else fs

    def read(self, name: str) -> str | None:
        fs, at = self._fs(), self._at(name)
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Put a text in the place of one of its name; a reader sees one or the other."""
        fs, draft = self._fs(), self._at(f".{name}.{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.getUri().getScheme() == "file":
            fs.rename(draft, self._at(name))  # replaces what is there, as the operating system does
            return
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        how = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files.rename(draft, self._at(name), how)

    def claim(self, name: str) -> bool:
        """Make an empty file, or False if there is one: of several that try only one succeeds."""
        from py4j.protocol import Py4JJavaError

        fs, at = self._fs(), self._at(name)
        if fs.getUri().getScheme() == "file":  # Hadoop looks first and creates then; the operating system does both at once
            fs.mkdirs(at.getParent())
            return self._jvm.java.io.File(at.toUri().getPath()).createNewFile()
        try:
            fs.create(at, False).close()
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def age(self, name: str) -> float:
        """Seconds since a file was written; 0 if it is not there."""
        fs, at = self._fs(), self._at(name)
        if not fs.exists(at):
            return 0.0
        return (self._jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(at).getModificationTime()) / 1000

    def names(self) -> list[str]:
        fs, at = self._fs(), self._at("")
        return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []

    def remove(self, name: str) -> bool:
        return self._fs().delete(self._at(name), True)
