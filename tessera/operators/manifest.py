"""Numbered manifests of a folder: what is in it, as of each version, changed in one step."""

from __future__ import annotations

import json
import posixpath
import re
import uuid

from pyspark.sql import SparkSession

NAME = re.compile(r"manifest-(\d{12})\.json")


class Manifest:
    """JSON values under numbers; a number is taken once, whoever comes first, and a reader sees a whole value or none."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.folder = self.jvm.org.apache.hadoop.fs.Path(posixpath.join(path, "manifests"))
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.folder.getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def versions(self) -> list[int]:
        if not self.fs.exists(self.folder):
            return []
        return sorted(int(m[1]) for f in self.fs.listStatus(self.folder) if (m := NAME.fullmatch(f.getPath().getName())))

    def read(self) -> dict | None:
        """The newest value, with its `version`; None if there is none."""
        found = self.versions()
        if not found:
            return None
        stream = self.fs.open(self.at(f"manifest-{found[-1]:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")) | {"version": found[-1]}
        finally:
            stream.close()

    def write(self, value: dict, after: int | None) -> dict:
        """The value as the version after another one (None: the first); an error if that version is taken."""
        version = 0 if after is None else after + 1
        own = self.at(f".{uuid.uuid4().hex}")
        stream = self.fs.create(own, False)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(own), self.fs.makeQualified(self.at(f"manifest-{version:012d}.json")), none)
        except Exception as e:
            self.fs.delete(own, False)
            if "exist" in str(e).lower():
                raise RuntimeError(f"version {version} of {self.path} was written by someone else") from None
            raise
        return value | {"version": version}

    def keep(self, folders: list[str], inside: str) -> None:
        """Delete older versions, and what lies in a folder but is not named."""
        for v in self.versions()[:-1]:
            self.fs.delete(self.at(f"manifest-{v:012d}.json"), False)
        place = self.jvm.org.apache.hadoop.fs.Path(posixpath.join(self.path, inside))
        if self.fs.exists(place):
            for f in self.fs.listStatus(place):
                if f.getPath().getName() not in folders:
                    self.fs.delete(f.getPath(), True)


def source_state(spark: SparkSession, path: str) -> str:
    """Bytes, files and time of the last change of a table's folder or file: two calls, whatever its size."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    summary = fs.getContentSummary(place)
    return f"{summary.getLength()}:{summary.getFileCount()}:{fs.getFileStatus(place).getModificationTime()}"
