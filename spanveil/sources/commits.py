"""Small files that are made whole or not at all, and by one writer only.

A commit is a JSON file under ``<path>/_log``. It is written beside its place and
then put there by a step that fails if the place is taken: a rename that does not
overwrite, or on a local disk, where that is no single step, a hard link.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.root = spark, path, f"{path}/_log"
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Commits, in order of their names."""
        where = self._jvm.org.apache.hadoop.fs.Path(self.root)
        if not self._fs.exists(where):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(where))
        return sorted(n[:-5] for n in found if n.endswith(".json") and not n.startswith("."))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"{name}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, name: str, content: dict) -> bool:
        """Make a commit; False if there is one of that name."""
        temporary, place = self._at(f".{name}-{uuid.uuid4().hex}.tmp"), self._at(f"{name}.json")
        write(self._fs, temporary, json.dumps(content, sort_keys=True))
        try:
            return self._put(temporary, place)
        finally:
            self._fs.delete(temporary, False)

    def _put(self, temporary, place) -> bool:
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(*(self._fs.makeQualified(p).toUri().getPath() for p in (temporary, place)))
            except FileExistsError:
                return False
            return True
        try:
            rename(self.spark, temporary, place, overwrite=False)
        except Exception:
            if self._fs.exists(place):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(f"{name}.json"), False)


def write(fs, place, text: str) -> None:
    out = fs.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def rename(spark: SparkSession, source, place, overwrite: bool) -> None:
    """One step; without ``overwrite`` it fails if the place is taken."""
    sc = spark.sparkContext
    kind = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE if overwrite else kind.NONE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), sc._jsc.hadoopConfiguration()).rename(source, place, how)
