"""A small JSON file that says which folders make up a table, replaced as a whole at each commit."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Pointer:
    """CURRENT under a folder, with the one before as CURRENT.bak, in any store that Spark's file systems reach. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.files = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(self.at(""))

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _read(self, name: str) -> dict | None:
        """A pointer whose folders are all there; a missing or damaged one is none."""
        if not self.files.exists(self.at(name)):
            return None
        try:
            stream = self.files.open(self.at(name))
            found = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            return found if all(self.files.exists(self.at(folder)) for folder in self.folders(found)) else None
        except (Py4JJavaError, ValueError, KeyError, TypeError, AttributeError):
            return None

    def folders(self, state: dict) -> set[str]:
        """The folders that a state names."""
        return set(state["folders"])

    def read(self) -> dict | None:
        return self._read("CURRENT") or self._read("CURRENT.bak")

    def commit(self, state: dict) -> None:
        """Make state the current one; its folders are written before."""
        stream = self.files.create(self.at("CURRENT.tmp"), True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self.files.exists(self.at("CURRENT")):
            self.files.delete(self.at("CURRENT.bak"), False)
            self.files.rename(self.at("CURRENT"), self.at("CURRENT.bak"))
        self.files.rename(self.at("CURRENT.tmp"), self.at("CURRENT"))

    def clean_up(self, parents: tuple[str, ...] = ("",), older_than_seconds: float = 86_400.0) -> int:
        """Delete folders below parents that neither pointer names and that were written before; a day keeps long readers safe. Returns how many."""
        held = {folder for name in ("CURRENT", "CURRENT.bak") if (found := self._read(name)) for folder in self.folders(found)}
        limit, gone = (time.time() - older_than_seconds) * 1000, 0
        for parent in parents:
            if not self.files.exists(self.at(parent)):
                continue
            for status in self.files.listStatus(self.at(parent)):
                name = f"{parent}/{status.getPath().getName()}".lstrip("/")
                if status.isDirectory() and name not in held and name not in parents and status.getModificationTime() <= limit:
                    gone += bool(self.files.delete(status.getPath(), True))
        return gone
