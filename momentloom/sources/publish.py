"""Tables that change at once, and stages that resume.

A published table is a folder of versions and a small file that names the current one. A writer
fills a version of its own and then renames a pointer file over the old one: readers see
the old table or the new one, whatever happens to the writer. A resumable stage keeps its results in
parts, each with the keys that it has finished; a part counts once its marker is there.

Files are written through Spark and Hadoop's file systems, so that folders may lie wherever these
reach. The rename is atomic on HDFS and local disks; on an object store a pointer is one object, written whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder in any Hadoop file system: small files, renames and lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.conf)

    def at(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """The names in a folder below this one, in order; of none, none."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A small file, there at once with its whole text: written aside and renamed over what was there."""
        aside = self.at(f"_aside-{uuid.uuid4().hex}")
        self.fs.mkdirs(self.at(name).getParent())
        stream = self.fs.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.conf).rename(self.fs.makeQualified(aside), self.fs.makeQualified(self.at(name)), how)

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


POINTER, VERSIONS = "_current", "versions"


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Makes df the table at path; the name of its version. df may be read from path itself.

    A failing write leaves the table as it is, and its files to the next publish, which removes all but the last keep
    versions before its own (readers of older ones have started before). Of two writers at once the later rename
    wins; each of their versions is whole.
    """
    folder = Folder(df.sparkSession, path)
    before = folder.names(VERSIONS)
    current = folder.read(POINTER)
    # Names sort by time: a number after the last one, then a mark that tells writers apart.
    last = max((int(n.split("-")[0]) for n in before), default=0)
    name = f"{last + 1:012d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{folder.path}/{VERSIONS}/{name}")
    folder.put(POINTER, name)
    for old in [n for n in before if n != current][: max(0, len(before) - keep)]:
        folder.remove(f"{VERSIONS}/{old}")
    return name


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of the table at path. Raises ValueError where nothing has been published."""
    folder = Folder(spark, path)
    name = folder.read(POINTER)
    if name is None:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(f"{folder.path}/{VERSIONS}/{name}")


class ResumableStage:
    """Work on a table by key that goes on where it was stopped.

    run() leaves out the rows whose keys are finished, deals the rest into portions by a hash of the
    key, works on one portion after the other and commits each: its rows and its keys first, then a marker
    file, in one step. What a killed run had not committed is not read by anyone and done again. A key with
    rows that give no results is finished as well. Null keys are one key. Rows of one key lie in one portion.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.key = spark, key
        self.folder = Folder(spark, path)

    def parts(self) -> list[str]:
        return self.folder.names("done")

    def _read(self, kind: str, schema: Any) -> DataFrame:
        paths = [f"{self.folder.path}/{kind}/{p}" for p in self.parts()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def unfinished(self, rows: DataFrame) -> DataFrame:
        """The rows whose keys no committed part has."""
        keys = self._read("keys", rows.select(*self.key).schema)
        same = [rows[k].eqNullSafe(keys[k]) for k in self.key]
        cond: Column = same[0]
        for c in same[1:]:
            cond = cond & c
        return rows.join(keys, cond, "left_anti")

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame], portions: int = 8) -> DataFrame:
        """The results of all parts, after work on what was unfinished. work must treat keys apart."""
        left = self.unfinished(rows)
        schema = work(rows).schema
        for k in range(portions):
            own = left.filter(F.pmod(F.xxhash64(*self.key), F.lit(portions)) == k)
            keys = own.select(*self.key).distinct()
            name = uuid.uuid4().hex
            keys.write.parquet(f"{self.folder.path}/keys/{name}")
            # What the keys' table holds is what is worked on, so that rows which come in between are left to the next run.
            if self.spark.read.schema(keys.schema).parquet(f"{self.folder.path}/keys/{name}").isEmpty():
                self.folder.remove(f"keys/{name}")
                continue
            work(own).write.parquet(f"{self.folder.path}/rows/{name}")
            self.folder.put(f"done/{name}", "")
        return self._read("rows", schema)

    def sweep(self) -> int:
        """Removes what stopped runs left behind; call it while no run is under way. The number of parts removed."""
        done = set(self.parts())
        left = {n for kind in ("keys", "rows") for n in self.folder.names(kind)} - done
        for n in left:
            self.folder.remove(f"keys/{n}")
            self.folder.remove(f"rows/{n}")
        return len(left)
